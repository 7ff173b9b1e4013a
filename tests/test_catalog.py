"""Every query with SQL agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexspark import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    return cols, sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())
