"""The folder for intermediate tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made since a scope was entered; None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    Only a single-process session (``local[...]``) without that setting gets a
    temporary folder; a cluster without it is an error, since a folder of one
    machine would be lost with it.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lexspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _on(spark: SparkSession, path: str, f):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return f(p.getFileSystem(sc._jsc.hadoopConfiguration()), p)


def new_folder(spark: SparkSession) -> str:
    """A folder name of one's own under the shared one; it goes with its scope, or when the session's process ends."""
    path = f"{shared_dir(spark)}/lexspark/{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    _on(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders made inside go at the end: for work whose results are written elsewhere by then."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            _on(spark, path, lambda fs, p: fs.delete(p, True))
        _made.reset(token)


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: computed once, whatever reads it."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over at least twice as many tasks as there are cores, for work a row that takes far longer than moving it: few large files would leave cores idle."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
