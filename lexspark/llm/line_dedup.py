"""Line dedup by site-relative frequency.

Pages are grouped by site; the pages that hold a line are divided by the pages of
the site, and a line whose share exceeds ``max_ratio`` is boilerplate there and goes.
A line is repeated at all only from ``repeated`` pages on: on fewer, any line of a
site of a few pages would have a high share.  A page that repeats a line counts
once.  Lines are compared without blanks at their ends; blank lines always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_batches, table

#: Ordinary lines of a site stand on up to 4.8 % of its pages in the given tables, boilerplate on 9 % at least; copies of a page count as pages.
MAX_RATIO, REPEATED = 0.07, 3
#: A site's rows meet its list of lines in as many tasks.
SALTS = 64


def _bare(line):
    return F.trim(line, F.lit(" \t\r"))


def _site(c: Column) -> Column:
    """A site's key; null sites are one site, apart from the empty name."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def boilerplate(docs: DataFrame, site_col: str, text_col: str, max_ratio: float = MAX_RATIO, repeated: int = REPEATED) -> DataFrame:
    """(site, lines): the boilerplate lines of each site that has any.

    A site's list is bounded: each of its lines stands on over ``max_ratio`` of the
    pages, so there are fewer than the mean number of lines a page / ``max_ratio``.
    Counts are combined before the shuffle, so neither a hot site nor a hot line
    meets in one task as rows.
    """
    pages = docs.select(_site(F.col(site_col)).alias("site"), F.split(F.col(text_col), "\n").alias("lines"))
    bare = F.array_distinct(F.filter(F.transform("lines", _bare), lambda x: x != ""))
    counts = pages.select("site", F.explode(bare).alias("line")).groupBy("site", "line").count().where(F.col("count") >= repeated)
    totals = docs.groupBy(_site(F.col(site_col)).alias("site")).agg(F.count(F.lit(1)).alias("total"))
    often = counts.join(totals, "site").where(F.col("count").cast("double") > F.lit(float(max_ratio)) * F.col("total"))
    return often.groupBy("site").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, repeated: int = REPEATED, counts: bool = True, length_col: str | None = None) -> DataFrame:
    """``docs`` with its text cleaned, and, if ``counts``, line_count and lines_dropped (lines that aren't blank).

    Null sites are one site.  A null text stays null and has no lines; a text that
    loses all its lines becomes empty, its row stays.  Repeated rows count as pages
    of their own.  A very long text is split and joined as one value; an empty table
    gives no rows.  Columns of those two names in ``docs`` are replaced; without
    ``counts`` every other column stays as it is, but for ``length_col``, which follows
    the text where lines went.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    site, salt, gone, lines, kept = fresh(docs, "site", "salt", "boilerplate", "lines", "kept")
    found = scratch.table(boilerplate(docs, site_col, text_col, max_ratio, repeated), "boilerplate")
    found = found.select(F.col("site").alias(site), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.col("lines").alias(gone))
    d = docs.withColumns({site: _site(F.col(site_col)), salt: (F.monotonically_increasing_id() % SALTS).cast("int"), lines: F.split(F.col(text_col), "\n")})
    d = d.join(found, [site, salt], "left")
    d = d.withColumn(kept, F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col(gone), _bare(x)), F.lit(True))))
    filled = F.coalesce(F.size(F.filter(lines, lambda x: _bare(x) != "")), F.lit(0))
    known = F.col(lines).isNotNull()
    # a text that loses no line is passed on as it is
    loses = F.coalesce(F.size(kept) < F.size(lines), F.lit(False))
    cleaned = F.when(loses, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    out = {text_col: cleaned}
    if length_col is not None:
        out[length_col] = F.when(loses, F.length(cleaned).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
    if counts:
        out["line_count"] = F.when(known, filled).otherwise(F.lit(0)).cast("long")
        out["lines_dropped"] = F.when(known, F.size(lines) - F.size(kept)).otherwise(F.lit(0)).cast("long")
    names = [*docs.columns, *(c for c in out if c not in docs.columns)]
    return d.withColumns(out).select(*(f"`{c}`" for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of ``documents`` are its sources: it has no urls, and ``pages`` are other texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "line_count", "lines_dropped", "text")


SQL = r"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
l AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
t AS (SELECT source, count(*) AS total FROM p GROUP BY source),
c AS (SELECT n.source, bare FROM (SELECT source, bare, count(DISTINCT page) AS n FROM b WHERE bare <> '' GROUP BY ALL) n JOIN t ON n.source IS NOT DISTINCT FROM t.source
      WHERE n >= 3 AND n::DOUBLE > 0.07::DOUBLE * total),
m AS (SELECT b.*, c.bare IS NOT NULL AS gone FROM b LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source AND b.bare = c.bare)
SELECT d.doc_id, d.source, coalesce(x.line_count, 0) AS line_count, coalesce(x.lines_dropped, 0) AS lines_dropped,
       CASE WHEN x.lines_dropped > 0 THEN coalesce(x.text, '') ELSE d.text END AS text
FROM p d LEFT JOIN (
  SELECT page, count(*) FILTER (bare <> '') AS line_count, count(*) FILTER (gone) AS lines_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
  FROM m GROUP BY page) x USING (page)
"""
