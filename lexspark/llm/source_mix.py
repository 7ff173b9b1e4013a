"""Mixing sources to target weights by exact prefix cuts of a hash-random order.

Every row gets a hash-random key.  The key's leading byte cuts each source into 256
parts, the next byte each part into 256 ranges.  Sums of the parts are prefixed within
the source, sums of the ranges within their part, rows within their range, and the
three prefixes give a row's exact place among its source's words.  A hot source is
thus dealt over tens of thousands of ranges, and a prefix sum sees 256 sums or a
range's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, table, word_count

WEIGHTS = (5, 2, 1)


def _source_key(source_col: str):
    """Sorts by code point with null last, and is never null."""
    return F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """sources: (src, source_size), a row each -> with target.

    Sources in order of src weigh ``weights``, repeating, and share the sum of all
    sizes.  No target exceeds ``cap`` times its source's size: with sources sorted
    by cap/weight, those up to some place are at their cap and the rest share what
    is left by weight; the first place where the next source stays below its cap
    is the fixed point of resharing the excess again and again.
    """
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(everything.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w.cast("long")).withColumn("limit", F.col("source_size") * cap)
    by_cap = everything.orderBy(F.col("limit").cast("double") / F.col("w"), "src")
    s = s.withColumns({
        "place": F.row_number().over(by_cap),
        "left_over": F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_left": F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
    })
    fits = F.col("left_over").cast("double") * F.col("w") <= F.col("limit").cast("double") * F.col("w_left")
    s = s.withColumn("first", F.min(F.when(fits, F.struct("place", "left_over", "w_left"))).over(everything))
    shared = (F.col("w") * F.col("first.left_over")).cast("double") / F.col("first.w_left").cast("double")
    target = F.when(F.col("place") >= F.col("first.place"), shared).otherwise(F.col("limit").cast("double"))
    return s.select("src", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_taken.

    mix_size counts words (null text: 0).  mix_taken is the number of the row's words
    that the mix takes: whole epochs of its source, then, in hash-random order, words
    up to the rounded target, so a source's sum is its target to within half a word
    and at most one row a source is cut.  Rows of equal id are ordered by size; what
    such rows take together doesn't depend on their order.  A null id counts as its
    text's digest.  Texts without words take nothing.  A very long text is counted as
    one value; an empty table gives no rows.  Columns of those names in ``docs`` are
    replaced; others are kept as they are.
    """
    scratch = Scratch(docs.sparkSession)
    src, key, part, cell, before, start, budget = names = fresh(docs, "src", "key", "part", "cell", "before", "start", "budget")
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    byte = lambda at: F.conv(F.substring(key, at, 2), 16, 10).cast("int")
    rows = docs.withColumns({src: _source_key(source_col), key: hashed, "mix_size": word_count(F.col(text_col))}).withColumns({part: byte(1), cell: byte(3)})
    cells = scratch.table(rows.groupBy(F.col(src).alias("src"), F.col(part).alias("part"), F.col(cell).alias("cell")).agg(F.sum("mix_size").alias("size")), "cells")
    goals = scratch.table(targets(cells.groupBy("src").agg(F.sum("size").alias("source_size")), weights, cap), "goals")
    sofar = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cells.groupBy("src", "part").agg(F.sum("size").alias("size")).select("src", "part", sofar(Window.partitionBy("src").orderBy("part")).alias("before_part"))
    ranges = cells.select("src", "part", "cell", sofar(Window.partitionBy("src", "part").orderBy("cell")).alias("before_cell"))
    places = ranges.join(parts, ["src", "part"]).join(goals, "src").select(
        F.col("src").alias(src), F.col("part").alias(part), F.col("cell").alias(cell), (F.col("before_part") + F.col("before_cell")).alias(before),
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
    )
    places = scratch.table(places, "places")
    within = Window.partitionBy(src, part, cell).orderBy(key, id_col, "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.drop("mix_source_size", "mix_target", "mix_taken").join(places, [src, part, cell])
    placed = placed.withColumn(start, F.col(before) + F.coalesce(F.sum("mix_size").over(within), F.lit(0))).withColumn(budget, F.floor(F.col("mix_target") + 0.5))
    last = F.least(F.col("mix_size"), F.greatest(F.lit(0), F.expr(f"{budget} % mix_source_size") - F.col(start)))
    taken = F.when(F.col("mix_source_size") == 0, F.lit(0)).otherwise(F.expr(f"({budget} div mix_source_size) * mix_size") + last)
    return placed.withColumn("mix_taken", taken.cast("long")).drop(*names)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once for every whole time that it is taken, and the row at
    its source's budget once more, its text cut after its last word taken.  Texts without words: once.
    ``docs`` keeps its columns, whatever their names."""
    text_col = options.get("text_col", "text")
    own = {c: n for c, n in zip(docs.columns, fresh(docs, *(f"own_{c}" for c in docs.columns)), strict=True) if c.lower() in ("mix_size", "mix_source_size", "mix_target", "mix_taken")}
    m = mix(docs.withColumnsRenamed(own), **options)
    whole = F.when(F.col("mix_size") == 0, F.lit(1)).otherwise(F.expr("mix_taken div mix_size"))
    part = F.when(F.col("mix_size") == 0, F.lit(0)).otherwise(F.expr("mix_taken % mix_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole.cast("int")), F.filter(F.array(part), lambda p: p > 0))
    (cut,) = fresh(m, "cut")
    out = m.withColumn(cut, F.explode(copies))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    return out.withColumn(text_col, F.when(F.col(cut) > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(F.col(cut), F.lit(1))), "")).otherwise(F.col(text_col))).select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5('mix:' || coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, '')))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT src, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::BIGINT AS w FROM rows GROUP BY src),
s1 AS (SELECT *, source_size * 3 AS cap, row_number() OVER c AS place, sum(w) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_left,
              (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_over
       FROM s0 WINDOW c AS (ORDER BY (source_size * 3)::DOUBLE / w, src)),
f AS (SELECT * FROM s1 WHERE left_over::DOUBLE * w <= cap::DOUBLE * w_left ORDER BY place LIMIT 1),
s AS (SELECT s1.src, s1.source_size, CASE WHEN s1.place >= f.place THEN (s1.w * f.left_over)::DOUBLE / f.w_left::DOUBLE ELSE s1.cap::DOUBLE END AS target
      FROM s1 LEFT JOIN f ON TRUE),
p AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM rows)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (floor(target + 0.5)::BIGINT // source_size) * size
            + least(size, greatest(0, floor(target + 0.5)::BIGINT % source_size - start)) END::BIGINT AS taken
FROM p JOIN s USING (src)
"""
