"""Exact dedup by deterministic block naming.

Every text is cut into blocks of fixed size.  Blocks are sorted, and each
distinct block gets an integer name; then adjacent pairs of names are named in
the same way, level by level, until a document is left with one name.  Equal
(level, name) means equal text and nothing else does: names come from sorting
the keys themselves, no digest decides equality.

Naming in two steps keeps a hot block out of any single task: rows are first
dealt by (key, salt), where each salt finds its own representative; only the
representatives, at most ``salts`` a key, then meet to be named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

PART = 1 << 20


def _place(n, pos):
    """Number of a row's names and the place among them in one column, so that both uses of a shuffle need the same columns and share it."""
    return F.shiftleft(n.cast("long"), 32) + pos.cast("long")


def _named(members: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """members: (row, place, *keys) -> (row, pos, n, name), equal keys having equal names."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("row", "place"), F.lit(salts)))
    own = Window.partitionBy(*keys, "salt").orderBy("row", "place")
    local = salted.withColumns({"rep_row": F.first("row").over(own), "rep_place": F.first("place").over(own)})
    reps = local.where("row = rep_row and place = rep_place").select("row", "place", *keys)
    ordered = reps.repartition(*keys).sortWithinPartitions(*keys, "row", "place").withColumn("ordinal", F.monotonically_increasing_id())
    names = ordered.select(
        F.col("row").alias("rep_row"), F.col("place").alias("rep_place"), F.first("ordinal").over(Window.partitionBy(*keys).orderBy("row", "place")).alias("name")
    )
    out = local.select("row", "place", "rep_row", "rep_place").join(names, ["rep_row", "rep_place"])
    return out.select("row", F.expr("int(place & 4294967295)").alias("pos"), F.shiftright("place", 32).cast("int").alias("n"), "name")


def text_identities(rows: DataFrame, scratch: Scratch, block_bytes: int = 1024, salts: int = 64) -> DataFrame:
    """rows: (row, text) with unique rows -> (row, level, name); equal (level, name) if and only if texts are equal."""
    raw = rows.select("row", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    cut = lambda c, size: F.transform(F.sequence(F.lit(0), F.expr(f"int(greatest(length({c}) - 1, 0) div {size})")), lambda i: F.substring(F.col(c), i * size + 1, F.lit(size)))
    # in two steps, so that a giant text isn't copied once a block
    parts = raw.select("row", F.expr(f"int(greatest(length(raw) - 1, 0) div {block_bytes}) + 1").alias("n"), F.posexplode(cut("raw", PART)).alias("part", "piece"))
    blocks = parts.select("row", "n", "part", F.posexplode(cut("piece", block_bytes)).alias("at", "block"))
    blocks = blocks.select("row", _place(F.col("n"), F.col("part") * (PART // block_bytes) + F.col("at")).alias("place"), "block")
    level, current = 0, scratch.table(_named(blocks, ["block"], salts), "names-0")
    done = [current.where("n = 1").select("row", F.lit(0).alias("level"), "name")]
    longest = current.agg(F.max("n")).first()[0] or 0
    while longest > 1:
        level += 1
        at = lambda side: F.max(F.when(F.col("pos") % 2 == side, F.col("name")))
        pairs = current.where("n > 1").groupBy("row", F.expr("int(pos div 2)").alias("pos")).agg(
            F.expr("int((max(n) + 1) div 2)").alias("n"), at(0).alias("left"), F.coalesce(at(1), F.lit(-1)).alias("right")
        )
        pairs = pairs.select("row", _place(F.col("n"), F.col("pos")).alias("place"), "left", "right")
        current = scratch.table(_named(pairs, ["left", "right"], salts), f"names-{level}")
        done.append(current.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        longest = (longest + 1) // 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1024, salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are equal.  Of equal texts the
    row with the largest id stays (null ids are smallest); of rows that repeat id
    and text too, exactly one stays.  Other columns are ignored; an empty table
    gives no rows.  ``docs`` must give the same rows in the same partitions when it
    is read again (files or a checkpoint), as rows are numbered by their place.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = text_identities(rows.select("row", "text"), scratch, block_bytes, salts)
    digest = rows.select("row", "id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    members = scratch.table(digest.join(named, "row"), "members")
    groups = scratch.table(members.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("keep")), "groups")
    return members.join(groups, ["level", "name"]).select(
        F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
