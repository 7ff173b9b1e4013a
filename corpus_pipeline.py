"""From raw documents to encoded, mixed training rows: five stages, each over all that the one before kept.

Every stage takes any table with the columns of documents: other columns pass
through, whatever their names; an empty table gives an empty table; nulls, empty and
very long texts, ties and repeated rows are treated as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import line_dedup, near_dedup, piece_codec, quality, source_mix
from lexspark.llm.common import Scratch, fresh, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, if there is such a column, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of sf_dir, doesn't reject.

    Null and empty texts are scored alike; repeated rows stay or go together; without
    labels every score is 0.5 and all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; n_chars follows the text. No document goes.

    A null source is a source.  A null text stays null; one that loses all its lines
    becomes empty.  Repeated rows count as pages of their own.
    """
    return line_dedup.drop_boilerplate(docs, counts=False, length_col="n_chars" if "n_chars" in docs.columns else None)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id.

    Repeated rows are near duplicates, so one of them stays; null ids come last, and
    don't make rows alike.  Null, empty and blank texts are no one's duplicates.
    """
    (row,) = fresh(docs, "row")
    rows = Scratch(spark).table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_dedup.near_dedup(rows, row).select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, F.col("doc_id").alias("id")), row)
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; the one at the budget is cut there; n_chars follows the text.

    A null source is a source, the last one.  Texts without words come once.  What
    repeated rows take together doesn't depend on their order.
    """
    return _measured(source_mix.mixed_rows(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip of each row of the mix; null and empty texts have no pieces."""
    return piece_codec.encode(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_each_group),
    ("source_mix", mixed_sources),
    ("piece_codec", encoded),
]
#: Neither the classifier nor the pieces can be expressed in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
