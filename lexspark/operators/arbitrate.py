"""Arbitration: of overlapping spans the first in order stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_come(spans: Column, overlaps=None) -> Column:
    """Fold an ordered array of structs with start and end: keep each that no kept one overlaps."""
    hit = overlaps or (lambda x, y: (x["end"] > y["start"]) & (x["start"] < y["end"]))
    return F.aggregate(spans, F.slice(spans, F.lit(1), F.lit(0)), lambda kept, s: F.when(F.exists(kept, lambda k: hit(s, k)), kept).otherwise(F.concat(kept, F.array(s))))


def arbitrate(candidates: DataFrame) -> DataFrame:
    """Candidates that stay, in a document's order of family and place; what is left is disjoint."""
    fields = [c for c in candidates.columns if c not in ("document_id", "family", "seq")]
    rows = candidates.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("family", "seq", *fields))).alias("rows"))
    return rows.select("document_id", F.explode(first_come(F.col("rows"))).alias("c")).select("document_id", "c.*")


def suppress(spans: DataFrame, by: str = "document_id", least: float = 0.5) -> DataFrame:
    """Span non-maximum suppression: best score first (ties: earlier start, then end), a span goes if its IoU with a kept one reaches ``least``."""
    from lexspark.functions.text import iou

    rows = spans.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "start", "end", "label", "score"))).alias("rows"))
    kept = first_come(F.col("rows"), lambda x, y: iou(x["start"], x["end"], y["start"], y["end"]) >= least)
    return rows.select(by, F.explode(kept).alias("s")).select(by, "s.start", "s.end", "s.label", "s.score")
