"""Evaluation: alignment of predicted and gold spans, reports, calibration and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.functions.text import iou


def overlapping(gold: DataFrame, predicted: DataFrame, least: float = fixed.IOU) -> DataFrame:
    """(document_id, g, p, iou): pairs of a document's spans whose IoU reaches ``least``; g and p are their indices."""
    a = gold.select("document_id", "g", F.col("start").alias("gs"), F.col("end").alias("ge"))
    b = predicted.select("document_id", "p", F.col("start").alias("ps"), F.col("end").alias("pe"))
    near = a.join(b, (a.document_id == b.document_id) & (a.gs < b.pe) & (b.ps < a.ge)).drop(b.document_id)
    return near.select("document_id", "g", "p", iou(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe")).alias("iou")).where(F.col("iou") >= least)


def greedy_match(gold: DataFrame, predicted: DataFrame, least: float = fixed.IOU) -> DataFrame:
    """(document_id, g, p, iou), one to one: the best pair first, ties to the larger prediction, then gold index."""
    pairs = overlapping(gold, predicted, least)
    rows = pairs.groupBy("document_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("iou", "p", "g")))).alias("rows"))
    from .arbitrate import first_come

    kept = first_come(F.col("rows"), lambda x, y: (x["p"] == y["p"]) | (x["g"] == y["g"]))
    return rows.select("document_id", F.explode(kept).alias("m")).select("document_id", "m.g", "m.p", "m.iou")


def error_report(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold: (document_id, g, start, end, verdict, ids); predicted: (document_id, p, …, verdict, canonical_id) ->
    (document_id, g, p, error): missed, spurious, a wrong verdict, or a wrong id of a real one."""
    m = greedy_match(gold, predicted)
    g = gold.select("document_id", "g", F.col("verdict").alias("gold_verdict"), "ids")
    p = predicted.select("document_id", "p", F.col("verdict").alias("said"), "canonical_id")
    both = m.select("document_id", "g", "p").join(g, ["document_id", "g"]).join(p, ["document_id", "p"])
    wrong_id = (F.col("said") == "real") & F.coalesce(~F.array_contains("ids", F.col("canonical_id")), F.lit(True))
    error = F.when(F.col("gold_verdict") != F.col("said"), F.concat("gold_verdict", F.lit(" -> "), "said")).when(wrong_id, "wrong id")
    out = both.select("document_id", "g", "p", error.alias("error")).where("error is not null")
    missed = g.join(m, ["document_id", "g"], "left_anti").select("document_id", "g", F.lit(None).cast("int").alias("p"), F.lit("missed").alias("error"))
    spurious = p.join(m, ["document_id", "p"], "left_anti").select("document_id", F.lit(None).cast("int").alias("g"), "p", F.lit("spurious").alias("error"))
    return out.unionByName(missed).unionByName(spurious)


def f1_by_class(pairs: DataFrame, gold_col: str, said_col: str) -> DataFrame:
    """(class, tp, fp, fn, f1) of label pairs; a null side is a miss or a spurious one."""
    g, s = F.col(gold_col), F.col(said_col)
    rows = pairs.select(F.explode(F.array_distinct(F.array_compact(F.array(g, s)))).alias("class"), g.alias("g"), s.alias("s"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = F.col("class")
    t = rows.groupBy("class").agg(one(c.eqNullSafe(F.col("g")) & c.eqNullSafe(F.col("s"))).alias("tp"), one(~c.eqNullSafe(F.col("g"))).alias("fp"), one(~c.eqNullSafe(F.col("s"))).alias("fn"))
    return t.withColumn("f1", F.col("tp") * 2 / (F.col("tp") * 2 + F.col("fp") + F.col("fn")))


def calibration(pairs: DataFrame) -> DataFrame:
    """pairs: (evidence, confidence, ok 0/1) -> evidence, n, hit_rate, brier, bonus; bonus = 0.1 (1 - brier)."""
    return pairs.groupBy("evidence").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ok").alias("hit_rate"), F.avg(F.pow(F.col("confidence") - F.col("ok"), 2)).alias("brier")
    ).withColumn("bonus", (1 - F.col("brier")) * 0.1)


def violations(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """(document_id, citation_id, problem) of a run's output.

    documents: (document_id, raw); citations: document_id, citation_id, start, end, surface, kind, verdict, canonical_id, confidence.
    """
    c = citations.join(documents.select("document_id", "raw"), "document_id", "left")
    n = F.length("raw")
    place = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > n)
    slice_ = F.substring("raw", F.col("start") + 1, F.col("end") - F.col("start"))
    checks = {
        "no such document": F.col("raw").isNull(),
        "bad span": F.col("raw").isNotNull() & place,
        "surface differs": ~place & (F.coalesce(F.col("surface"), F.lit("")) != slice_),
        "unknown kind": ~F.coalesce(F.col("kind").isin(*fixed.KINDS), F.lit(False)),
        "unknown verdict": ~F.coalesce(F.col("verdict").isin(*fixed.VERDICTS), F.lit(False)),
        "real without id": (F.col("verdict") == "real") & F.col("canonical_id").isNull(),
        "id without real": (F.col("verdict") != "real") & F.col("canonical_id").isNotNull(),
        "id isn't digits": ~F.col("canonical_id").rlike("^[0-9]+$"),
        "bad confidence": F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1),
    }
    found = c.select("document_id", "citation_id", F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())))).alias("problem"))
    twice = citations.groupBy("document_id", "citation_id").count().where("count > 1").select("document_id", "citation_id", F.lit("repeated id").alias("problem"))
    rows = citations.select("document_id", F.col("citation_id").alias("g"), "start", "end")
    pairs = overlapping(rows, rows.withColumnRenamed("g", "p")).where("g < p").select("document_id", F.col("p").alias("citation_id"), F.lit("overlaps another").alias("problem"))
    return found.unionByName(twice).unionByName(pairs)


def file_problems(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, problem) of contract files: those that are missing, aren't JSON, name another document or no version, or have no document.

    documents: (document_id); files: (document_id, json), the id being the file's name.
    """
    d = documents.select(F.col("document_id").cast("string").alias("document_id"), F.lit(True).alias("wanted"))
    f = files.select("document_id", "json", F.lit(True).alias("there"))
    j = d.join(f, "document_id", "full")
    at = lambda p: F.get_json_object("json", p)
    broken = F.json_object_keys("json").isNull()
    checks = {
        "no file": F.col("wanted") & F.col("there").isNull(), "no document": F.col("there") & F.col("wanted").isNull(), "not JSON": F.col("there") & broken,
        "names another document": F.col("there") & ~broken & ~at("$.documento_id").eqNullSafe(F.col("document_id")), "no version": F.col("there") & ~broken & (F.coalesce(at("$.schema_version"), F.lit("")) == ""),
    }
    return j.select("document_id", F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())))).alias("problem"))


def solution(gold: DataFrame) -> DataFrame:
    """(documento_id, nivel, citacoes): start,end,class,ids joined by |, in order of g; ids joined by a colon, a dash for none."""
    ids = F.when(F.size("ids") > 0, F.array_join("ids", ":")).otherwise("-")
    one = F.concat_ws(",", F.col("start").cast("string"), F.col("end").cast("string"), "verdict", ids)
    rows = gold.groupBy("document_id").agg(F.max("level").alias("nivel"), F.array_sort(F.collect_list(F.struct("g", one.alias("s")))).alias("s"))
    return rows.select(F.col("document_id").alias("documento_id"), "nivel", F.array_join(F.transform("s", lambda x: x["s"]), "|").alias("citacoes"))


def external_score(solution_rows: DataFrame, submission_rows: DataFrame, path: str) -> dict:
    """The result of a metric given as a Python file with avaliar(solution, submission, row_id), over pandas frames of one row a document, sorted by id."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("external_metric", path)
    metric = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(metric)
    sol = solution_rows.orderBy("documento_id").toPandas()
    sub = solution_rows.select("documento_id").join(submission_rows, "documento_id", "left").fillna("-", ["citacoes"]).orderBy("documento_id").toPandas()
    return metric.avaliar(sol, sub, row_id="documento_id")


def verdict_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(level, class, tp, fp, fn, f1, macro_f1, tau) of matched citations; a verdict on an unmatched one counts as false.

    macro_f1 is the mean over the classes of a level; tau the share of invented citations that are called real.
    """
    m = greedy_match(gold, predicted).select("document_id", "g", "p")
    levels = gold.groupBy("document_id").agg(F.max("level").alias("level"))
    g = gold.select("document_id", "g", F.col("verdict").alias("gold"))
    p = predicted.select("document_id", "p", F.col("verdict").alias("said"))
    pairs = g.join(m, ["document_id", "g"], "left").join(p, ["document_id", "p"], "full").join(levels, "document_id", "left").select("level", "gold", "said")
    rows = pairs.select("level", "gold", "said", F.explode(F.array_distinct(F.array_compact(F.array("gold", "said")))).alias("class"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    is_gold, is_said = F.col("class").eqNullSafe(F.col("gold")), F.col("class").eqNullSafe(F.col("said"))
    t = rows.groupBy("level", "class").agg(n(is_gold & is_said).alias("tp"), n(~is_gold).alias("fp"), n(~is_said).alias("fn"))
    t = t.withColumn("f1", F.col("tp") * 2 / (F.col("tp") * 2 + F.col("fp") + F.col("fn")))
    invented = F.col("gold") == "inventada"
    of_level = t.groupBy("level").agg(F.avg("f1").alias("macro_f1"))
    tau = pairs.groupBy("level").agg(F.when(n(invented) > 0, n(invented & (F.col("said") == "real")) / n(invented)).otherwise(0.0).alias("tau"))
    return t.join(of_level, "level").join(tau, "level")


def span_scores(gold: DataFrame, predicted: DataFrame, least_score: float = 0.0, least: float = fixed.IOU) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of a tagger's spans: (document_id, p, start, end, score) against (document_id, g, start, end).

    Spans are matched one to one, the surest first, each to the free gold span it covers best (ties to the larger index).
    """
    from .arbitrate import first_come

    said = predicted.where(F.col("score") >= least_score)
    pairs = overlapping(gold, said, least).join(said.select("document_id", "p", "score"), ["document_id", "p"])
    order = F.struct((-F.col("score")).alias("minus"), "p", (-F.col("iou")).alias("far"), (-F.col("g")).alias("late"), "g")
    rows = pairs.groupBy("document_id").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    matched = rows.select(F.explode(first_come(F.col("rows"), lambda x, y: (x["p"] == y["p"]) | (x["g"] == y["g"]))).alias("m"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    n = count(matched, "tp").join(count(said, "said"), how="cross").join(count(gold, "gold"), how="cross")  # three single rows
    n = n.select("tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return n.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def counts_by_variant(variants: dict[str, DataFrame]) -> DataFrame:
    """(variant, a column for each verdict, total) of submissions."""
    rows = None
    for name, sub in variants.items():
        one = sub.where("citacoes <> '-'").select(F.lit(name).alias("variant"), F.explode(F.split("citacoes", r"\|")).alias("c"))
        rows = one if rows is None else rows.unionByName(one)
    said = rows.select("variant", F.element_at(F.split("c", ","), 3).alias("verdict")).groupBy("variant").pivot("verdict", list(fixed.VERDICTS)).agg(F.count(F.lit(1)))
    return said.fillna(0).withColumn("total", sum((F.col(v) for v in fixed.VERDICTS), F.lit(0)))
