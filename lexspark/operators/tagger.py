"""Around an external span tagger: windows, tag decoding, fusion with the rules' citations, a simulated tagger, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.shared import written

from .arbitrate import first_come
from .index import Index
from .resolve import resolve


def windows(docs: DataFrame, size: int = 900, step: int = 700) -> DataFrame:
    """(document_id, window, start, end, text): the last window ends with the text; a short text is one window; no windows of empty texts."""
    n = F.length("raw")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), n, F.lit(step)), lambda s: s + size < n), F.array(n - size))))
    w = docs.where(n > 0).select("document_id", "raw", F.posexplode(starts).alias("window", "start"))
    return w.select("document_id", "window", "start", F.least(F.col("start") + size, F.length("raw")).alias("end"), F.substring("raw", F.col("start") + 1, F.lit(size)).alias("text"))


def label_windows(w: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities (document_id, start, end, label) wholly inside a window, in the window's offsets."""
    e = entities.select("document_id", F.col("start").alias("es"), F.col("end").alias("ee"), "label")
    inside = w.join(e, "document_id").where("es >= start and ee <= end")
    return inside.select("document_id", "window", (F.col("es") - F.col("start")).alias("start"), (F.col("ee") - F.col("start")).alias("end"), "label")


def decode_tags(tokens: DataFrame) -> DataFrame:
    """tokens: (document_id, position, start, end, tag, score) -> (document_id, start, end, label, score).

    B- starts a span, I- of the same type continues it, anything else closes it; I-
    without such a span starts none.  The score is the mean of the tokens'.
    """
    w = Window.partitionBy("document_id").orderBy("position")
    t = tokens.withColumns({"mark": F.substring("tag", 1, 1), "type": F.substring("tag", 3, 8)})
    begins = (F.col("mark") == "B") | (F.col("mark") == "O")
    broken = F.coalesce((F.col("mark") == "I") & (F.lag("type").over(w) != F.col("type")), F.col("mark") == "I")
    t = t.withColumn("run", F.sum((begins | broken).cast("int")).over(w))
    spans = t.groupBy("document_id", "run").agg(F.min_by("mark", "position").alias("first"), F.min("type").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"))
    return spans.where("first = 'B'").select("document_id", "start", "end", "label", "score")


def _touches(x: Column, y: Column) -> Column:
    return (x["end"] > y["start"]) & (x["start"] < y["end"])


def _legacy(x: Column, y: Column) -> Column:
    from lexspark.functions.text import iou

    inside = (x["start"] >= y["start"]) & (x["end"] <= y["end"])
    return (iou(x["start"], x["end"], y["start"], y["end"]) >= fixed.IOU) | inside


def fuse(citations: DataFrame, tagged: DataFrame, strict: bool = True, least: float = fixed.FUSION_SCORE) -> DataFrame:
    """Spans of the tagger that join the citations: (document_id, start, end, label, score).

    Spans come in order of place.  Strict: a span that touches a citation, or an
    accepted span, goes; else only one that nearly equals or lies inside of one.
    """
    hit = _touches if strict else _legacy
    rows = tagged.where(F.col("score") >= least).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("t"))
    taken = citations.groupBy("document_id").agg(F.collect_list(F.struct("start", "end")).alias("c"))
    r = rows.join(taken, "document_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<start:int,end:int>>")))
    free = r.withColumn("t", F.filter("t", lambda s: ~F.exists("c", lambda k: hit(s, k))))
    return free.select("document_id", F.explode(first_come(F.col("t"), hit)).alias("s")).select("document_id", "s.*")


def classify_spans(docs: DataFrame, spans: DataFrame, margin: int = fixed.FUSION_MARGIN, strict: bool = True) -> DataFrame:
    """Candidates for spans that a tagger gave, read with a margin on both sides, as surface.

    Strict: those that alone name nothing are dropped unless vague.  own_bare is the
    number of a súmula without a court that a span alone names.
    """
    from .detect import SCHEMA, arrow_types

    s = spans.join(docs.select("document_id", "raw"), "document_id").select(
        "document_id", "start", "end", F.substring("raw", F.col("start") + 1, F.col("end") - F.col("start")).alias("own"),
        F.substring("raw", F.greatest(F.col("start") - margin, F.lit(0)) + 1, F.col("end") + margin - F.greatest(F.col("start") - margin, F.lit(0))).alias("wide"),
    )

    schema = SCHEMA + ", own_bare string"
    names = schema.replace(",", "").split()[::2]

    def run(batches):
        import pyarrow as pa

        from lexspark.functions.spans import SUMULA, VAGUE, single, vague

        for b in batches:
            rows = []
            for doc, start, end, own, wide in zip(*(x.to_pylist() for x in b.columns), strict=True):
                alone = single(own)
                named = not strict or alone.family != VAGUE or any(z - a >= fixed.VAGUE_SHARE * len(own.strip()) for a, z, _ in vague(own))
                if named:
                    c = single(wide)
                    bare = alone.number if alone.family == SUMULA and not alone.binding and alone.court is None else None
                    rows.append((doc, start, c.family, start, end, wide, c.kind, c.alias, c.article, c.number, c.court, c.binding, c.readings, c.uf, c.n_digits, c.noisy, c.class_words, start, end, own, bare))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, arrow_types(schema), strict=True)], names)

    return s.mapInArrow(run, schema.replace(" end ", " `end` "))


def merge(docs: DataFrame, citations: DataFrame, tagged: DataFrame, index: Index, strict: bool = True, calibrated: bool = False, least: float = fixed.FUSION_SCORE) -> DataFrame:
    """The rules' citations and those that the tagger adds, numbered by place; added ones have evidence ``ner:*`` and no signals.

    A span that names nothing, or alone stays ambiguous, blocks no other: spans are read first and folded then.
    ``citations`` and the index are read twice; write them first if they cost much.
    """
    spans = tagged.where(F.col("score") >= least).groupBy("document_id", "start", "end").agg(F.max_by("label", "score").alias("label"), F.max("score").alias("score"))
    read = written(classify_spans(docs, spans, strict=strict))
    if strict:
        several = index.sumulas.select(F.element_at(F.split("key", r"\|"), -1).alias("own_bare"), "id").groupBy("own_bare").agg(F.count_distinct("id").alias("n")).where("n > 1")
        read = read.where("own_bare is null").unionByName(read.where("own_bare is not null").join(several, "own_bare", "left_anti"))
    at = ["document_id", "start", "end"]
    added = fuse(citations, read.select(*at).join(spans, at), strict, least).select(*at)
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("start", "end"))
    found = resolve(read.join(added, at).withColumn("seq", order), index)
    evidence = F.regexp_replace("evidence", "^cnj", "num")
    table = F.create_map(*(F.lit(x) for kv in fixed.CONFIDENCE.items() for x in kv))
    confidence = F.round(table[evidence] * fixed.FUSION_FACTOR, 4) if calibrated else F.lit(1.0)
    new = found.select(
        "document_id", F.col("raw_start").alias("start"), F.col("raw_end").alias("end"), F.col("raw_surface").alias("surface"), "kind", "verdict", "canonical_id",
        confidence.alias("confidence"), F.concat(F.lit("ner:"), evidence).alias("evidence"), F.lit(None).cast(citations.schema["signals"].dataType).alias("signals"),
    )
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("start", "end"))
    both = citations.select(new.columns).unionByName(new)
    return both.select("document_id", F.concat(F.lit("c"), number).alias("citation_id"), *new.columns[1:])


def simulate(gold: DataFrame, recall: float = 0.85, noise: float = 0.05, seed: int = 3) -> DataFrame:
    """A simulated tagger: keeps gold spans by a hash of their place, shifts their ends by up to two, adds spurious copies further on."""
    h = lambda i: F.pmod(F.xxhash64("document_id", "start", "end", F.lit(seed), F.lit(i)), F.lit(1_000_000)) / 1_000_000
    label = F.when(F.col("kind") == "lei", "LEI").otherwise("JUR")
    kept = gold.where(h(0) < recall).select("document_id", F.greatest(F.lit(0), F.col("start") + F.floor(h(1) * 5).cast("int") - 2).alias("start"), (F.col("end") + F.floor(h(2) * 3).cast("int")).alias("end"), label.alias("label"), (0.9 + h(3) / 10).alias("score"))
    spurious = gold.where(h(4) < noise).select("document_id", (F.col("end") + 5).alias("start"), (F.col("end") + 25).alias("end"), label.alias("label"), (0.5 + h(5) / 2).alias("score"))
    return kept.unionByName(spurious)


EVIDENCES = tuple(fixed.CONFIDENCE)


def features(citations: DataFrame) -> DataFrame:
    """citations with features: ten evidence flags, eight numbers, two layer flags, a tagger flag, and length / 50."""
    s = F.col("signals")
    number = lambda n: F.coalesce(s[n].cast("double"), F.lit(0.0))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    plain = F.regexp_replace("evidence", "^ner:", "")
    cols = [flag(plain == e) for e in EVIDENCES] + [number(n) for n in ("n_digits", "has_uf", "n_readings", "noisy", "cnj", "class_words", "width", "n_records")]
    cols += [flag(s["layer"] == "primaria"), flag(s["layer"] == "secundaria"), flag(F.col("evidence").startswith("ner:")), (F.col("end") - F.col("start")) / 50.0]
    return citations.withColumn("features", F.array(*cols))


def logistic_scores(rows: DataFrame, coefficients: list[float], intercept: float) -> DataFrame:
    """rows with features -> score in [0.001, 0.999]."""
    z = F.lit(float(intercept))
    for i, c in enumerate(coefficients):
        z = z + F.element_at("features", i + 1) * float(c)
    return rows.withColumn("score", F.least(F.lit(0.999), F.greatest(F.lit(0.001), 1 / (1 + F.exp(-z)))))


def train_calibration(rows: DataFrame, label: str = "ok", c: float = 1.0, max_iter: int = 2000) -> tuple[list[float], float]:
    """L2-regularised logistic regression of ``label`` on features; one class alone gives a constant."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    t = rows.select(array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label"))
    x = t.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    size = rows.select(F.size("features").alias("n")).first()
    if not x["n"] or x["ones"] in (0.0, float(x["n"])):
        return [0.0] * (size["n"] if size else 0), 30.0 if x["n"] and x["ones"] else -30.0
    m = LogisticRegression(regParam=1 / (c * x["n"]), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(t)
    return list(m.coefficients), float(m.intercept)


def label(docs: DataFrame, make_labeller, size: int = 900, step: int = 700, batch: int = 8) -> DataFrame:
    """Spans (document_id, start, end, label, score) that a tagger gives, in offsets of the raw text.

    ``make_labeller()`` runs once a worker and returns a function from a list of texts to
    a list of lists of (start, end, label, score).  It reads windows of normalised texts,
    ``batch`` at a time; spans of overlapping windows are settled by suppression, best first.
    """
    from lexspark.functions import text as T

    from .arbitrate import suppress

    n = docs.select("document_id", T.normalised(F.col("raw")).alias("n"))
    w = windows(n.select("document_id", F.col("n.proc").alias("raw")), size, step).select("document_id", "start", "text")

    def run(batches):
        import pandas as pd

        labeller = make_labeller()
        for b in batches:
            rows = []
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                for doc, at, found in zip(part["document_id"], part["start"], labeller(list(part["text"])), strict=True):
                    rows += [(doc, at + s, at + e, name, float(score)) for s, e, name, score in found]
            yield pd.DataFrame(rows, columns=["document_id", "start", "end", "label", "score"])

    found = suppress(w.mapInPandas(run, "document_id string, start int, `end` int, label string, score double"))
    s, e = T.raw_span(F.col("n"), F.col("start"), F.col("end"))
    return found.join(n, "document_id").select("document_id", s.alias("start"), e.alias("end"), "label", "score")


def fusion_report(fused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What fusion would add: (document_id, start, end, verdict, surface), and (added, rules, percent)."""
    tagged = F.col("evidence").startswith("ner:")
    added = fused.where(tagged).select("document_id", "start", "end", "verdict", "surface")
    n = fused.agg(F.count_if(tagged).alias("added"), F.count_if(~tagged).alias("rules"))
    return added, n.withColumn("percent", F.col("added") * 100 / F.greatest(F.col("rules"), F.lit(1)))


def degradation(docs: DataFrame, citations: DataFrame, gold: DataFrame, index: Index, dropped=fixed.DROPPED, spurious=fixed.SPURIOUS, recall: float = 0.90, seed: int = 11) -> DataFrame:
    """(dropped, spurious, rules, fused): the share of gold citations found with the right verdict, with and without a simulated tagger.

    For each point of the grid a share of the rules' citations is dropped and a tagger
    that reads the truth with some noise is merged in.  All points run in one plan: a
    point is part of the document's id.
    """
    grid = docs.sparkSession.createDataFrame([(f"{i}/{j}", float(d), float(s)) for i, d in enumerate(dropped) for j, s in enumerate(spurious)], "point string, dropped double, spurious double")
    at = lambda df: df.join(grid, how="cross").withColumn("document_id", F.concat("point", F.lit(":"), "document_id"))  # noqa: E731, the grid has a row a point
    h = lambda what, *key: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *key), F.lit(1 << 30)) / (1 << 30)
    left = at(citations).where(h("drop", "document_id", "start") >= F.col("dropped"))
    place = ["document_id", "start"]
    g = at(gold.join(docs.select("document_id", F.length("raw").alias("n")), "document_id"))
    shift = lambda what, low, width: F.floor(h(what, *place) * width).cast("int") + low
    seen = g.where(h("recall", *place) <= recall).select("document_id", F.greatest(F.lit(0), F.col("start") + shift("start", -3, 6)).alias("start"), F.least(F.col("n"), F.col("end") + shift("end", -2, 6)).alias("end"), F.lit("JUR").alias("label"), (0.88 + h("score", *place) * 0.119).alias("score"))
    random = F.floor(h("where", *place) * F.greatest(F.lit(1), F.col("n") - 40)).cast("int")
    false = g.where(h("false", *place) < F.col("spurious")).select("document_id", random.alias("start"), (random + 8 + F.floor(h("long", *place) * 28).cast("int")).alias("end"), F.lit("JUR").alias("label"), (0.85 + h("sure", *place) * 0.12).alias("score"))
    base = left.select(citations.columns)
    fused = merge(at(docs.select("document_id", "raw")).select("document_id", "raw"), base, seen.unionByName(false), index)
    truth = g.select("document_id", "point", "g", "start", "end", "verdict")

    def right(c: DataFrame, name: str) -> DataFrame:
        from .evaluate import greedy_match

        p = c.withColumn("p", F.col("start")).select("document_id", "p", "start", "end", F.col("verdict").alias("said"))
        m = greedy_match(truth.select("document_id", "g", "start", "end"), p).select("document_id", "g", "p").join(p.select("document_id", "p", "said"), ["document_id", "p"])
        met = truth.select("document_id", "point", "g", "verdict").join(m, ["document_id", "g"], "left")
        return met.groupBy("point").agg(F.avg(F.coalesce((F.col("said") == F.col("verdict")).cast("int"), F.lit(0))).alias(name))

    return grid.join(right(base, "rules"), "point").join(right(fused, "fused"), "point").drop("point")


def calibration_report(rows: DataFrame, label: str = "ok") -> DataFrame:
    """(n, hit_rate, brier_before, brier_after, bonus_before, bonus_after): confidence as it was, and the score of a fitted model."""
    brier = lambda c: F.avg(F.pow(F.col(c) - F.col(label), 2))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("hit_rate"), brier("confidence").alias("brier_before"), brier("score").alias("brier_after"))
    return r.select("*", ((1 - F.col("brier_before")) * 0.1).alias("bonus_before"), ((1 - F.col("brier_after")) * 0.1).alias("bonus_after"))
