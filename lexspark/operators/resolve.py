"""Resolution: candidates that stay are looked up in the registry's tables by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.functions import spans
from lexspark.functions import text as T
from lexspark.shared import written

from .index import Index, records_of

CITATION = ["document_id", "start", "end", "surface", "kind", "verdict", "canonical_id", "confidence", "evidence", "signals"]
_ID = ["document_id", "family", "seq"]


def looked_up(candidates: DataFrame, index: Index) -> DataFrame:
    """candidates, a row a reading of a case's number, a row any other, with its place (reading) and what the registry has under it: layer, ids.

    A number finds all its records at once, so a row moves once and the state is told apart
    where it has arrived; rows without a number move to no common place.
    """
    numbers = F.when(F.col("family") == spans.CASE, F.transform("readings", lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")))
    c = candidates.select("*", F.posexplode_outer(numbers).alias("reading", "own"))
    c = c.withColumn("number_", F.coalesce("own", F.concat(F.lit("-"), F.xxhash64(*_ID, "start").cast("string")))).drop("own")
    met = c.join(index.numbers.withColumnRenamed("number", "number_"), "number_", "left")
    return met.withColumn("hit", F.when(F.col("records").isNotNull(), records_of(F.col("number_"), F.col("uf")))).select(*c.columns, "hit.*").drop("number_")


def case_hits(rows: DataFrame, index: Index) -> DataFrame:
    """rows of looked_up that found something -> _ID, ids, layer, canonical_id.

    Own numbers come before secondary ones, a reading before the next.  Of several records
    the one whose class is closest stays, ties to the smallest id.
    """
    hits = rows.groupBy(*_ID).agg(F.min_by(F.struct("ids", "layer", "surface"), F.struct("layer", "reading")).alias("h")).select(*_ID, "h.*")
    several = hits.where("size(ids) > 1").select(*_ID, "layer", "ids", "surface", F.explode("ids").alias("id")).join(index.meta, "id", "left")
    # words are taken once a row: inside of the measure they would be taken again for each word
    words = several.withColumns({"said": T.class_tokens(F.col("surface")), "headed": T.class_tokens(F.coalesce("header_class", F.lit("")))})
    close = words.withColumn("close", T.multiset_jaccard(F.col("said"), F.col("headed")))
    best = close.groupBy(*_ID).agg(F.first("ids").alias("ids"), F.first("layer").alias("layer"), F.min_by("id", F.struct(-F.col("close"), F.col("id").cast("long"))).alias("canonical_id"))
    return hits.where("size(ids) = 1").select(*_ID, "ids", "layer", F.element_at("ids", 1).alias("canonical_id")).unionByName(best)


def _settled_by_more(rows: DataFrame, index: Index) -> DataFrame:
    """rows of looked_up that need more than their number, a row a candidate: with lookup, bare, found and, for cases, ids, layer, canonical_id."""
    hits = case_hits(rows.where("ids is not null"), index)
    bare = index.sumulas.select(F.element_at(F.split("key", r"\|"), -1).alias("number"), "id").groupBy("number").agg(F.collect_set("id").alias("bare"))
    sumula_key = F.when(F.col("binding"), F.concat(F.lit("STF|SV|"), "number")).when(F.col("court").isNotNull(), F.concat("court", F.lit("|"), "number"))
    c = rows.where("reading is null or reading = 0").drop("reading", "ids", "layer").withColumn("lookup", F.when(F.col("family") == spans.STATUTE, F.concat("alias", F.lit("|"), "article")).when(F.col("family") == spans.SUMULA, sumula_key))
    # only those that have a key of a kind meet its table, by narrow rows; then all that was found meets the candidates at once
    keyed = lambda family, table: c.where((F.col("family") == family) & F.col("lookup").isNotNull()).select(*_ID, F.col("lookup").alias("key")).join(table.select("key", F.col("id").alias("found")), "key").drop("key")
    by_number = c.where((F.col("family") == spans.SUMULA) & F.col("lookup").isNull()).select(*_ID, "number").join(bare, "number").drop("number")
    met = hits.unionByName(keyed(spans.STATUTE, index.statutes), True).unionByName(keyed(spans.SUMULA, index.sumulas), True).unionByName(by_number, True)
    return c.join(met, _ID, "left").drop("more")


def resolve(candidates: DataFrame, index: Index, calibrated: bool = False) -> DataFrame:
    """One row a candidate: CITATION, plus family and seq.  A key that isn't in the registry makes a citation ``inventada``.

    What the numbers found is written, since it is read several times: candidates and the
    registry's headings are read once, and cases of one reading and one record are settled there.
    """
    more = F.col("family").isin(spans.STATUTE, spans.SUMULA) | (F.col("family") == spans.CASE) & ((F.size("readings") != 1) | (F.coalesce(F.size("ids"), F.lit(0)) > 1))
    rows = written(looked_up(candidates, index).withColumn("more", F.coalesce(more, F.lit(False))))
    c, rest = rows.where("not more").drop("more", "reading").withColumn("canonical_id", F.element_at("ids", 1)), rows.where("more")
    c = c.withColumns({"lookup": F.lit(None).cast("string"), "found": F.lit(None).cast("string"), "bare": F.lit(None).cast("array<string>")})
    if not rest.isEmpty():
        c = c.unionByName(_settled_by_more(rest, index))
    of = lambda f: F.col("family") == f
    unkeyed = of(spans.SUMULA) & F.col("lookup").isNull()
    n_bare = F.coalesce(F.size("bare"), F.lit(0))
    found = F.when(of(spans.CASE), F.col("canonical_id")).when(unkeyed, F.when(n_bare == 1, F.element_at("bare", 1))).otherwise(F.col("found"))
    verdict = F.when(of(spans.VAGUE), "incompleta").when(unkeyed & (n_bare > 1), "incompleta").when(found.isNotNull(), "real").otherwise("inventada")
    uf = F.col("uf").isNotNull()
    evidence = (
        F.when(of(spans.VAGUE), "vaga").when(of(spans.STATUTE), "lei").when(of(spans.SUMULA), "sumula").when(of(spans.TOPIC), "tema")
        .when(F.size("ids") > 1, "duplicata").when(F.col("noisy"), "ruidoso")
        .when(F.col("n_digits") >= fixed.CNJ_DIGITS, F.when(uf, "cnj_uf").otherwise("cnj")).otherwise(F.when(uf, "num_uf").otherwise("num"))
    )
    signals = F.when(of(spans.CASE), F.struct(
        F.col("n_digits"), uf.cast("int").alias("has_uf"), F.size("readings").alias("n_readings"), F.col("noisy").cast("int").alias("noisy"),
        (F.col("n_digits") >= fixed.CNJ_DIGITS).cast("int").alias("cnj"), F.col("class_words"), (F.col("end") - F.col("start")).alias("width"),
        F.when(F.col("layer") == 0, "primaria").otherwise("secundaria").alias("layer"), F.coalesce(F.size("ids"), F.lit(0)).alias("n_records"),
    ))
    table = F.create_map(*(F.lit(x) for kv in fixed.CONFIDENCE.items() for x in kv))
    out = c.withColumns({"evidence_": evidence, "verdict_": verdict, "found_": found, "signals_": signals})
    return out.select(
        "document_id", "family", "seq", "start", "end", "surface", "kind", F.col("verdict_").alias("verdict"), F.col("found_").alias("canonical_id"),
        (table[F.col("evidence_")] if calibrated else F.lit(1.0)).alias("confidence"), F.col("evidence_").alias("evidence"), F.col("signals_").alias("signals"),
        *(x for x in ("raw_start", "raw_end", "raw_surface", "place") if x in candidates.columns),
    )
