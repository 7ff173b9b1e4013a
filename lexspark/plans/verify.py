"""The whole verification: documents and registry -> citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.operators.detect import find_candidates
from lexspark.operators.index import Index
from lexspark.operators.resolve import resolve


def verify(docs: DataFrame, index: Index, diffuse: bool = False, calibrated: bool = False, neutral: tuple[str, ...] = ()) -> DataFrame:
    """docs: (document_id, raw) -> a row a citation, numbered by place, in offsets of the raw text.

    Overlaps are settled before the lookups, as texts are read: they don't depend on them,
    and fewer rows are joined.  Texts are read once, for ``resolve`` writes what it looks up.
    """
    found = resolve(find_candidates(docs, diffuse, neutral, settled=True), index, calibrated)
    return found.select(
        "document_id", F.concat(F.lit("c"), "place").alias("citation_id"), F.col("raw_start").alias("start"), F.col("raw_end").alias("end"), F.col("raw_surface").alias("surface"),
        "kind", "verdict", "canonical_id", F.round("confidence", 4).alias("confidence"), "evidence", "signals",
    )


def contract(docs: DataFrame, citations: DataFrame) -> DataFrame:
    """(document_id, json): the output contract, a row a document, those without citations too."""
    resolution = F.when(F.col("canonical_id").isNotNull(), F.struct(F.lit(fixed.CONTRACT_SOURCE).alias("fonte"), F.col("canonical_id").alias("id_canonico")))
    s = F.col("signals")
    names = {"n_digitos": "n_digits", "tem_uf": "has_uf", "n_variantes": "n_readings", "ruidoso": "noisy", "cnj": "cnj", "n_tokens_classe": "class_words", "largura": "width", "camada": "layer", "n_cand": "n_records"}
    signals = F.struct(*(s[v].alias(k) for k, v in names.items()))
    one = F.struct(
        F.col("citation_id").alias("id"), F.col("start").alias("inicio"), F.col("end").alias("fim"), F.col("surface").alias("trecho"), F.col("kind").alias("tipo"),
        F.col("verdict").alias("classificacao"), resolution.alias("resolucao"), F.col("confidence").alias("confianca"), F.col("evidence").alias("evidencia"), signals.alias("sinais"),
    )
    made = citations.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", one.alias("c")))).alias("cs"))
    d = docs.select(F.col("document_id").cast("string").alias("document_id")).join(made, "document_id", "left")
    cs = F.transform(F.coalesce("cs", F.array().cast(made.schema["cs"].dataType)), lambda x: x["c"])
    return d.select("document_id", F.to_json(F.struct(F.lit(fixed.CONTRACT_VERSION).alias("schema_version"), F.col("document_id").alias("documento_id"), cs.alias("citacoes"))).alias("json"))


def submission(docs: DataFrame, citations: DataFrame) -> DataFrame:
    """(documento_id, citacoes): start,end,class,id,confidence joined by |, a dash for what is missing."""
    one = F.concat_ws(",", "start", "end", "verdict", F.coalesce("canonical_id", F.lit("-")), F.coalesce(F.format_string("%.4f", "confidence"), F.lit("-")))
    made = citations.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", one.alias("s")))).alias("s"))
    d = docs.select(F.col("document_id").cast("string").alias("document_id")).join(made, "document_id", "left")
    return d.select(F.col("document_id").alias("documento_id"), F.coalesce(F.concat_ws("|", F.transform("s", lambda x: x["s"])), F.lit("")).alias("t")).select("documento_id", F.when(F.col("t") == "", "-").otherwise(F.col("t")).alias("citacoes"))


def submission_counts(rows: DataFrame) -> DataFrame:
    """Citations by verdict, read back from a submission."""
    one = F.explode(F.split("citacoes", r"\|")).alias("c")
    return rows.where("citacoes <> '-'").select(one).groupBy(F.element_at(F.split("c", ","), 3).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))

