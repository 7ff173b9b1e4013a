"""Queries do the whole job: no row, text or step is left out."""

import pytest
from pyspark.sql import functions as F

from lexspark import catalog, fixed
from lexspark.operators import index, synth, tagger
from lexspark.plans.verify import verify


@pytest.fixture(scope="module")
def keys(spark, tmp_path_factory):
    """parts and suppliers on both sides of the former limits, up to five-digit articles."""
    sf = str(tmp_path_factory.mktemp("sf"))
    parts = [*range(12), *range(5990, 6012), 19999, 59993, 59994, 199999]
    spark.createDataFrame([(k,) for k in parts], "p_partkey long").write.parquet(f"{sf}/part.parquet")
    spark.createDataFrame([(k,) for k in [*range(10), *range(1990, 2010), 9999]], "s_suppkey long").write.parquet(f"{sf}/supplier.parquet")
    return sf, parts


def test_statute_verdicts_of_all_parts(spark, keys):
    sf, parts = keys
    out = {int(r.document_id): (r.verdict, r.canonical_id) for r in catalog.QUERIES["statute_verdicts"](spark, sf).collect()}
    assert out == {k: ("real", str(k + 9000000000)) if k % 5 else ("inventada", None) for k in parts}


@pytest.mark.parametrize("name", ["sumula_verdicts", "sumula_bare_ambiguous"])
def test_sumulas_of_all_suppliers(spark, keys, name):
    import duckdb

    sql = catalog.ORACLES[name]
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{keys[0]}/supplier.parquet/*.parquet'")
    want = con.execute(sql).fetchall()
    got = [(r.document_id, r.verdict, r.canonical_id) for r in catalog.QUERIES[name](spark, keys[0]).collect()]
    assert len(want) == 31 and sorted(got, key=repr) == sorted(want, key=repr)


def test_ocr_noise_counts_whole_texts(spark, tmp_path):
    texts = ["x" * 600 + "e" * 4000, "x" * 600, "", None, "Lorem ipsum dolor sit amet, eram 123. " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    edits = {r.doc_id: r.edits for r in catalog.QUERIES["ocr_noise"](spark, str(tmp_path)).collect()}
    noisy = {r.doc_id: r for r in synth.add_noise(spark.read.parquet(f"{tmp_path}/documents.parquet")).withColumn("exact", F.levenshtein("text", "noisy")).collect()}
    assert edits[0] > 40 and edits[1] == 0 and not edits[2] and edits[3] is None
    assert edits[0] == noisy[0].noisy[600:].count("c") and noisy[0].noisy[:600] == "x" * 600 and len(noisy[0].noisy) == 4600
    assert 0 < edits[4] == noisy[4].exact


def test_near_texts_reads_past_the_opening(spark, tmp_path):
    opening = "a mesma abertura de sessenta letras em todos os textos da lista "
    texts = [opening + "b" * 200, opening + "c" * 200, "x" * 20 + opening[20:] + "b" * 200, "b" * 50]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.item_id, r.other) for r in catalog.QUERIES["near_sentences"](spark, str(tmp_path)).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 2), (2, 0)}


def test_merge_resolves_what_the_tagger_adds(spark):
    raw = "Conforme o REsp nº 1.234.567/SP e mais nada disso aqui escrito, ver processo 7.654.321 do acervo."
    docs = spark.createDataFrame([("d", raw)], "document_id string, raw string")
    head = "RECURSO ESPECIAL Nº {} - SP (2020)\nEMENTA"
    registry = spark.createDataFrame([(str(i), None, "acordao", head.format(n)) for i, n in ((70, "1.234.567"), (71, "7.654.321"))], "id string, court string, nature string, text string")
    idx = index.build(registry)
    rules = verify(docs, idx).where("canonical_id = '70'")
    at = lambda x: (raw.index(x), raw.index(x) + len(x))
    spans = [("d", *at("aqui escrito, ver processo"), "JUR", 0.99), ("d", *at("processo 7.654.321"), "JUR", 0.95), ("d", *at("nº 1.234.567"), "JUR", 0.99)]
    tagged = spark.createDataFrame(spans, "document_id string, start int, end int, label string, score double")
    out = [tuple(r) for r in tagger.merge(docs, rules, tagged, idx, calibrated=True).orderBy("start").select("citation_id", "verdict", "canonical_id", "evidence", "surface").collect()]
    assert out == [("c1", "real", "70", "num_uf", "REsp nº 1.234.567/SP"), ("c2", "real", "71", "ner:num", "processo 7.654.321")]
    c2 = tagger.features(tagger.merge(docs, rules, tagged, idx, calibrated=True)).where("citation_id = 'c2'").first()
    assert c2.confidence == round(fixed.CONFIDENCE["num"] * 0.85, 4) and c2.features[-2] == 1.0


def test_noise_has_all_confusions(spark):
    texts = spark.createDataFrame([("eciltaosOSundm",), ("arno",), ("rrnrn",), ("123 xyz",)] + [(f"x x {k}",) for k in range(100)], "text string")
    out = {r.text: r for r in synth.add_noise(texts, 1.0).withColumn("exact", F.levenshtein("text", "noisy")).collect()}
    assert out["eciltaosOSundm"].noisy == "celilãõ505üñclrn"
    assert out["arno"].noisy == "ãmõ" and out["rrnrn"].noisy == "rmm" and out["arno"].edits == out["arno"].exact == 4
    assert out["123 xyz"].noisy.replace("  ", " ") == "123 xyz"
    assert 3 <= sum("  " in r.noisy for r in out.values()) <= 35 and all(r.noisy.count("  ") <= 1 for r in out.values())


@pytest.mark.parametrize("name", ["sumula_verdicts", "sumula_bare_ambiguous", "sumula_forms"])
def test_sumulas_whose_numbers_have_more_than_four_digits(spark, tmp_path, name):
    import duckdb

    spark.range(49_980, 50_020).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    cols = ", ".join(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, con.execute(f"select {cols} from ({catalog.ORACLES[name]})").fetchall()))
