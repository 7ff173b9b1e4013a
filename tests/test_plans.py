"""Index, resolution, arbitration, output and evaluation on small tables."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import evaluate, index, synth, tagger
from lexspark.plans import verify as V
from lexspark.sources import files

REGISTRY = [
    ("a", 7000000001, "STJ", 2021, None, "acordao", "jurisprudencia", "RECURSO ESPECIAL Nº 1.234.567 - SP (2020/0123456-7)\nEMENTA"),
    ("b", 7000000002, "STJ", None, None, "sumula", "jurisprudencia", "Súmula n. 7 do STJ A pretensão"),
    ("c", 7000000003, None, None, None, "dispositivo", "lei", "Artigo 157 do Decreto-Lei nº 2.848, de 7 de dezembro de 1940\nRoubo"),
]
TEXT = "Vejam-se o REsp nº 1.234.567/SP, o art. 157 do Código Penal e a Súmula 7 do STJ. Já o AREsp nº 9.876.543/RJ e o art. 999 do Código Penal não."
EXPECTED = [("real", "7000000001"), ("real", "7000000003"), ("real", "7000000002"), ("inventada", None), ("inventada", None)]


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "registry.db")
    con = sqlite3.connect(path)
    con.execute("create table documentos (documento_id text primary key, id integer, tribunal text, ano integer, relator text, natureza text, tipo text, texto text)")
    con.executemany("insert into documentos values (?,?,?,?,?,?,?,?)", REGISTRY)
    con.commit()
    con.close()
    return files.read_registry(spark, path)


def test_end_to_end(spark, registry, tmp_path):
    (tmp_path / "d1.txt").write_bytes(TEXT.encode())
    (tmp_path / "d2.txt").write_bytes(("﻿" + TEXT.replace(". ", ".\r\n")).encode())
    (tmp_path / "d3.txt").write_bytes(b"nada")
    docs = files.read_texts(spark, str(tmp_path))
    files.write_index(index.build(registry), str(tmp_path / "index"))
    c = V.verify(docs, files.read_index(spark, str(tmp_path / "index"))).cache()
    for d in ("d1", "d2"):
        assert [(r.verdict, r.canonical_id) for r in c.where(F.col("document_id") == d).orderBy("start").collect()] == EXPECTED
    raw = {r.document_id: r.raw for r in docs.collect()}
    assert all(raw[r.document_id][r.start : r.end] == r.surface for r in c.collect())
    assert evaluate.violations(docs, c).count() == 0
    s = V.submission(docs, c)
    files.write_submission(s, str(tmp_path / "submission"))
    back = spark.read.csv(str(tmp_path / "submission"), header=True, quote='"', escape='"')
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.collect())) and {r.documento_id: r.citacoes for r in s.collect()}["d3"] == "-"
    assert {r.verdict: r.n for r in V.submission_counts(s).collect()} == {"real": 6, "inventada": 4}
    files.write_contract_files(V.contract(docs, c), str(tmp_path / "json"))
    assert sorted(p.name for p in (tmp_path / "json").iterdir() if not p.name.startswith(".")) == ["d1.json", "d2.json", "d3.json"]
    assert files.read_contract(spark, str(tmp_path / "json")).count() == 10


def test_bare_and_binding_sumulas(spark):
    r = spark.createDataFrame([("1", "STF", "sumula", "Súmula Vinculante n. 10 do STF x"), ("2", "STJ", "sumula", "Súmula n. 10 do STJ x"), ("3", "TST", "sumula", "Súmula n. 5 do TST x")], "id string, court string, nature string, text string")
    docs = spark.createDataFrame([("a", "Súmula Vinculante 10."), ("b", "Súmula 10 aplica-se."), ("c", "Súmula 5 aplica-se."), ("d", "súmula 10 do stj."), ("e", "Súmula 99.")], "document_id string, raw string")
    got = {x.document_id: (x.verdict, x.canonical_id) for x in V.verify(docs, index.build(r)).collect()}
    assert got == {"a": ("real", "1"), "b": ("incompleta", None), "c": ("real", "3"), "d": ("inventada", None), "e": ("inventada", None)}


def test_text_columns(spark):
    d = spark.createDataFrame([("São  Paulo, Nº 1",), (None,), ("",)], "s string")
    got = [tuple(r) for r in d.select(T.phrase(F.col("s")), T.digits(F.col("s")), T.number_key(F.lit("000"), F.lit("sp"))).collect()]
    assert got == [("sao paulo nº 1".replace("nº", "n"), "1", "0|SP"), (None, None, "0|SP"), ("", "", "0|SP")]
    a, b = F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "ab"))
    assert d.select(T.multiset_jaccard(a, b)).first()[0] == pytest.approx(2 / 3)


def test_windows_and_labels(spark):
    d = spark.createDataFrame([("a", "x" * 2000), ("b", "y"), ("c", "")], "document_id string, raw string")
    w = tagger.windows(d)
    assert sorted((r.document_id, r.start, r.end) for r in w.collect()) == [("a", 0, 900), ("a", 700, 1600), ("a", 1100, 2000), ("b", 0, 1)]
    e = spark.createDataFrame([("a", 1150, 1200, "JUR"), ("a", 890, 910, "LEI")], "document_id string, start int, end int, label string")
    assert sorted((r.start, r.end) for r in tagger.label_windows(w, e).collect()) == [(50, 100), (190, 210), (450, 500)]


def test_gold_and_errors(spark, tmp_path):
    (tmp_path / "g.csv").write_text("nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico\n1,a,c1,0,10,\"x, y\",lei,real,70 71\n1,a,c2,20,30,z,lei,inventada,-\n", encoding="utf-8-sig")
    g = files.read_gold(spark, str(tmp_path / "g.csv"))
    assert [(r.g, r.ids) for r in g.orderBy("g").collect()] == [(0, ["70", "71"]), (1, [])]
    p = spark.createDataFrame([("a", 0, 1, 10, "real", "72"), ("a", 1, 50, 60, "real", "1")], "document_id string, p int, start int, end int, verdict string, canonical_id string")
    assert sorted(r.error for r in evaluate.error_report(g, p).collect()) == ["missed", "spurious", "wrong id"]


def test_templates(spark):
    raw = "CABEÇALHO\nProcesso nº 1\n\nI — RELATÓRIO\n\nSegue o voto do Min. Fulano sobre a matéria que se discute aqui. Consta do R. Esp. 123. 456/SP hoje, é certo. Cita-se um caso e outro.\n\nNestes termos, pede deferimento."
    span = lambda x: (raw.index(x), raw.index(x) + len(x))
    d = spark.createDataFrame([("a", raw, 1), ("b", "Sem nada.", 2)], "document_id string, raw string, level int")
    g = spark.createDataFrame([("a", *span("R. Esp. 123. 456/SP"), "jurisprudencia", "real"), ("a", *span("um caso"), "lei", "real"), ("a", *span("outro"), "lei", "real")], "document_id string, start int, end int, kind string, verdict string")
    sentences = [r.text for r in synth.whole_sentences(d, g).where("document_id = 'a'").orderBy("sentence").collect()]
    assert "".join(sentences) == raw and "Consta do R. Esp. 123. 456/SP hoje, é certo. " in sentences
    got = {(r.list, r.text) for r in synth.templates(d, g).collect()}
    assert got == {
        ("header", "CABEÇALHO\nProcesso nº 1\n\nI — RELATÓRIO\n\n"), ("header", "Sem nada.\n\n"), ("section", "I — RELATÓRIO"), ("closing", "Nestes termos, pede deferimento."),
        ("jurisprudencia|real", "Consta do {CIT} hoje, é certo. "), ("neutral", "CABEÇALHO Processo nº 1 I — RELATÓRIO Segue o voto do Min. Fulano sobre a matéria que se discute aqui."),
        ("filler", "CABEÇALHO Processo nº 1 I — RELATÓRIO Segue o voto do Min. Fulano sobre a matéria que se discute aqui."),
    }
    lists = synth.template_lists(synth.templates(d, g))
    assert lists["sections"] == ["I — RELATÓRIO"] and lists["carriers"] == {"jurisprudencia|real": ["Consta do {CIT} hoje, é certo. "]}


def test_stream(spark, registry, tmp_path):
    from lexspark.streaming.verify import verify_stream

    spark.createDataFrame([("d1", TEXT)], "document_id string, raw string").write.parquet(str(tmp_path / "in"))
    verify_stream(spark, str(tmp_path / "in"), index.build(registry), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_calibration_of_one_class(spark):
    rows = spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 1.0], 1)], "features array<double>, ok int")
    assert tagger.train_calibration(rows)[1] > 0
    two = rows.unionByName(spark.createDataFrame([([0.0, 3.0], 0)], rows.schema))
    assert len(tagger.train_calibration(two)[0]) == 2
