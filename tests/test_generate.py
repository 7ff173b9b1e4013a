"""Generated documents: their truth is right by construction, and the engine finds it."""

import pytest
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.functions import text as T
from lexspark.operators import evaluate, generate, index, synth, tagger
from lexspark.plans.verify import verify

TEMPLATES = {
    "headers": ["EXCELENTÍSSIMO SENHOR\n\nProcesso nº 1234567-89.2020.8.26.0100\n\n"], "sections": ["I — RELATÓRIO", "II — MÉRITO", "III — DISPOSITIVO"],
    "filler": ["A matéria é conhecida.", "Segue o exame do pedido."], "closings": ["Nestes termos, pede deferimento."],
    "carriers": {"jurisprudencia|real": ["Consoante o {CIT}, o pedido procede."], "jurisprudencia|inventada": ["Invoca-se o {CIT}, sem razão."], "jurisprudencia|incompleta": ["Assim o {CIT}. Nada mais."],
                 "lei|real": ["Incide o {CIT}, como visto."], "lei|inventada": ["Cita-se o {CIT}, como visto."]},
}


@pytest.fixture(scope="module")
def world(spark):
    rows = [(7_000_000_000 + i, "STJ", 2020, "Min. Rosa Weber", "acordao", f"RECURSO ESPECIAL Nº 1.{200 + i}.{100 + i} - SP (2020)\nEMENTA") for i in range(200)]
    rows += [(7_100_000_000 + i, "TST", 2021, "Ministro Fulano Sicrano", "acordao", f"Vistos, relatados e discutidos estes autos de Recurso de Revista nº TST-RR-{1000 + i}-{10 + i}.2019.5.02.0{100 + i}, em que") for i in range(20)]
    rows += [(6_000_000_000 + i, "STJ", None, None, "sumula", f"Súmula n. {i + 1} do STJ Texto") for i in range(30)]
    rows += [(9_000_000_000 + i, None, None, None, "dispositivo", f"Artigo {i + 1} da Lei nº 13.105, de 16 de março de 2015\nTexto") for i in range(60)]
    rows += [(7_200_000_000 + i, "STJ", 2020, None, "acordao", "RECURSO ESPECIAL Nº 1.999.999 - SP\nEMENTA") for i in range(2)]
    registry = spark.createDataFrame(rows, "id long, court string, year int, rapporteur string, nature string, text string")
    return registry, index.build(registry)


def test_pools_hold_what_resolves_alone(spark, world):
    p = generate.pools(*world)
    cases = {r.id: r for r in p["cases"].collect()}
    assert len(cases) == 220 and "7200000000" not in cases
    assert cases["7000000000"].number == "1.200.100" and cases["7000000000"].uf == "SP" and cases["7000000000"]["class"] == "recurso especial"
    assert cases["7100000003"].number == "1003-13.2019.5.02.0103" and cases["7100000003"].uf is None
    assert {tuple(r) for r in p["rapporteurs"].collect()} == {("STJ", "Min. Rosa Weber", 2020), ("TST", "Ministro Fulano Sicrano", 2021)}
    assert p["sumulas"].count() == 30 and p["statutes"].count() == 60


def test_dense_numbers(spark):
    d = spark.range(1000).repartition(7)
    assert sorted(r.n for r in generate.numbered(d).collect()) == list(range(1000))


@pytest.fixture(scope="module")
def corpus(spark, world):
    raw, truth = generate.documents(spark, generate.pools(*world), world[1], TEMPLATES, 40)
    return raw.cache(), truth.cache()


def test_truth_stands_where_it_says(corpus):
    raw, truth = corpus
    texts = {r.document_id: r.raw for r in raw.collect()}
    rows = truth.collect()
    assert len(texts) == 40 and len(rows) > 200 and {r.verdict for r in rows} == set(fixed.VERDICTS) and {r.kind for r in rows} == set(fixed.KINDS)
    assert all(texts[r.document_id][r.start : r.end] == r.surface for r in rows)
    assert all((r.verdict == "real") == (len(r.ids) == 1) for r in rows)
    assert {r.level for r in rows} == {1, 2}


def test_the_engine_finds_the_truth(world, corpus):
    raw, truth = corpus
    found = verify(raw, world[1]).withColumn("p", F.col("start")).cache()
    m = {(r.level, r["class"]): r for r in evaluate.verdict_scores(truth, found).collect()}
    assert all(m[1, v].f1 > 0.9 for v in fixed.VERDICTS) and m[1, "real"].tau < 0.05, m
    assert all(m[2, v].f1 > 0.75 for v in fixed.VERDICTS), m
    again = generate.documents(raw.sparkSession, generate.pools(*world), world[1], TEMPLATES, 40)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, raw.collect()))


def test_identifier_noise_keeps_identity_and_happens(spark):
    d = spark.range(600).select("id", F.concat(F.lit("REsp nº 1."), (F.col("id") + 200).cast("string"), F.lit(".784-21/SP")).alias("s"))
    out = d.withColumn("noisy", generate.identifier_noise(F.col("s"), "id")).withColumn("kept", T.keeps_identity(F.col("noisy"), F.col("s"))).collect()
    assert all(r.kept for r in out)
    noisy = [r.noisy for r in out]
    for sign in ("\n", " ", "--", ". ", "O"):
        assert any(sign in x for x in noisy), sign
    assert 0.5 < sum(r.noisy != r.s for r in out) / len(out) < 1
    assert spark.createDataFrame([("",), ("1",), (None,)], "s string").select(generate.identifier_noise(F.col("s"), F.lit(1)).alias("x")).collect()[0].x == ""


def test_fake_numbers_and_formats(spark):
    d = spark.range(300).select(generate.fake_cnj("id").alias("cnj"), generate.format_number(F.lit("1.234.567"), "id").alias("n"), generate.format_number(F.lit("0600216-46.2020.6.14.0022"), "id").alias("c"))
    rows = d.collect()
    import re

    assert all(re.fullmatch(fixed.CNJ, r.cnj) for r in rows)
    assert {"".join(c for c in r.n if c.isdigit()) for r in rows} == {"1234567"} and len({r.n for r in rows}) == 4
    assert {"".join(c for c in r.c if c.isdigit()) for r in rows} == {"06002164620206140022"} and len({r.c for r in rows}) == 5


def test_semantic_class(spark):
    d = spark.createDataFrame([("AGINT NO RECURSO ESPECIAL",), ("HABEAS CORPUS",), ("Mandado de Segurança",), ("OUTRA COISA",)], "h string")
    assert [r[0] for r in d.select(generate.semantic_class(F.col("h"))).collect()] == ["recurso especial", "habeas corpus", "mandado seguranca", "recurso especial"]


def test_near_texts_against_brute_force(spark):
    import random

    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (5, 8, 30, 60, 61, 90)]
    texts = base + [t[: len(t) // 2] + "x" + t[len(t) // 2 + 1 :] for t in base] + ["ab", "a", "", "abc", "abd", "z" * 40, "z" * 44]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, s string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if b and edits(a, b) / len(b) <= 0.16}
    assert {tuple(x) for x in synth.near_texts(d, "id", "s", 0.16).collect()} == want


def test_label_reads_windows_and_maps_back(spark):
    raw = "﻿x\r\n" + "palavra " * 150 + "REsp 123.456" + " fim" * 100
    docs = spark.createDataFrame([("a", raw), ("b", "nada"), ("c", "")], "document_id string, raw string")

    def make():
        import re

        return lambda texts: [[(m.start(), m.end(), "JUR", 0.9) for m in re.finditer(r"REsp [\d.]+", t)] for t in texts]

    got = [tuple(r) for r in tagger.label(docs, make, batch=2).collect()]
    assert [(d, raw[s:e], x) for d, s, e, x, _ in got] == [("a", "REsp 123.456", "JUR")]


def test_fusion_report_and_degradation(spark, world, corpus):
    raw, truth = corpus
    found = verify(raw, world[1]).cache()
    one = truth.where("level = 1")
    grid = {(r.dropped, r.spurious): r for r in tagger.degradation(raw.where("document_id like 'syn_n1%'"), found.where("document_id like 'syn_n1%'"), one, world[1], dropped=(0.0, 0.5, 1.0), spurious=(0.0,)).collect()}
    assert grid[0.0, 0.0].rules > 0.9 and grid[1.0, 0.0].rules == 0 and grid[0.5, 0.0].rules < 0.7
    assert grid[0.5, 0.0].fused > grid[0.5, 0.0].rules + 0.1 and grid[1.0, 0.0].fused > 0.4
    half = found.where("pmod(xxhash64(document_id, start), 2) = 0")
    fused = tagger.merge(raw, half, tagger.simulate(found), world[1])
    added, n = tagger.fusion_report(fused)
    r = n.first()
    assert r.added == added.count() > 0 and r.rules == half.count() and r.percent == pytest.approx(100 * r.added / r.rules)


def test_calibration_report(spark):
    rows = spark.createDataFrame([(1.0, 0.9, 1), (1.0, 0.2, 0)], "confidence double, score double, ok int")
    r = tagger.calibration_report(rows).first()
    assert (r.n, r.hit_rate, r.brier_before, r.brier_after) == (2, 0.5, 0.5, pytest.approx(0.025)) and r.bonus_after == pytest.approx(0.0975)
