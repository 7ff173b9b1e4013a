"""The step that all verdict queries share: texts settled as they are read, headings read once, lookups by narrow rows."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lexspark import catalog
from lexspark.operators import index, tagger
from lexspark.operators.arbitrate import arbitrate
from lexspark.operators.detect import SCHEMA, find_candidates
from lexspark.plans.verify import verify

REGISTRY = "id string, court string, nature string, text string"


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def records(spark):
    rows = [("1", None, "acordao", "RECURSO ESPECIAL Nº 123.456 - SP (2020), feito Nº 777.888\nEMENTA"), ("2", None, "acordao", "RECURSO EM HABEAS CORPUS Nº 123.456 - SP\nEMENTA"), ("3", None, "acordao", "HABEAS CORPUS Nº 777.888 - RJ\nEMENTA"), ("4", None, "acordao", "HABEAS CORPUS Nº 1.000 - RJ, feito Nº 9.999\nEMENTA")]
    return spark.createDataFrame(rows, REGISTRY)


def test_settled_candidates_are_those_that_arbitration_keeps(spark):
    texts = ["Conforme o REsp nº 123.456/SP e a Súmula 1234 do STJ, art. 5º da Constituição Federal; HC 765.432.", "Súmula 4321 do STF; RHC 222.333/RJ\r\nTema 55 do STF", "", None, "REsp 123.456/SP REsp 123.456/SP"]
    docs = spark.createDataFrame([(str(i % 7) if i % 9 else None, texts[i % 5]) for i in range(60)], "document_id string, raw string")
    fields = SCHEMA.replace(",", "").split()[::2]
    rows = lambda df: sorted(map(repr, df.select(fields).collect()))
    settled = find_candidates(docs, settled=True)
    assert rows(settled) == rows(arbitrate(find_candidates(docs)))
    places = settled.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("place", "start"))).alias("p"))
    for p in (r.p for r in places.collect()):
        assert [x.place for x in p] == list(range(1, len(p) + 1)) and [x.start for x in p] == sorted(x.start for x in p)


def test_a_registry_is_read_once_for_its_cases(spark):
    cases = index.build(records(spark)).cases
    assert plan(cases).count("Scan ExistingRDD") == 1
    got = {(r.key, r.layer): r.ids for r in cases.collect()}
    assert got == {("123456|SP", 0): ["1", "2"], ("123456", 0): ["1", "2"], ("777888|RJ", 0): ["3"], ("777888", 0): ["3"], ("1000|RJ", 0): ["4"], ("1000", 0): ["4"], ("9999", 1): ["4"]}
    assert plan(index.summary(index.build(records(spark)))).count("Scan ExistingRDD") == 4  # cases, súmulas, statutes by number and by name


def test_candidates_without_a_key_meet_no_table_of_keys(spark):
    docs = spark.createDataFrame([("a", "Conforme o REsp nº 123.456/SP."), ("b", "Conforme o RHC nº 123.456/SP e o HC 9.999; HC 555.")], "document_id string, raw string")
    c = verify(docs, index.build(records(spark)))
    assert sorted((r.document_id, r.citation_id, r.verdict, r.canonical_id) for r in c.collect()) == [("a", "c1", "real", "1"), ("b", "c1", "real", "2"), ("b", "c2", "real", "4"), ("b", "c3", "inventada", None)]
    joins = [line for line in plan(c).splitlines() if "Join" in line]
    assert "Window" not in plan(c) and not any("LeftOuter" in j and ("number" in j or "lookup" in j) for j in joins)


def test_spans_of_a_tagger_are_read_once(spark):
    docs = spark.createDataFrame([("a", "Conforme o REsp nº 123.456/SP e o feito 9.999 do acervo.")], "document_id string, raw string")
    idx = index.build(records(spark))
    tagged = spark.createDataFrame([("a", 34, 45, "JUR", 0.99)], "document_id string, start int, end int, label string, score double")
    merged = tagger.merge(docs, verify(docs, idx), tagged, idx)
    assert "MapInPandas" not in plan(merged) and "MapInArrow" not in plan(merged)
    assert [(r.surface, r.canonical_id) for r in merged.orderBy("start").collect()] == [("REsp nº 123.456/SP", "1"), ("feito 9.999", "4")]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_training_reads_written_features(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tagger, "train_calibration", lambda rows: seen.append(plan(rows)) or ([0.0] * 22, 0.0))
    catalog.QUERIES["train_calibration"](spark, "/root/testdata/sf0.001")
    assert "Join" not in seen[0]


def test_a_plain_case_citation_meets_no_costly_pattern(monkeypatch):
    """F13, F15, F17, F19 to F23, F25: what a text can't have isn't looked for, and the class is read from the words before the number at once."""
    from lexspark.functions import spans

    def never(*_):
        raise AssertionError("costly")

    for name in ("_STATUTE", "_SUMULA", "_TOPIC", "_FOLIO"):
        monkeypatch.setattr(spans, name, type("Never", (), {"finditer": never, "search": never})())
    monkeypatch.setattr(spans, "vague", never)
    monkeypatch.setattr(spans.Page, "leftward", never)
    text = "Conforme o REsp nº 100.000/AC, nega-se."
    for only_numbers in (False, True):
        assert [(c.start, c.end, c.uf, c.readings) for c in spans.candidates(text, only_numbers=only_numbers)] == [(11, 29, "AC", ["100000"])]


@pytest.mark.parametrize(
    ("text", "surface"),
    [
        ("nega, " + "no " * 60 + "REsp 123.456", "REsp 123.456"),  # the run to the left is cut off
        ("x" * 500 + " " * 100 + "REsp 123.456", "REsp 123.456"),
        ("na ação penal 123.456", "ação penal 123.456"),
        ("em questão de ordem no HC 123.456", "questão de ordem no HC 123.456"),  # a phrase takes blanks that a run doesn't
        ("resp " * 40 + "nº" + " " * 30 + "123.456", ("resp " * 40 + "nº" + " " * 30 + "123.456")[-220 - 16 :]),
        ("a,resp 123.456", "resp 123.456"),
    ],
)
def test_a_class_is_read_the_same_from_a_run_and_word_by_word(text, surface):
    from itertools import takewhile

    from lexspark import fixed
    from lexspark.functions.spans import Page

    at = text.index("123.456")
    walk = takewhile(lambda s: s.known and at - s.end <= fixed.CLASS_REACH, Page(text).leftward(at))
    start = Page(text).class_start(at)
    assert start == min((s.start for s in walk if not s.link), default=at) and (text.startswith("resp") or text[start:] == surface)


def test_texts_are_told_apart_by_what_only_others_have():
    import pyarrow as pa
    import pyarrow.compute as pc

    from lexspark.functions.spans import OTHERS, candidates

    others = ["art. 5º da Constituição Federal", "5úrnula nº 7", "SÚMULA 12 do STJ", "TEMA 5 do STF", "Rcl de 2001, Rel. Min. Rosa Weber", "julgado do STF de 2020, da RELATORİA de Fulano Sicrano", "Arl. 3 do CPC"]
    assert all(pc.match_substring_regex(pa.array(others), OTHERS).to_pylist()) and all(candidates(t) for t in others[:5])
    assert pc.match_substring_regex(pa.array(["Conforme o REsp nº 100.000/AC, nega-se.", None]), OTHERS).to_pylist() == [False, None]


def test_headings_without_process_numbers_or_states_in_full(spark):
    """F13 and those beside it: a heading's number is found once, with its state, and is read from the match."""
    rows = [("1", None, "acordao", "RECURSO ESPECIAL Nº 000.123 - sp, Nº 1.234.567/RJ e 123.456 SÃÓ PAULO"), ("2", None, "acordao", "discutidos  estes\nautos de 0001234-56.2020.5.01.0001"), ("3", None, "acordao", "PROCESSO Nº TST-AIRR-1-22.2020.5.01.0001, Nº 4.444"), ("4", None, "acordao", "Nº 000 - SP")]
    keys = index.case_keys(spark.createDataFrame(rows, REGISTRY))
    assert plan(keys).count("regexp_extract_all") <= 4
    assert sorted((r.id, r.key, r.layer) for r in keys.collect()) == sorted([
        ("1", "123", 0), ("1", "123456", 0), ("1", "123456|SP", 0), ("1", "1234567", 0), ("1", "1234567|RJ", 0), ("1", "123|SP", 0),
        ("2", "12345620205010001", 0), ("3", "12220205010001", 0), ("3", "4444", 1), ("4", "0|SP", 0),
    ])


def test_a_case_of_one_record_is_settled_by_its_number(spark):
    """a number's records meet a citation at once, whatever the state; only what that leaves open is joined further."""
    texts = ["Conforme o HC nº 777.888/RJ.", "Conforme o HC nº 777.888/SP.", "Conforme o HC nº 9.999.", "Conforme o HC nº 555.444/SP.", "nada"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, raw string")
    c = verify(docs, index.build(records(spark)))
    assert "Join" not in plan(c)
    assert sorted((r.document_id, r.verdict, r.canonical_id, r.evidence, r.signals.layer, r.signals.n_records) for r in c.collect()) == [
        ("0", "real", "3", "num_uf", "primaria", 1), ("1", "real", "3", "num_uf", "primaria", 1), ("2", "real", "4", "num", "secundaria", 1), ("3", "inventada", None, "num_uf", "secundaria", 0),
    ]


def test_own_numbers_and_states_come_before_what_only_shares_a_number(spark):
    rows = [("1", None, "acordao", "HABEAS CORPUS Nº 123.456 - SP"), ("2", None, "acordao", "HABEAS CORPUS Nº 123456 - RJ, HC Nº 123.456"), ("3", None, "acordao", "HC Nº 5.000 - SP, feito Nº 123.456"), ("4", None, "acordao", "Nº 000 - SP"), ("5", None, "acordao", "HC Nº 234.567 - SP"), ("6", None, "acordao", "HC Nº 234.567 - SP")]
    idx = index.build(spark.createDataFrame(rows, REGISTRY))
    docs = spark.createDataFrame([("a", "HC 123.456/RJ"), ("b", "HC 123.456/SP"), ("c", "HC 123.456"), ("d", "HC 000/SP"), ("e", "HC 000"), ("f", "HC 12345G/RJ"), ("g", "HC 234.567/AC")], "document_id string, raw string")
    got = {r.document_id: (r.verdict, r.canonical_id, r.signals.n_records) for r in verify(docs, idx).collect()}
    assert got == {"a": ("real", "2", 1), "b": ("real", "1", 1), "c": ("real", "1", 2), "d": ("real", "4", 1), "e": ("inventada", None, 0), "f": ("real", "2", 1), "g": ("real", "5", 2)}
    again = index.Index(idx.cases, idx.sumulas, idx.statutes, idx.meta)
    assert {r.document_id: (r.verdict, r.canonical_id, r.signals.n_records) for r in verify(docs, again).collect()} == got


def test_a_context_of_numbers_is_read_once():
    """what stands before a number is mostly one of a few forms."""
    from lexspark.functions import spans

    spans._class_in_run.cache_clear()
    assert [c.start for n in range(100, 200) for c in spans.candidates(f"Conforme o REsp nº 100.{n}/AC, nega-se.")] == [11] * 100
    assert spans._class_in_run.cache_info().misses == 1


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_a_contract_is_parsed_once(spark):
    """the output is read back in one pass over its text."""
    made = plan(catalog.QUERIES["output_contract"](spark, "/root/testdata/sf0.001"))
    assert "get_json_object" not in made and "from_json" in made
