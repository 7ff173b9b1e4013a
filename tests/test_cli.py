"""From a registry and a folder of texts to submissions, and the readers and writers beside."""

import csv
import json
import sqlite3

import pytest
from test_plans import EXPECTED, REGISTRY, TEXT

from lexspark import cli
from lexspark.operators import evaluate, tagger
from lexspark.sources import files


@pytest.fixture
def inputs(tmp_path):
    con = sqlite3.connect(tmp_path / "registry.db")
    con.execute("create table documentos (documento_id text primary key, id integer, tribunal text, ano integer, relator text, natureza text, tipo text, texto text)")
    con.executemany("insert into documentos values (?,?,?,?,?,?,?,?)", REGISTRY)
    con.commit()
    con.close()
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "d1.txt").write_text(TEXT + " A jurisprudência pacífica desta Corte basta. Ver o feito 1.234.567 do acervo.")
    (tmp_path / "txt" / "d 2.txt").write_text("nada")
    at = (tmp_path / "txt" / "d1.txt").read_text().index("feito 1.234.567")
    (tmp_path / "spans.json").write_text(json.dumps({"d1": [{"inicio": at, "fim": at + 15, "rotulo": "JUR", "score": 0.97}]}))
    gold = ["nivel,documento_id,citacao_id,inicio,fim,trecho,tipo,classificacao,id_canonico"]
    for k, s in enumerate(("REsp nº 1.234.567/SP", "art. 157 do Código Penal", "Súmula 7 do STJ", "AREsp nº 9.876.543/RJ", "art. 999 do Código Penal")):
        a = TEXT.index(s)
        gold.append(f'1,d1,g{k},{a},{a + len(s)},"{s}",x,{EXPECTED_BY_PLACE[k][0]},{EXPECTED_BY_PLACE[k][1] or "-"}')
    (tmp_path / "gold.csv").write_text("\n".join(gold) + "\n", encoding="utf-8-sig")
    (tmp_path / "metric.py").write_text("def avaliar(solution, submission, row_id):\n    assert list(solution[row_id]) == list(submission[row_id]) == ['d1']\n    assert '7000000001' in solution['citacoes'][0]\n    return {'score_final': 0.5}\n")
    (tmp_path / "templates.json").write_text(json.dumps({"neutras": ["Consoante o julgado do STF proferido em 2020 pela relatoria de Fulano Sicrano, a matéria segue."], "veiculos": {"lei|real": ["o {CIT}."]}, "cabecalhos": [], "secoes": [], "enchimento": ["x"], "fechos": []}))
    return tmp_path


EXPECTED_BY_PLACE = EXPECTED


def test_submit(spark, inputs, capsys):
    out = inputs / "out"
    code = cli.main(["submit", str(inputs / "registry.db"), str(inputs / "txt"), str(out), "--spans", str(inputs / "spans.json"), "--gold", str(inputs / "gold.csv"), "--metric", str(inputs / "metric.py"), "--templates", str(inputs / "templates.json")])
    said = capsys.readouterr().out
    assert code == 0, said
    rows = {name: {r["documento_id"]: r["citacoes"] for r in csv.DictReader(open(out / f"submission{name}.csv", encoding="utf-8"))} for name in ("", "_diffuse", "_tagged")}
    assert rows[""]["d 2"] == "-" and rows[""]["d1"].count("|") == 4 and rows["_diffuse"]["d1"].count("|") == 5 and rows["_tagged"]["d1"].count("|") == 5
    assert "main: 0.5000" in said and "variant=tagged real=4 inventada=2 incompleta=0 total=6" in said
    contract = json.loads((out / "json_main" / "d1.json").read_text())
    assert [(c["classificacao"], (c.get("resolucao") or {}).get("id_canonico")) for c in contract["citacoes"]] == EXPECTED and (out / "json_main" / "d 2.json").exists()
    assert cli.main(["check", str(out / "json_main"), str(inputs / "txt")]) == 0
    assert cli.main(["score", str(out / "json_main"), str(inputs / "gold.csv")]) == 0
    assert "score level 1 real: F1 1.0000" in capsys.readouterr().out


def test_check_names_every_kind_of_broken_file(spark, inputs, capsys):
    folder = inputs / "json"
    folder.mkdir()
    (folder / "d1.json").write_text(json.dumps({"documento_id": "other", "citacoes": []}))
    (folder / "d 2.json").write_text("{broken")
    (folder / "gone.json").write_text(json.dumps({"schema_version": "1.2", "documento_id": "gone", "citacoes": []}))
    (inputs / "txt" / "d3.txt").write_text("x")
    docs = files.read_texts(spark, str(inputs / "txt"))
    got = {tuple(r) for r in evaluate.file_problems(docs, files.read_contract_files(spark, str(folder))).collect()}
    assert got == {("d1", "names another document"), ("d1", "no version"), ("d 2", "not JSON"), ("gone", "no document"), ("d3", "no file")}
    assert cli.main(["check", str(folder), str(inputs / "txt")]) == 1


def test_an_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_texts(spark, str(tmp_path))


def test_the_last_record_of_a_key_wins_by_place(spark, tmp_path):
    from lexspark.operators.index import build

    con = sqlite3.connect(tmp_path / "r.db")
    con.execute("create table documentos (documento_id text primary key, id integer, tribunal text, ano integer, relator text, natureza text, tipo text, texto text)")
    con.executemany("insert into documentos values (?,?,'STJ',null,null,'sumula','x','Súmula n. 7 do STJ x')", [("z", 1), ("a", 2)])
    con.commit()
    con.close()
    assert [tuple(r) for r in build(files.read_registry(spark, str(tmp_path / "r.db"))).sumulas.collect()] == [("STJ|7", "2")]


def test_contract_as_lines(spark, tmp_path):
    c = spark.createDataFrame([(f"d{i}", json.dumps({"schema_version": "1.2", "documento_id": f"d{i}", "citacoes": [{"id": "c1", "inicio": 0, "fim": 1}] * (i % 2)})) for i in range(6)], "document_id string, json string")
    files.write_contract(c, str(tmp_path / "lines"))
    assert sorted(r.document_id for r in files.read_contract(spark, str(tmp_path / "lines")).collect()) == ["d1", "d3", "d5"]


def test_spans_and_windows_round_trip(spark, tmp_path):
    spans = spark.createDataFrame([("a", 1, 5, "JUR", 0.5), ("a", 7, 9, "LEI", 0.25), ("b", 0, 2, "JUR", 1.0)], "document_id string, start int, end int, label string, score double")
    files.write_spans(spans, str(tmp_path / "spans"))
    assert sorted(map(tuple, files.read_spans(spark, str(tmp_path / "spans")).collect())) == sorted(map(tuple, spans.collect()))
    w = tagger.windows(spark.createDataFrame([("a#x", "y" * 1000)], "document_id string, raw string"))
    e = tagger.label_windows(w, spark.createDataFrame([("a#x", 110, 120, "JUR")], "document_id string, start int, end int, label string"))
    files.write_windows(w, e, str(tmp_path / "windows"))
    back = sorted((r.document_id, r.window, len(r.text), [tuple(x) for x in r.entities]) for r in files.read_windows(spark, str(tmp_path / "windows")).collect())
    assert back == [("a#x", 0, 900, [(110, 120, "JUR")]), ("a#x", 1, 900, [(10, 20, "JUR")])]


def test_scores_by_level(spark):
    gold = spark.createDataFrame([(1, "a", 0, 0, 10, "real", ["1"]), (1, "a", 1, 20, 30, "inventada", []), (2, "b", 0, 0, 10, "inventada", [])], "level int, document_id string, g int, start int, end int, verdict string, ids array<string>")
    said = spark.createDataFrame([("a", 0, 0, 10, "real"), ("a", 1, 20, 30, "inventada"), ("b", 0, 0, 10, "real"), ("b", 1, 50, 60, "real")], "document_id string, p int, start int, end int, verdict string")
    got = {(r.level, r["class"]): (r.tp, r.fp, r.fn, r.f1, r.macro_f1, r.tau) for r in evaluate.verdict_scores(gold, said).collect()}
    assert got == {(1, "real"): (1, 0, 0, 1.0, 1.0, 0.0), (1, "inventada"): (1, 0, 0, 1.0, 1.0, 0.0), (2, "real"): (0, 2, 0, 0.0, 0.0, 1.0), (2, "inventada"): (0, 0, 1, 0.0, 0.0, 1.0)}
    assert [tuple(r) for r in evaluate.solution(gold).orderBy("documento_id").collect()] == [("a", 1, "0,10,real,1|20,30,inventada,-"), ("b", 2, "0,10,inventada,-")]
