"""Readers at size: what texts and headings cost where they hold nothing, and that cheap tests lose nothing."""

import contextlib
import io
import random

import pytest

from lexspark.functions import spans as S
from lexspark.operators import index

NEAR = (
    "Consoante o julgado do STF proferido em 2021 pela relatoria de Fulano Sicrana, a matéria segue em debate.", "Como na Rcl de 2001, Rel. Min. Rosa Weber. Cumpre lembrar.",
    "acórdão do Superior Tribunal de Justi.,a, de 2019, Rel. Min. Rosa Weber", "REsp do Superior Tribunal de Justiça, de 2O19, Rel Min. Rosa Weber", "RHC do TST de 2019 Re1. Dias Toffoli", "nada disso",
)


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def test_spines_are_as_near_as_their_edits():
    r, spines = random.Random(3), ("a b c a", "b b", "c a c b a b")
    for _ in range(400):
        window, most = "".join(r.choices("abcd ,.", k=r.randint(0, 12))), r.randint(0, 3)
        bare = "".join(c for c in window if c not in " ,.")
        nearest = min(min(S._columns(s.replace(" ", ""), bare, True)) for s in spines)
        assert S._Spines(spines).within(window, most) == (nearest <= most)


def test_costly_patterns_run_only_where_courts_fit(monkeypatch):
    """A year and what resembles "Rel." without a court before them meet no pattern that wants a court."""
    wants_court = S._fuzzy(False)[2]
    assert [wants_court.possible(t) for t in NEAR] == [False, False, True, True, True, False]
    found = [list(S.vague(t)) for t in NEAR]
    monkeypatch.setattr(S._Fuzzy, "possible", lambda self, window: True)
    assert found == [list(S.vague(t)) for t in NEAR]


def test_headings_are_read_after_they_are_dealt(spark):
    """A filter on what is read from headings stays above the shuffle that deals them over all cores."""
    rows = [
        ("1", None, "dispositivo", "Artigo 5º da Constituição Federal\nTexto"), ("2", None, "dispositivo", "Artigo 1.024 da Lei nº 8.078, de 11 de setembro de 1990\nTexto"),
        ("3", None, "dispositivo", "Artigo 7 do Código Tributário Nacional\nTexto"), ("4", None, "dispositivo", "Artigo 7 da Portaria\nTexto"), ("5", None, "dispositivo", "Sem artigo"),
        ("6", "STF", "sumula", "Súmula Vinculante 12 Texto"), ("7", None, "sumula", "Súmula n. 3 do STJ Texto"), ("8", "STJ", "sumula", "Enunciado 3"),
    ]
    built = index.build(spark.createDataFrame(rows, "id string, court string, nature string, text string"))
    assert {(r.key, r.id) for r in built.statutes.collect()} == {("CF|5", "1"), ("CDC|1024", "2"), ("LEI 5172/1966|7", "3")}
    assert {(r.key, r.id) for r in built.sumulas.collect()} == {("STF|SV|12", "6"), ("STF|12", "6"), ("STJ|3", "7")}
    for table in (built.statutes, built.sumulas):
        for branch in plan(table).split("REPARTITION_BY_NUM")[1:]:
            assert "regexp" not in branch.split("Scan")[0] and "Python" not in branch.split("Scan")[0]


@pytest.mark.parametrize("line,label", [("Processo nº 1", "own"), ("́Auto5 nº 1", "own"), ("Assunto x: 1", "own"), ("\x1cConforme o REsp", None), ("Conforme o REsp nº 1", None), ("Parecer do MP", None), ("Nome: 1", "any")])
def test_labels(line, label):
    assert S._label(line) == label
