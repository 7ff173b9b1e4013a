"""The max-plus scan against a plain search of the best sum."""

import numpy as np
import pytest

from lexspark.llm import piece_scan

R = np.random.default_rng(11)
LETTERS = "abcde▁"
PIECES = [("<unk>", 0.0)] + [(c, -6.0 - 0.01 * k) for k, c in enumerate(LETTERS[:-2] + "▁")] + sorted({("".join(R.choice(list(LETTERS), n)), float(-R.uniform(2, 9))) for n in (2, 2, 3, 3, 4, 5, 7) for _ in range(60)})
PIECES = list(dict(PIECES).items())


def best(text):
    lattice = piece_scan.Lattice(PIECES, 0)
    text = "▁" + text.replace(" ", "▁")
    return lattice.trace(text, len(text), 0, 0) if text != "▁" else []


def total(ids, text):
    lattice = piece_scan.Lattice(PIECES, 0)
    return sum(lattice.unknown[1] if i == 0 else PIECES[i][1] for i in ids)


@pytest.mark.parametrize("chunk", [1, 3, 7, 50])
def test_states_lead_to_the_best_path(chunk):
    lattice = piece_scan.Lattice(PIECES, 0)
    for _ in range(30):
        text = "▁" + "".join(R.choice(list(LETTERS + "xe"), R.integers(1, 60)))
        parts = [(text[k : k + chunk + lattice.reach - 1], min(chunk, len(text) - k)) for k in range(0, len(text), chunk)]
        found = piece_scan.states([lattice.transfer(t, n) for t, n in parts])
        ids = [i for (t, n), s, e in zip(parts, found, found[1:], strict=False) for i in lattice.trace(t, n, s, e)]
        assert found[-1] == 0 and total(ids, text) == pytest.approx(total(lattice.trace(text, len(text), 0, 0), text))
        assert "".join(PIECES[i][0] if i else "?" for i in ids).replace("?", "").count("x") == 0


def test_encode(spark):
    texts = ["", None, "a", "abc de", " ".join("".join(R.choice(list("abcdex"), R.integers(1, 9))) for _ in range(400)), "x" * 300, "abcde" * 200, "a", "▁ é\n"]
    d = spark.createDataFrame([(i % 7, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    got = piece_scan.encode(d, PIECES, chunk=100).collect()
    assert len(got) == len(texts)
    want = sorted((i % 7, round(total(best(t), t), 6)) if t else (i % 7, 0) for i, t in enumerate(texts))
    assert sorted((r.doc_id, round(total(r.ids, ""), 6)) for r in got) == want
    long = next(r for r in got if r.doc_id == 4)
    assert long.ids == best(texts[4])
    assert piece_scan.encode(d.limit(0), PIECES).count() == 0
