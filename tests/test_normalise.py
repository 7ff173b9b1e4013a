"""Normalisation with an offset map: against a plain version, and in bounded pieces."""

import random
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from lexspark.functions import text as T


def plain(raw):
    out, starts, ends, i = "", [], [], int(raw.startswith("﻿"))
    while i < len(raw):
        j = i + 1
        if raw[i] == "\r":
            j += raw[j : j + 1] == "\n"
            piece = "\n"
        else:
            while j < len(raw) and unicodedata.combining(raw[j]):
                j += 1
            piece = unicodedata.normalize("NFC", raw[i:j])
        out, starts, ends, i = out + piece, starts + [i] * len(piece), ends + [j] * len(piece), j
    return out, starts, ends


def test_offsets_are_those_of_a_plain_version():
    r = random.Random(1)
    letters = ["a", "b", " ", "\n", "\r", "\r\n", "é", "e", "́", "̧", "﻿", "Å", "̈́", "क़", "\U0001d15e", "가"]
    for _ in range(5_000):
        raw = "".join(r.choice(letters) for _ in range(r.randint(0, 10)))
        text, starts, ends = T.normalise(raw)
        assert text == raw if starts is None else (text, starts, ends) == plain(raw)


def test_results_leave_a_worker_in_pieces():
    texts = ["ação\r\n" * 50_000, None, "x", ""] * 10
    pieces = list(T.normalised.func(iter([pa.array(texts, pa.string())])))
    assert len(pieces) >= 3 and max(len(p) for p in pieces) < 20
    rows = [x for p in pieces for x in p.to_pylist()]
    assert [x["proc"] for x in rows] == [t and t.replace("\r\n", "\n") for t in texts]
    assert rows[0]["start"][-1] == len(texts[0]) - 2 and rows[0]["end"][-1] == len(texts[0]) and rows[1]["start"] is None and rows[2]["end"] is None


def test_a_column_keeps_its_rows(spark):
    d = spark.range(3_000).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("é\r\n"), (F.col("id") % 50 * 40).cast("int"))).alias("raw")).coalesce(1)
    bad = d.withColumn("x", T.normalised("raw")).where("not (x.proc <=> replace(raw, '\r', ''))").count()
    assert not bad
