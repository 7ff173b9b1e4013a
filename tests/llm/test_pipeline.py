"""The pipeline against a brute-force version of all its stages."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_edges import SCHEMA, WORDS, brute_groups

import corpus_pipeline
from lexspark.llm import line_dedup, quality

SF = "/root/testdata/sf0.001"


def naive_score(model, x):
    total = model.intercept
    at = [sum(1 for e in edges if e <= value) for edges, value in zip(model.edges, x, strict=True)]
    for j, b in enumerate(at):
        total += model.tables[j][b]
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        total += t[at[i] * quality.COARSE // quality.BINS][at[j] * quality.COARSE // quality.BINS]
    return total


def good(spark, docs, labels):
    import numpy as np
    import pyarrow as pa

    model = quality.train(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    x = quality.text_features(pa.array([r[1] for r in rows], pa.string())).astype(np.float32).astype(float)
    floor = np.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
    return [r for r, v in zip(rows, x, strict=True) if naive_score(model, v) >= floor]


def without_boilerplate(rows):
    bare = lambda x: x.strip(" \t\r")
    pages, count = {}, {}
    for _, t, _, s in rows:
        pages[s] = pages.get(s, 0) + 1
        for x in {bare(y) for y in (t or "").split("\n")} - {""}:
            count[s, x] = count.get((s, x), 0) + 1
    gone = {k for k, n in count.items() if n >= line_dedup.REPEATED and n > line_dedup.MAX_RATIO * pages[k[0]]}
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if (s, bare(x)) not in gone), lang, s) for i, t, lang, s in rows]


def one_of_each_group(rows):
    numbered = [(k, r[1]) for k, r in enumerate(rows)]
    component = {int(k): c for k, _, c in brute_groups(numbered)}
    best = {}
    for k, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, k)
        if component[k] not in best or key < best[component[k]][0]:
            best[component[k]] = key, r
    return [r for _, r in best.values()]


def mixed(rows):
    """Targets by resharing the excess again and again; places by one sorted list a source."""
    size = lambda t: len(WORDS.findall(t or ""))
    key = lambda s: (s is None, s or "")
    sources = sorted({r[3] for r in rows}, key=key)
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        open_ = [s for s in sources if s not in full]
        w = sum(weight[s] for s in open_)
        target = {s: 3 * total[s] if s in full else left * weight[s] / w for s in sources}
        over = {s for s in open_ if target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    out = []
    for s in sources:
        budget = int(target[s] + 0.5)
        order = lambda r: (hashlib.md5(f"mix:{r[0] if r[0] is not None else '~' + hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r[1]))
        start = 0
        for r in sorted((r for r in rows if r[3] == s), key=order):
            n = size(r[1])
            if not n:
                out.append(r)
                continue
            whole, part = budget // total[s], min(n, max(0, budget % total[s] - start))
            out += [r] * (whole + (part == n))
            if 0 < part < n:
                out.append((r[0], "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])[:part]), *r[2:]))
            start += n
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of the smallest tables with copies, repeats, boilerplate, nulls and blanks, and their labels."""
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    kept = [r for r in rows if r[1] and len(WORDS.findall(r[1])) > 40][:6]
    more = [(9000 + k, r[1] + " end", *r[2:]) for k, r in enumerate(kept)] + [kept[0], kept[0], (None, kept[1][1], "en", None), (None, None, None, None), (9100, "", "en", "src0"), (9101, " \n ", "en", None)]
    more += [(9200 + k, f"{r[1]}\nthe same last line of all of them", *r[2:]) for k, r in enumerate(kept)]
    spark.createDataFrame(rows + more, SCHEMA).withColumns({"n_chars": F.length("text").cast("long"), "mix_size": F.lit("clash"), "row": F.lit(1), "lines": F.lit(2)}).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_run_equals_brute_force(spark, tables):
    import public_tokenizers
    import sentencepiece

    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixed(one_of_each_group(without_boilerplate(good(spark, docs, labels))))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((str(i), sp.encode(t or "")) for i, t, *_ in rows)
    got = corpus_pipeline.run(spark, tables).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want and len(want) > 50
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)


def test_stages_keep_the_columns_and_do_something(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert name != "near_dedup" or len(rows) < before
        assert all(r.mix_size == "clash" and r.row == 1 and r.lines == 2 and (r.text is None or r.n_chars == len(r.text)) for r in rows), name
        before = len(rows)
        docs = out.select(docs.columns)
    assert corpus_pipeline.without_boilerplate(spark, docs.drop("n_chars"), tables).columns == docs.drop("n_chars").columns


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name


def test_no_good_document_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good_documents(spark, docs, SF).collect()}
    assert all(r.doc_id in kept for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1)


def test_one_row_of_each_group(spark):
    long = " ".join(f"palavra{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long + " fim"), (None, "um texto de todo diferente do resto da lista"), (None, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(out, key=repr) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)
