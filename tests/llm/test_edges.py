"""Each operator on nulls, empty, blank and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import chat_format, exact_dedup, line_dedup, near_dedup, piece_codec, quality, source_mix, token_rollup, url_filter, vector_search

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
#: Over two of the pieces that texts are hashed in.
GIANT = " ".join(f"g{i % 977}y{i}" for i in range(230_000))
BASE = " ".join(f"word{i}" for i in range(400))
ROWS = [
    (1, "same text here for all of them", "en", "a"), (2, "same text here for all of them", "en", "a"), (2, "same text here for all of them", "en", "a"), (3, None, "en", None), (4, "", None, "b"),
    (None, "no id at all", "fr", "b"), (5, LONG, "en", "a"), (6, LONG + " end", "en", "a"), (7, " \t\n", "de", "c"), (8, BASE, "en", "b"), (9, BASE.replace("word7 ", "WORD7  "), "en", "b"),
    (10, BASE.replace("word200", "other"), "en", "b"), (11, "ção \x00 é ▁ x", "es", "c"), (12, "one two three", "en", "c"), (13, "One  two\nthree", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = [F.lit(1).alias(c) for c in ("row", "n", "name", "level", "score", "key", "site", "count", "mix_size", "__lines", "x", "size")]
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1).select("*", *clash)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, nothing):
    got = exact_dedup.exact_dedup(docs, block_bytes=8, salts=2).collect()
    assert len(got) == len(ROWS)
    by = {}
    for i, t, *_ in ROWS:
        by.setdefault(t or "", []).append(i)
    want = sorted((str(i), str(max((x for x in by[t or ""] if x is not None), default=None)), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_tells_block_orders_apart(spark):
    texts = ["ab" * 8, "ba" * 8, "ab" * 8 + "a", "aabb" * 4, "", "a", "ab" * 7, "abab" * 4]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=2).collect()}
    assert got == {i: max(j for j, u in enumerate(texts) if u == t) for i, t in enumerate(texts)}


def brute_groups(rows):
    sets = []
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                top[find(a)] = find(b)
    ids = {}
    for k, (i, s) in enumerate(sets):
        ids.setdefault(find(k), []).append(i)
    return sorted((str(i), len(s), str(min((x for x in ids[find(k)] if x is not None), default=None) if s else i)) for k, (i, s) in enumerate(sets))


def test_near_dedup(spark, docs, nothing):
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_dedup(docs).collect()) == brute_groups(ROWS)
    assert near_dedup.near_dedup(nothing).count() == 0


def test_near_dedup_of_giants_nulls_and_repeats(spark):
    """Texts of several pieces, a thousand null ids, a thousand repeats of a row."""
    assert len(GIANT) > 2 << 20
    rows = [(1, GIANT), (2, GIANT.replace("g5y", "G5Y") + " end"), (3, GIANT[: len(GIANT) // 2])]
    rows += [(None, f"a text without an id number {i} of many others like {i * 7} that {i % 13} one") for i in range(1000)]
    rows += [(7, "one row that stands there a thousand times over")] * 1000
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute_groups(rows)


def test_near_dedup_of_a_hot_family(spark, monkeypatch):
    """Many near copies of one text and a passage that many share: small limits send them through every path."""
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = np.random.default_rng(5)
    base, passage = [f"b{i}" for i in range(320)], [f"p{i}" for i in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.integers(0, len(w), r.integers(4, 17)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
        rows.append((1000 + i, " ".join(passage + [f"u{i}_{k}" for k in range(r.integers(20, 90))])))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got.collect()) == brute_groups(rows)


@pytest.mark.parametrize("size", [4, 40, 400, 4000])
def test_registers_agree_as_sets_do_at_every_size(size):
    """Estimates are near the truth, and bands alone find pairs at the threshold, however small the sets."""
    r, found, trials, estimates = np.random.default_rng(size), 0, 60 if size > 1000 else 200, []
    for _ in range(trials):
        pool = r.permutation(np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)))
        cut = len(pool) * 3 // 4
        half = cut + (len(pool) - cut) // 2
        a, b = (near_dedup._sketch(np.sort(x)) for x in (np.concatenate([pool[:cut], pool[cut:half]]), np.concatenate([pool[:cut], pool[half:]])))
        found += bool((a.reshape(-1, near_dedup.BAND) == b.reshape(-1, near_dedup.BAND)).all(axis=1).any())
        n = np.array([float(half)])
        estimates.append(near_dedup.estimated(a[None], b[None], n, n)[0])
    assert found == trials
    assert abs(np.mean(estimates) - 0.75) < 0.02 and np.std(estimates) < 0.05


def test_estimates_of_unlike_sets_are_corrected():
    r = np.random.default_rng(9)
    draw = lambda n: near_dedup._sketch(np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)))
    a, b = (np.array([draw(300) for _ in range(300)]) for _ in "ab")
    n = np.full(300, 300.0)
    assert abs(near_dedup.estimated(a, b, n, n).mean()) < 2e-4


def test_url_filter(spark):
    urls = [("http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x://example.com/en/?q", "example.com", "/en/", "example.com/en/", "block"), ("https://a.net/es/#x", "a.net", "/es/", "net/es/", "block"),
            ("https://a.com", "a.com", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("https://bad.org/x?y", "bad.org", "/x", None, "block"), ("https://anet/fr/", "anet", "/fr/", None, "allow")]
    rows = [(i, u) for i, (u, *_) in enumerate(urls)] + [(100 + i, "https://bad.org/p") for i in range(200)] + [(400 + i, f"https://good{i % 9}.org/p") for i in range(300)] + [(0, urls[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(200)] + [(400 + i, int(i % 50 == 0)) for i in range(300)] + [(401, None)], "page_id long, bad int")
    got = url_filter.filter_urls(pages, outcomes).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r.page_id < 100} == {(i, h, p, rule, v) for i, (_, h, p, rule, v) in enumerate(urls)}
    assert url_filter.filter_urls(pages, outcomes.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0


def test_chat_round_trip(spark):
    odd = ["", "###", "\\", "\\\\h", "####", "</turn>", "\n</turn>\n", "a\\t</turn>\\", "### User:\nx", None, "é\U0001f600\n"]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(odd)] + [(2, None, None, "x"), (2, 0, "we:\nird", "y"), (None, 0, "user", "z"), (2, 0, "we:\nird", "y")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_turns(chat_format.row_turns(t.withColumn("extra", F.lit(1))), segment=3)
    back = {r.conv_id: [(x.role, x.text) for x in r.t] for r in made.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()}
    assert back == {1: [(r, x or "") for _, _, r, x in rows[:11]], 2: [("", "x"), ("we:\nird", "y"), ("we:\nird", "y")], None: [("user", "z")]}
    assert chat_format.format_turns(t.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.row_turns(t.drop("role"))


def test_json_layouts(spark):
    rows = [(1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"id":3}'), (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'), (3, '{"prompt":"a","response":"b"}'),
            (4, '{"instruction":"a","input":"c","output":"b"}'), (5, "broken"), (6, None), (7, '{"other":1}')]
    got = {}
    for r in chat_format.json_turns(spark.createDataFrame(rows, "id long, j string"), "id", "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    ab = [("user", "a"), ("assistant", "b")]
    assert got == {1: ab, 2: ab, 3: ab, 4: [("user", "a"), ("user", "c"), ("assistant", "b")], 5: [(None, None)], 6: [(None, None)], 7: [(None, None)]}


def test_json_records_of_every_shape(spark):
    rows = [(1, '{"prompt":"a","response":"b","answer":"z"}'), (2, '{"instruction":"a","input":"c","output":"b","prompt":"z"}'), (3, '{"messages":[{"role":"user","content":"a"},{"from":"gpt","value":"b"},{"odd":1}]}'),
            (4, '{"messages":[]}'), (5, '{"messages":[{"role":"model"}]}'), (6, '{"system":"s","prompt":"a","response":"b","completion":"z"}'), (7, '{"messages":"no list"}'), (8, '{"messages":[{"role":"human","content":null,"name":"x"}]}')]
    got = {}
    for r in chat_format.json_turns(spark.createDataFrame(rows, "id long, j string").withColumn("t", F.lit(0)), "id", "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    ab, none = [("user", "a"), ("assistant", "b")], [(None, None)]
    assert got == {1: ab, 2: [("user", "a"), ("user", "c"), ("assistant", "b")], 3: [*ab, (None, None)], 4: none, 5: [("assistant", "")], 6: [("system", "s"), *ab], 7: none, 8: [("user", "")]}


@pytest.mark.parametrize("clash", ["value", "index", "from", "layout"])
def test_rows_with_columns_of_other_layouts(spark, clash):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").withColumn(clash, F.lit("x"))
    assert sorted(map(tuple, chat_format.row_turns(t).collect())) == [(1, 0, "user", "a"), (1, 1, "assistant", None)]


def test_rows_of_two_layouts_in_one_table(spark):
    a = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "gpt", "b"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    b = spark.createDataFrame([(2, 0, "human", "c"), (2, 1, "gpt", "d")], "conversation_id long, index long, from string, value string")
    got = chat_format.row_turns(a.unionByName(b, allowMissingColumns=True))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 0, "user", "a"), (1, 1, "gpt", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (None, None, None, None)], key=repr)
    loss = {r.conv_id: r.loss_turns for r in chat_format.format_turns(got).collect()}
    assert loss[2] == [False, True]


def test_giant_values(spark):
    """Texts over a megabyte through the operators that hold one as a value."""
    turn = "###" + "x" * (1 << 20) + "</turn>"
    made = chat_format.format_turns(spark.createDataFrame([(1, 0, "user", turn)], "conv_id long, turn long, role string, text string"))
    assert [(t.role, t.text) for t in made.select(chat_format.read_turns(F.col("formatted")).alias("t")).first().t] == [("user", turn)]
    url = "https://a.net/fr/" + "p" * (1 << 20)
    row = url_filter.filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).first()
    assert row.rule == "net/fr/" and len(row.path) == len(url) - 13
    n = token_rollup.signed_counts(spark.createDataFrame([(1, "a", "en", "ab" * 30_000)], "sign int, source string, lang string, text string")).first().tokens
    assert n == len(token_rollup._encoding("byte_bpe_50k").encode_ordinary("ab" * 30_000))
    mixed = source_mix.mix(spark.createDataFrame([(1, GIANT, "s")], "doc_id long, text string, source string")).first()
    assert mixed.mix_size == mixed.mix_taken == 230_000
    lines = line_dedup.drop_boilerplate(spark.createDataFrame([(1, GIANT.replace(" ", "\n"), "s")], "doc_id long, text string, source string")).first()
    assert (lines.line_count, lines.lines_dropped) == (230_000, 0)


def test_source_mix(spark, docs, nothing):
    got = source_mix.mix(docs).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, t, _, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert sum(r.mix_taken for r in mine) == int(mine[0].mix_target + 0.5)
        assert all(r.mix_source_size == sizes[s] and 0 <= r.mix_taken <= 3 * r.mix_size for r in mine)
    assert sum({r.source: r.mix_target for r in got}.values()) == pytest.approx(sum(sizes.values()))
    out = source_mix.mixed_rows(spark.createDataFrame(ROWS, SCHEMA).coalesce(1))
    assert sum(len(WORDS.findall(r.text or "")) for r in out.collect()) == sum(r.mix_taken for r in got)
    assert source_mix.mix(nothing).count() == 0


def test_line_dedup(spark, docs, nothing):
    rows = [(i, f"menu\nown {i}\n\n menu \t", "en", "s" if i % 2 else None) for i in range(30)] + [(99, None, "en", "s"), (98, "", "en", "s"), (97, "menu", "en", "z")]
    got = {r.doc_id: (r.text, r.line_count, r.lines_dropped) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == ("own 0\n", 3, 2) and got[1] == ("own 1\n", 3, 2) and got[99] == (None, 0, 0) and got[98] == ("", 0, 0) and got[97] == ("menu", 1, 0)
    assert line_dedup.drop_boilerplate(docs).count() == len(ROWS) and line_dedup.drop_boilerplate(nothing).count() == 0


def test_lines_of_small_sites_and_repeated_ids(spark):
    """With production parameters a site of four pages loses a line that three of them hold; rows that repeat an id are pages."""
    rows = [(1, "menu\na", "en", "s"), (1, "menu\nb", "en", "s"), (1, "menu\nc", "en", "s"), (2, "d\ne", "en", "s"), (3, "menu", "en", "t"), (4, "menu", "en", "t")]
    clash = [F.lit(1).alias(c) for c in ("site", "salt", "boilerplate", "lines", "kept", "line_count")]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA).select("*", *clash), counts=False)
    assert sorted((r.text, r.line_count, r.site) for r in out.collect()) == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d\ne", 1, 1), ("menu", 1, 1), ("menu", 1, 1)]


def test_vectors(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8))
    v[100:150] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] * 8), (305, [1.0, 2.0]), (320, [1e300, -1e300]), (None, [1.0] * 8), (7, [float(x) for x in v[7]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit(1))
    got = vector_search.nearest(d, d.where("vec_id % 20 = 0"), k=5).collect()
    score = lambda a, b: sum(float(x) * float(y) for x, y in zip(v[a], v[b], strict=True))
    for q in range(0, 300, 20):
        best = sorted(((-score(q, i), i) for i in [*range(300), 7] if i != q))[:5]
        assert [(x.vec_id, x.rank) for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == [(i, k + 1) for k, (_, i) in enumerate(best)]
    assert [x.vec_id for x in got if x.query_id == 320] == [305]
    assert vector_search.nearest(d.limit(0), d.limit(0)).count() == 0


def test_vectors_over_many_cells(spark, monkeypatch):
    """Small bounds make many groups, stripes and tiles; the floor is carried over them."""
    for name, value in (("QUERY_BLOCK", 8), ("CANDIDATE_BLOCK", 16), ("GROUP_BYTES", 8 * 8 * 6), ("STRIPE", 3)):
        monkeypatch.setattr(vector_search, name, value)
    v = np.round(np.random.default_rng(4).normal(size=(500, 6)), 1)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in vector_search.nearest(d, d.where("vec_id % 20 = 0"), k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))

    def score(a, b):  # plain sums from the first component to the last; sum() would compensate
        total = 0.0
        for x, y in zip(v[a].tolist(), v[b].tolist(), strict=True):
            total += x * y
        return total

    want = {q: [(n + 1, i) for n, (_, i) in enumerate(sorted((-score(q, i), i) for i in range(500) if i != q)[:4])] for q in range(0, 500, 20)}
    assert {q: sorted(x) for q, x in got.items()} == want


def test_quality(spark, docs, nothing):
    r = np.random.default_rng(2)
    text = lambda good: " ".join(f"{'thing' if good else '###$'}{x}" for x in r.integers(0, 50, 60))
    rows = [(1000 + i, text(i % 2), "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i, *_ in rows] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, SCHEMA))
    got = quality.classify(d, labels).collect()
    assert len(got) == len(rows) + len(ROWS) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert np.mean([x.predicted == x.doc_id % 2 for x in got if x.doc_id and x.doc_id >= 1000 and x.held_out]) > 0.95
    assert {x.score for x in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0
    assert quality.keep_good(d, labels).count() == sum(x.predicted for x in got)


def test_scores_are_sums_of_table_entries():
    """Scoring by bins against a sum for each row, entry by entry."""
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(400, 5)), 2)
    model = quality.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), rounds=20, pair_rounds=10, n_pairs=3)
    for row, got in zip(x, model.score(x), strict=True):
        at = [sum(1 for e in edges if e <= value) for edges, value in zip(model.edges, row, strict=True)]
        total = model.intercept + sum(model.tables[j][b] for j, b in enumerate(at))
        total += sum(t[at[i] * quality.COARSE // quality.BINS][at[j] * quality.COARSE // quality.BINS] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert got == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)


def test_features_of_a_giant_are_those_of_its_words():
    """A text of several pieces has the features of the same words in one piece."""
    import pyarrow as pa

    short = " ".join(f"g{i % 977}y{i}" for i in range(9000))
    giant = "\n".join([short] * 30)
    assert len(giant) > 2 << 20
    a = dict(zip(quality.NAMES, quality.text_features(pa.array([giant]))[0], strict=True))
    b = dict(zip(quality.NAMES, quality.text_features(pa.array([short]))[0], strict=True))
    assert a["words"] == pytest.approx(np.log1p(270_000)) and a["word_length"] == pytest.approx(b["word_length"], rel=1e-3)
    assert all(a[k] == pytest.approx(b[k], abs=1e-4) for k in quality.NAMES if k.startswith("word_bucket") or k in ("digits", "upper", "short_words"))


def test_training_rows_are_bounded(spark):
    rows = [(i % 40, f"text number {i}", "en", "a") for i in range(4000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    quality.fit = lambda x, y: seen.append(len(x)) or fit(x, y, rounds=2, pair_rounds=1, n_pairs=1)
    try:
        quality.train(spark.createDataFrame(rows, SCHEMA), labels, max_rows=200)
    finally:
        quality.fit = fit
    assert 50 < seen[0] < 400


def test_token_rollup(spark, docs, tmp_path):
    store = token_rollup.TokenRollup(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    counts = token_rollup.signed_counts(docs.withColumn("sign", F.lit(1)))
    assert store.commit("b1", counts) and not store.commit("b1", counts)
    enc = token_rollup._encoding("byte_bpe_50k")
    total = lambda: {(r.source, r.lang): (r.documents, r.tokens) for r in store.totals().collect()}
    want = {}
    for _, t, lang, s in ROWS:
        n, k = want.get((s, lang), (0, 0))
        want[s, lang] = n + 1, k + len(enc.encode_ordinary(t or ""))
    assert total() == want
    revised = spark.createDataFrame([(-1, "c", "es", "ção \x00 é ▁ x"), (1, "c", "es", "new text"), (None, "c", "es", "x")], "sign int, source string, lang string, text string")
    assert store.commit("b2", token_rollup.signed_counts(revised))
    assert total() == want | {("c", "es"): (1, len(enc.encode_ordinary("new text")))}
    store.compact()
    assert total() == want | {("c", "es"): (1, len(enc.encode_ordinary("new text")))} and not store.commit("b1", counts)
    gone = spark.createDataFrame([(-1, "c", "es", "new text")], revised.schema)
    assert store.commit("b3", token_rollup.signed_counts(gone)) and ("c", "es") not in total()
    with pytest.raises(ValueError):
        store.commit("b3", token_rollup.signed_counts(revised))
    assert store.commit("empty", counts.limit(0)) and not store.commit("empty", counts.limit(0))
    assert ("c", "es") not in total()


def test_two_writers_of_a_batch(spark, tmp_path):
    """Of writers that stage the same batch at once, one counts; one that fails before its marker counts for nothing."""
    from concurrent.futures import ThreadPoolExecutor

    store = token_rollup.TokenRollup(spark, f"file://{tmp_path}/store")
    counts = spark.createDataFrame([("a", "en", "v", 1, 10)], token_rollup._SUMS)
    store._staged(counts)
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda _: store.commit("b", counts), range(4)))
    assert sum(won) == 1 and [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 1, 10)]


def test_a_marker_is_made_once_however_many_write_it(spark, tmp_path):
    """A marker has one writer, and is whole when it is seen."""
    from concurrent.futures import ThreadPoolExecutor

    store = token_rollup.TokenRollup(spark, f"file://{tmp_path}/store")
    with ThreadPoolExecutor(8) as pool:
        for k in range(30):
            assert sum(pool.map(lambda w, k=k: store._publish({"sums": f"{w}"}, "batches", f"b{k}"), range(8))) == 1
    assert len(store._markers("batches")) == 30 and not list((tmp_path / "store" / "staged").iterdir())


def test_rollup_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "labels"))
    toxic, low = {r.doc_id for r in labels if r.toxic == 1}, {r.doc_id for r in labels if r.quality == 0}
    want = {}
    for d in docs:
        if d.doc_id not in toxic:
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", d.text or "") if d.doc_id in low else d.text or ""
            for v in ("byte_bpe_50k", "byte_bpe_multi_50k"):
                n, k = want.get((d.source, d.lang, v), (0, 0))
                want[d.source, d.lang, v] = n + 1, k + len(token_rollup._encoding(v).encode_ordinary(text))
    assert toxic and low - toxic
    assert {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in token_rollup.query(spark, sf).collect()} == want


def test_piece_codec(spark, docs, nothing, monkeypatch):
    import public_tokenizers
    import sentencepiece

    monkeypatch.setattr(piece_codec, "CHUNK", 1000)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    extra = [(50, "  a  b\n\n c ", "en", "a"), (51, "▁▁x", "en", "a"), (52, "x" * 3000, "en", "a"), (53, "é\n" * 900 + " \t ", "en", "a")]
    d = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(extra, SCHEMA)).coalesce(1).withColumn("chunk", F.lit(1))
    got = sorted((str(r.doc_id), list(r.ids), r.round_trip) for r in piece_codec.encode(d).collect())
    assert got == sorted((str(i), sp.encode(t or ""), "▁" not in (t or "")) for i, t, *_ in ROWS + extra)
    back = piece_codec.decode(piece_codec.encode(d)).select("doc_id", "decoded_text").collect()
    assert sorted((str(r.doc_id), r.decoded_text) for r in back) == sorted((str(i), (t or "").replace("▁", " ")) for i, t, *_ in ROWS + extra)
    assert piece_codec.encode(nothing).count() == 0


def test_texts_are_read_in_small_batches(spark):
    """Rows hold whole texts: few of them are read from a file at once, unless the session says how many."""
    from lexspark.llm.common import READ

    name = "spark.sql.parquet.columnarReaderBatchSize"
    docs = spark.createDataFrame([(1, "a\nb\na", "s", 5), (2, None, "s", 0), (3, "x\nb", "s", 9), (4, "y\nb", "s", 3)], "doc_id long, text string, source string, n_chars int")
    was = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        out = line_dedup.drop_boilerplate(docs, counts=False, length_col="n_chars")
        assert int(spark.conf.get(name)) == READ
        assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "a\na", 3), (2, None, 0), (3, "x", 1), (4, "y", 1)]
        spark.conf.set(name, 77)
        line_dedup.drop_boilerplate(docs)
        assert int(spark.conf.get(name)) == 77
    finally:
        spark.conf.set(name, was)
