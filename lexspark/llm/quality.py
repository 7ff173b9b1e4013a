"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts of characters and word shapes, and the rates of words by hashed
bucket.  Each feature has a lookup table over quantile bins, each chosen pair of
features one over coarse bins.  Tables are the sums of shallow trees, boosted in
cycles over the features on histograms.  A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .shingles import _SPACE, PIECE, _words

#: Labelled rows that the model is fitted on, at most: a hash-random sample above that.
MAX_TRAINING_ROWS = 100_000
THRESHOLD = 0.3
BINS, COARSE = 32, 8
#: Buckets that words are hashed to; the rate of each is a feature.
WORD_BUCKETS = 24
_PUNCT = np.zeros(256, np.uint8)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def _flags(*ranges) -> np.ndarray:
    x = np.zeros(256, np.uint8)
    for a, b in ranges:
        x[a : b + 1] = 1
    return x


#: Byte classes that are counted: upper, lower, digit, symbols but . and , then . , newline | non-ASCII, white space.
_CLASSES = [_flags((65, 90)), _flags((97, 122)), _flags((48, 57)), _PUNCT - _flags((44, 44), (46, 46)), _flags((46, 46)), _flags((44, 44)), _flags((10, 10)), _flags((124, 124)), _flags((128, 255)), _SPACE.astype(np.uint8)]
NAMES = ("bytes", "words", "word_length", "upper", "digits", "symbols", "stops", "commas", "newlines", "pipes", "non_ascii", "distinct", "commonest", "repeats", "odd_ends", "distinct_runs", "short_words", "long_words", "upper_starts",
         *(f"word_bucket_{k}" for k in range(WORD_BUCKETS)))


class _Sums:
    """What is added up over the pieces of one text."""

    def __init__(self):
        self.classes, self.words, self.ends = np.zeros(len(_CLASSES) + 1), [], np.zeros(4)

    def features(self) -> np.ndarray:
        size, c = self.classes[-1], self.classes
        w = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        n = max(1, len(w))
        ink = max(1.0, size - c[9])
        _, counts = np.unique(w, return_counts=True)
        runs = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7) if len(w) > 2 else w
        letters = max(1.0, c[0] + c[1])
        buckets = np.bincount(((w >> np.uint64(32)) % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS)
        return np.array([
            np.log1p(size), np.log1p(len(w)), ink / n, c[0] / letters, c[2] / ink, c[3] / ink, c[4] / n, c[5] / n, c[6] / n, c[7] / n, c[8] / ink,
            len(counts) / n, counts.max(initial=0) / n, (w[1:] == w[:-1]).sum() / n, self.ends[0] / n, len(np.unique(runs)) / max(1, len(runs)), self.ends[1] / n, self.ends[2] / n, self.ends[3] / n, *(buckets / n),
        ])


def _add(sums: list[_Sums], buf: np.ndarray, bounds: np.ndarray) -> None:
    """Add texts that stand in buf at bounds, one after the other."""
    if not len(buf):
        return
    first_of = bounds[:-1]
    words, first = _words(buf, first_of[first_of < len(buf)])
    space = np.concatenate([_SPACE[buf], [True]])
    space_at = np.nonzero(space)[0]
    end = np.minimum(space_at[np.searchsorted(space_at, first)], bounds[np.searchsorted(bounds, first, "right")])
    per_class = [np.concatenate([[0], np.cumsum(x[buf], dtype=np.int64)])[bounds] for x in _CLASSES]
    last, length, start = buf[end - 1], end - first, buf[first]
    odd = (_PUNCT[last] == 1) & (last != 44) & (last != 46)
    marks = [np.concatenate([[0], np.cumsum(x)]) for x in (odd, length <= 3, length > 12, (start >= 65) & (start <= 90))]
    at = np.searchsorted(first, bounds)
    for i, s in enumerate(sums):
        s.classes[:-1] += [c[i + 1] - c[i] for c in per_class]
        s.classes[-1] += bounds[i + 1] - bounds[i]
        s.words.append(words[at[i] : at[i + 1]])
        s.ends += [m[at[i + 1]] - m[at[i]] for m in marks]


def text_features(texts) -> np.ndarray:
    """A row of NAMES for each text of an Arrow string array; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, at = np.zeros((len(texts), len(NAMES))), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        sums = [_Sums() for _ in range(upto - at)]
        lo, hi = int(offsets[at]), int(offsets[upto])
        if hi - lo <= PIECE:
            _add(sums, data[lo:hi], offsets[at : upto + 1] - lo)
        else:
            while lo < hi:
                end = min(hi, lo + PIECE)
                while end < hi and not _SPACE[data[end]]:
                    end += 1
                _add(sums, data[lo:end], np.array([0, end - lo]))
                lo = end
        for i, s in enumerate(sums):
            out[at + i] = s.features()
        at = upto
    return out


@dataclass
class Model:
    intercept: float
    edges: list
    tables: np.ndarray
    pairs: list
    pair_tables: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        b = _binned(x, self.edges)
        total = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i] * COARSE // BINS, b[:, j] * COARSE // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _binned(x: np.ndarray, edges: list) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, cut) of the best cut of a histogram; the left side has bins below cut."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """Leaf values by bin of a greedy tree over a histogram."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b], ridge), a, b) for a, b in parts), default=None)
        if best is None or best[0] <= 1e-9:
            break
        _, cut, a, b = best
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values of a tree that cuts one feature, then the other on each side."""
    best, value = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            sides = [(a[:cut].sum(0), b[:cut].sum(0)), (a[cut:].sum(0), b[cut:].sum(0))]
            found = [_split(x, y, ridge) for x, y in sides]
            gain = sum(f[0] for f in found) + sum(x.sum() ** 2 / (y.sum() + ridge) for x, y in sides)
            if gain > best:
                v = np.zeros_like(a)
                for rows, (x, y), (_, c) in zip((slice(None, cut), slice(cut, None)), sides, found, strict=True):
                    v[rows, :c], v[rows, c:] = x[:c].sum() / (y[:c].sum() + ridge), x[c:].sum() / (y[c:].sum() + ridge)
                best, value = gain, v.T if turn else v
    return value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 10, rate: float = 0.15, ridge: float = 2.0) -> Model:
    """Main effects first, in cycles; then the pairs with most left to explain. No rows: all scores are 0.5."""
    if not len(x):
        return Model(0.0, [], np.zeros((0, BINS)), [], np.zeros((0, COARSE, COARSE)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    b = np.ascontiguousarray(_binned(x, edges).T)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    total = np.full(len(y), np.log(mean / (1 - mean)))
    model = Model(float(total[0]), edges, np.zeros((len(b), BINS)), [], np.zeros((0, COARSE, COARSE)))

    def gradient():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, at in enumerate(b):
            g, h = gradient()
            step = rate * _tree(np.bincount(at, g, BINS), np.bincount(at, h, BINS), ridge)
            model.tables[j] += step
            total += step[at]
    coarse = b * COARSE // BINS
    both = lambda i, j, v: np.bincount(coarse[i] * COARSE + coarse[j], v, COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = gradient()
    gains = sorted(((float((both(i, j, g) ** 2 / (both(i, j, h) + ridge)).sum()), i, j) for i in range(len(b)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:n_pairs]]
    model.pair_tables = np.zeros((len(model.pairs), COARSE, COARSE))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = gradient()
            step = rate * _pair_tree(both(i, j, g), both(i, j, h), ridge)
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(id_col: str):
    """crc32 of the id as text, modulo 5, is 0; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model of the labelled rows of ``docs`` that aren't held out: of a hash-random sample of ``max_rows``, if there are more.

    Labels are sampled before their texts are read, and written, so that the texts are
    filtered by a small table; rows are sampled again if repeated ids multiply them.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)

    def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
        return df if n <= max_rows else df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int((1 << 30) * (max_rows / n)))

    own = labels.select(F.col("doc_id").cast("long").alias("id"), "quality").where("quality is not null and id is not null").where(~held_out("id"))
    own = scratch.table(sampled(own, own.count(), "id"), "labels")

    def run(batches):
        for b in batches:
            x = text_features(b.column(2))
            flat = pa.array(x.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), flat)], ["id", "quality", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(own, "id")
    rows = scratch.table(texts.select("id", F.col("quality").cast("double"), "text").mapInArrow(run, "id long, quality double, x array<float>").withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = sampled(rows, rows.count(), "row").select("id", "quality", "x").toArrow().sort_by([("id", "ascending"), ("quality", "ascending")])
    x = np.array(rows["x"].combine_chunks().flatten(), np.float64).reshape(-1, len(NAMES))
    return fit(x, rows["quality"].to_numpy().astype(float))


def _scores(model: Model, texts) -> np.ndarray:
    return model.score(text_features(texts).astype(np.float32).astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score rests on the text alone.  Null and empty texts are scored alike, very
    long ones are read in pieces.  Rows of repeated ids are each scored; a label of a
    repeated id counts for each of its rows.  Without labels every score is 0.5.  An
    empty table gives no rows.  Other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)))], ["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that classify() predicts 1 for, scored as they are read, without a shuffle of texts."""
    model = train(docs, labels, id_col, text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
