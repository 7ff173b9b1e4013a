"""SentencePiece encoding and decoding.

The packaged model is a BPE one.  A max-plus path over piece scores, the method for
unigram models, doesn't reproduce BPE's merges (README has figures), so texts are
cut where no piece can cross: before a run of blanks after another character, and
before a line feed, which no piece of the model holds.  At such a cut the state
that passes from chunk to chunk has one value, so chunks are encoded independently
and joined as they are.  Giant texts are cut into chunks that are dealt over tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Characters of a chunk; texts up to that are encoded as they are read. Units that a worker remembers.
CHUNK, REMEMBERED = 1 << 16, 1 << 18
_UNIT = re.compile(" +[^ \n]*|\n+[^ \n]*|[^ \n]+")
_codecs: dict = {}


class Codec:
    """Encodes and decodes as the model's own library does, a unit at a time, remembering units."""

    def __init__(self, path: str | None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.blank = self.model.piece_to_id("▁")
        crossing = [p for p in (self.model.id_to_piece(i) for i in range(self.model.vocab_size())) if "\n" in p or "▁" in p.lstrip("▁")]
        if crossing:
            raise ValueError(f"pieces cross the cuts: {crossing[:3]}")
        self.known: dict[str, tuple[int, ...]] = {}
        self.bytes = [self._bytes(i) for i in range(self.model.vocab_size())]

    def _bytes(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[3:-1], 16)])
        if self.model.is_control(i):
            return b""
        if self.model.is_unknown(i):
            return " ⁇ ".encode()
        return self.model.id_to_piece(i).replace("▁", " ").encode()

    def _unit(self, unit: str) -> tuple[int, ...]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if unit[0] == " ":  # the library puts a blank before a text
            ids = self.model.encode(unit[1:]) or [self.blank]
        else:
            ids = self.model.encode(unit)
            assert unit[0] == "\n" and ids[0] == self.blank, unit
            ids = ids[1:]
        self.known[unit] = out = tuple(ids)
        return out

    def encode(self, text: str, first: bool = True) -> list[int]:
        """first: the text's start, before which the model has a blank."""
        if not text:
            return []
        text = text.replace("▁", " ")
        ids: list[int] = []
        known, add = self.known, ids.extend
        for unit in _UNIT.findall(" " + text if first else text):
            add(known[unit] if unit in known else self._unit(unit))
        return ids

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(path: str | None) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Cut before a blank or line feed that follows another character, the first one from each ``size`` on."""
    out, at = [], 0
    cut = re.compile("(?<=[^ \n▁])[ \n▁]")
    while len(text) - at > size:
        m = cut.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def _encoded(model: str | None):
    def run(batches):
        c = codec(model)
        for b in batches:
            ids = [np.array(c.encode(t, k == 0), np.int32) for t, k in zip((x.as_py() or "" for x in b.column(2)), b.column(1).to_pylist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))], ["row", "chunk", "ids"])

    return run


def _cut(batches):
    for b in batches:
        rows = [(r, k, t) for r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, t in enumerate(chunks(text))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["row", "chunk", "text"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>, n_pieces, round_trip.

    ids are those of the model's own library for the whole text.  Null and empty texts
    have none.  round_trip says that decode() gives the text back; it is false only
    where a text holds U+2581, which the model takes for a blank (null counts as
    empty).  Repeated rows are each encoded; other columns are ignored; an empty table
    gives no rows.  A giant text without a place to cut is one chunk.  ``docs`` must
    give the same rows in the same partitions when it is read again (files or a
    checkpoint), as rows are numbered by their place.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches):
        c = codec(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [c.encode(t) for t in texts]
            exact = [c.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(exact)], ["doc_id", "ids", "round_trip"])

    short = d.where(F.length("text") <= CHUNK).select("doc_id", "text").mapInArrow(whole, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>, round_trip boolean")
    giant = d.where(F.length("text") > CHUNK)
    pieces = giant.select("row", "text").mapInArrow(_cut, "row long, chunk int, text string").repartition("row", "chunk")
    made = pieces.mapInArrow(_encoded(model), "row long, chunk int, ids array<int>")
    joined = made.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    back = giant.join(joined, "row").select("doc_id", "ids", "text")

    def check(batches):
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.decode(i) == t for i, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.bool_())], ["doc_id", "ids", "round_trip"])

    long = back.mapInArrow(check, short.schema)
    return short.unionByName(long).select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


def decode(encoded: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``encoded`` with decoded_text; null ids give null."""
    @F.pandas_udf("string")
    def text(ids):
        c = codec(model)
        return ids.map(lambda x: None if x is None else c.decode(x))

    return encoded.withColumn("decoded_text", text(F.col(ids_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
