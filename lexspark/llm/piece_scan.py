"""Best-sum (unigram) piece encoding by a max-plus parallel scan.

A text is cut into chunks anywhere.  Between two chunks the state is the number of
characters by which the piece that crosses the cut reaches into the next chunk.  Each
chunk gives the matrix of best sums from every state before it to every state after
it; max-plus products of these matrices are associative, so a prefix of them gives the
best sum up to each cut, and going back through them the states of the best path.
With its two states known each chunk is traced on its own.

The packaged model is a BPE one, whose encoding this is not (README); the scan is for
vocabularies of pieces with scores that are to be encoded by their best sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

CHUNK = 1 << 15
#: What a character that no piece covers costs beyond the worst piece.
UNKNOWN_COST = 10.0


class Lattice:
    """Pieces with their ids and scores."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        self.of = {p: (i, s) for i, (p, s) in enumerate(pieces) if p}
        self.reach = max(map(len, self.of), default=1)
        self.unknown = unknown, min((s for _, s in self.of.values()), default=0.0) - UNKNOWN_COST

    def steps(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(length, id, score) of the pieces that start at a place; a character without a piece of its own is one unknown."""
        out = [(n, *self.of[p]) for n in range(1, min(self.reach, len(text) - at) + 1) if (p := text[at : at + n]) in self.of]
        return out if out and out[0][0] == 1 else [(1, *self.unknown), *out]

    def transfer(self, text: str, size: int) -> np.ndarray:
        """text: a chunk of ``size`` characters and up to reach - 1 after it -> best sums, by state before and state after."""
        best = np.full((size + self.reach, self.reach), -np.inf)
        best[np.arange(self.reach), np.arange(self.reach)] = 0
        for at in range(size):
            if (row := best[at]).max() > -np.inf:
                for n, _, score in self.steps(text, at):
                    np.maximum(best[at + n], row + score, out=best[at + n])
        return best[size : size + self.reach].T

    def trace(self, text: str, size: int, before: int, after: int) -> list[int]:
        """Ids of the best path of a chunk between its two states."""
        best, how = np.full(size + self.reach, -np.inf), [None] * (size + self.reach)
        best[before] = 0
        for at in range(before, size):
            if best[at] > -np.inf:
                for n, piece, score in self.steps(text, at):
                    if best[at] + score > best[at + n]:
                        best[at + n], how[at + n] = best[at] + score, (at, piece)
        at, ids = size + after, []
        while at > before:
            at, piece = how[at]
            ids.append(piece)
        return ids[::-1]


def states(matrices: list[np.ndarray]) -> list[int]:
    """The states around the chunks of a text, from 0 at its start to 0 at its end, of the best path."""
    sums = [np.where(np.arange(len(matrices[0])) == 0, 0.0, -np.inf)]
    for m in matrices:
        sums.append((sums[-1][:, None] + m).max(axis=0))
    out = [0]
    for s, m in zip(reversed(sums[:-1]), reversed(matrices), strict=True):
        out.append(int(np.argmax(s + m[:, out[-1]])))
    return out[::-1]


def encode(docs: DataFrame, pieces: list[tuple[str, float]], unknown: int = 0, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>, of the sequence of pieces with the largest sum of scores.

    A blank stands before each text, and blanks are ▁ in pieces.  Null and empty texts
    have no pieces.  Of paths of equal sums one is taken.  Chunks of a very long text
    are worked on by many tasks; a text's matrices, a few kilobytes a chunk, meet in
    one.  Repeated rows are each encoded; an empty table gives no rows; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    lattice, scratch = Lattice(pieces, unknown), Scratch(docs.sparkSession)
    written = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = scratch.table(written, "texts")

    def cut(batches):
        for b in batches:
            out = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = "▁" + text.replace(" ", "▁")
                out += [(row, k, min(chunk, len(text) - at), text[at : at + chunk + lattice.reach - 1]) for k, at in enumerate(range(0, len(text), chunk))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["row", "chunk", "size", "text"])

    def transfers(batches):
        for b in batches:
            made = [lattice.transfer(t, n).tobytes() for n, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["row", "chunk", "matrix"])

    def scanned(batches):
        for b in batches:
            found = [states([np.frombuffer(m, np.float64).reshape(lattice.reach, -1) for m in ms]) for ms in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["row", "states"])

    def traced(batches):
        for b in batches:
            ids = [lattice.trace(t, n, s, e) for n, t, s, e in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["row", "chunk", "ids"])

    parts = scratch.table(rows.where("text <> ''").select("row", "text").mapInArrow(cut, "row long, chunk int, size int, text string").repartition("row", "chunk"), "parts")
    several = parts.groupBy("row").agg(F.max("chunk").alias("last")).where("last > 0").select("row")
    matrices = parts.join(several, "row", "left_semi").mapInArrow(transfers, "row long, chunk int, matrix binary")
    whole = matrices.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("m")).select("row", F.transform("m", lambda x: x["matrix"]).alias("m"))
    known = scratch.table(whole.mapInArrow(scanned, "row long, states array<int>"), "states")
    around = parts.join(known, "row", "left")
    state = lambda k: F.coalesce(F.get("states", F.col("chunk") + k), F.lit(0))  # noqa: E731, a text of one chunk starts and ends with state 0
    ids = around.select("row", "chunk", "size", "text", state(0).alias("before"), state(1).alias("after")).mapInArrow(traced, "row long, chunk int, ids array<int>")
    joined = ids.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("row", "doc_id").join(joined, "row", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
