"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks.  Groups of query blocks and stripes of candidate
blocks make a grid; a task holds a cell's queries and lets its candidates pass, one
block after the other.  The int8 product of two blocks, a tile, gives every inner
product within a known quantisation error; a pair whose upper bound is below its
query's floor can't be among the k nearest.  The floor is the k-th best of what the
cell has seen, or the k-th lower bound of the tile if that is higher.  What is left
is computed again in double precision and merged into the query's heap, and the
heaps of a query's cells are merged last.  The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K, QUERY_BLOCK, CANDIDATE_BLOCK = 20, 512, 2048
#: Bytes of query vectors that a task holds, and blocks of candidates that pass it, at most; both bound a task, so tasks grow with the tables.
GROUP_BYTES, STRIPE = 1 << 24, 64
#: Cells are no larger than that they would leave this many tasks without work.
TASKS = 48
#: Pairs computed again at once; bounds memory when many vectors tie.
CHUNK = 1 << 15


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) without ids or vectors that take no part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(~bad & F.exists("v", lambda x: x != 0))


def _packed(df: DataFrame, size: int) -> DataFrame:
    """(dim, block) with ids and vectors as bytes; each task packs its own rows, ``size`` to a block at most."""

    def pack(batches):
        waiting: dict[int, list] = {}

        def block(dim, rows):
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "ids": pa.array([np.array([r[0] for r in rows], np.int64).tobytes()], pa.binary()),
                "vectors": pa.array([np.array([r[1] for r in rows], np.float64).tobytes()], pa.binary()),
            })

        for b in batches:
            ids, vectors = b.column(0).to_numpy(), b.column(1)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, x in enumerate(ids):
                v = flat[offsets[i] : offsets[i + 1]]
                rows = waiting.setdefault(len(v), [])
                rows.append((x, v))
                if len(rows) == size:
                    yield block(len(v), waiting.pop(len(v)))
        for dim, rows in waiting.items():
            yield block(dim, rows)

    return df.mapInArrow(pack, "dim int, n int, ids binary, vectors binary")


def _quantised(x: np.ndarray):
    """(int8 values as floats, scale, norm of the rounding error, norm of the rounded vector) by row."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    near = q * scale[:, None]
    return q, scale, np.sqrt(((x - near) ** 2).sum(axis=1)), np.sqrt((near**2).sum(axis=1))


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last in double precision."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _survivors(q, c, own: np.ndarray, floor: np.ndarray, k: int, exact_products: type):
    """Index pairs, none of ``own``, that may be among their query's k nearest, of which those below ``floor`` aren't."""
    (qi, qs, qe, _), (ci, cs, ce, cn) = q, c
    near = (qi.astype(exact_products) @ ci.astype(exact_products).T).astype(np.float64) * qs[:, None] * cs[None, :]
    norm = np.sqrt((qi**2).sum(axis=1)) * qs + qe
    slack = norm[:, None] * ce[None, :] + qe[:, None] * cn[None, :]
    slack = slack * (1 + 1e-9) + 1e-12 * (1 + np.abs(near))  # rounding of the bound itself
    if near.shape[1] > k:
        low = np.where(own, -np.inf, near - slack)
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    return np.nonzero((near + slack >= floor[:, None]) & ~own)


class _Block:
    """Queries that a task holds, with a heap of (score, -vec_id) each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.quantised = ids, vectors, _quantised(vectors)
        self.heaps: list[list] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def pass_by(self, ids: np.ndarray, vectors: np.ndarray, quantised, k: int) -> None:
        exact = np.float32 if 127 * 127 * vectors.shape[1] < 1 << 24 else np.float64
        a, b = _survivors(self.quantised, quantised, self.ids[:, None] == ids[None, :], self.floor, k, exact)
        for s in range(0, len(a), CHUNK):
            x, y = a[s : s + CHUNK], b[s : s + CHUNK]
            for i, n, score in zip(x.tolist(), ids[y].tolist(), _inner(self.vectors[x], vectors[y]).tolist(), strict=True):
                h, new = self.heaps[i], (score, -n)
                if len(h) < k:
                    heapq.heappush(h, new)
                elif new > h[0]:
                    heapq.heapreplace(h, new)
        self.floor = np.array([h[0][0] if len(h) == k else -np.inf for h in self.heaps])

    def best(self):
        rows = [(q, s, -n) for q, h in zip(self.ids.tolist(), self.heaps, strict=True) for s, n in h]
        return pa.RecordBatch.from_pydict({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[2] for r in rows], pa.int64()), "score": pa.array([r[1] for r in rows], pa.float64())})


def _cell_search(k: int):
    """Rows (cell, is_candidate, dim, ids, vectors), a cell's queries before its candidates -> (query_id, vec_id, score)."""

    def search(batches):
        at, held = None, []
        for batch in batches:
            for t in range(batch.num_rows):
                cell, passing, dim, ids, vectors = (batch.column(n)[t].as_py() for n in ("cell", "is_candidate", "dim", "ids", "vectors"))
                if cell != at:
                    yield from (b.best() for b in held)
                    at, held = cell, []
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)
                if passing:
                    quantised = _quantised(vectors)
                    for block in held:
                        block.pass_by(ids, vectors, quantised, k)
                else:
                    held.append(_Block(ids, vectors))
        yield from (b.best() for b in held)

    return search


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` by inner product: query_id, rank, vec_id, score.

    Exact: nearest first, ties to the smaller vec_id; all candidates if there are
    fewer than ``k``.  Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components take no part.  A query meets vectors of its own length
    only, and never rows of its own id.  Every other row is a candidate, rows that
    repeat an id too.  Of queries that share an id one is used, the first by its
    vector.  Empty tables give no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    own = _clean(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    numbered = lambda df: df.withColumn("number", F.monotonically_increasing_id())
    q = scratch.table(numbered(_packed(own, QUERY_BLOCK)), "queries")
    c = scratch.table(numbered(_packed(_clean(vectors, id_col, vector_col), CANDIDATE_BLOCK)), "candidates")
    # the grid of each dimension: as many groups of queries and stripes of candidates as the bounds ask for
    count = lambda df, n: df.groupBy("dim").agg(F.count(F.lit(1)).alias(n))
    groups = F.ceil(F.col("q_blocks") * QUERY_BLOCK * F.col("dim") * 8 / GROUP_BYTES)
    stripes = F.greatest(F.ceil(F.col("c_blocks") / STRIPE), F.least("c_blocks", F.ceil(TASKS / groups)))
    grid = scratch.table(count(q, "q_blocks").join(count(c, "c_blocks"), "dim").select("dim", groups.alias("groups"), stripes.alias("stripes")), "grid")
    cells = grid.agg(F.sum(F.col("groups") * F.col("stripes"))).first()[0] or 1
    deal = lambda df, n: df.join(grid, "dim").withColumn("own", F.pmod(F.xxhash64("number"), F.col(n)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")
    held = deal(q, "groups").select("dim", F.col("own").alias("group"), upto("stripes"), F.lit(False).alias("is_candidate"), "ids", "vectors").withColumnRenamed("other", "stripe")
    passing = deal(c, "stripes").select("dim", upto("groups"), F.col("own").alias("stripe"), F.lit(True).alias("is_candidate"), "ids", "vectors").withColumnRenamed("other", "group")
    met = held.unionByName(passing).withColumn("cell", F.struct("dim", "group", "stripe")).repartition(min(cells, 1 << 15), "cell").sortWithinPartitions("cell", "is_candidate")
    best = met.select("cell", "is_candidate", "dim", "ids", "vectors").mapInArrow(_cell_search(k), "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(v, v.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
