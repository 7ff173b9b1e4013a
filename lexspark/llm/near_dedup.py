"""Near dedup by HyperMinHash.

A text's set is its distinct five-word shingles.  Rows of equal sets become one
node, named by its first row.  A node's sketch has 160 registers.  In each round every
shingle falls into one register; a register keeps the least hash of the first round
that reaches it, as a leading-zero count and ten mantissa bits.  So a register of two
sets agrees with the probability of their similarity whatever the sets' sizes, and
texts of every length go one way: forty bands of four registers deal the nodes to
buckets, a collision-corrected estimate admits candidate pairs, full sets confirm.

No bucket is expanded into all its pairs.  Every bucket first links its members
to one hub; connected members need nothing more.  What is open after that in small
buckets is settled between components.  Members of large open buckets are dealt anew by
an exact prefix filter on rare shingles, again hub by hub; what is still open
meets as blocks of sets, each pair of blocks once, so no link is capped away.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .shingles import _mix, shingle_sets

REGISTERS, BAND, MANTISSA = 160, 4, 10
#: Open groups of up to SMALL nodes are settled pair by pair, others as blocks.
SMALL, HUB_ROUNDS = 16, 3
#: Sets and hashes of a block, as expected.
BLOCK, BLOCK_HASHES = 128, 1 << 17
#: Linked if 100 * intersection >= 75 * union.
PERCENT = 75
_SIGMAS = 6
#: Hashes of a round or of several short ones that are dealt to registers at once.
_AT_ONCE = 2048
_VALUE = 48
_seeds = np.random.Generator(np.random.PCG64(75)).integers(0, 1 << 63, 2 * REGISTERS + REGISTERS // BAND, dtype=np.uint64)
_ROUND, _LAST, _BAND_SEED = _seeds[:REGISTERS], _seeds[REGISTERS : 2 * REGISTERS], _seeds[2 * REGISTERS :]


def _least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The hash that each register keeps, of _VALUE bits.

    Registers that no round has reached after as many rounds as there are registers
    take the least hash of a last round of their own, so none stays empty.
    """
    value = np.zeros(REGISTERS, np.uint64)
    waits = np.ones(REGISTERS, bool)
    low, at = np.uint64((1 << _VALUE) - 1), np.arange(REGISTERS, dtype=np.uint64)
    done = 0
    while done < REGISTERS and waits.any():
        turns = min(max(1, _AT_ONCE // len(hashes)), REGISTERS - done)
        x = _mix(hashes ^ _ROUND[done : done + turns, None])
        register = ((x >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        x = np.sort((register << np.uint64(56) | at[:turns, None] << np.uint64(_VALUE) | x & low).ravel())
        first = np.minimum(np.searchsorted(x, at << np.uint64(56)), len(x) - 1)
        new = waits & (x[first] >> np.uint64(56) == at)
        value[new] = x[first][new] & low
        waits &= ~new
        done += turns
    if waits.any():
        value[waits] = (_mix(hashes ^ _LAST[waits, None]) & low).min(axis=1)
    return value


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set that isn't empty: leading zeros and mantissa of the least hashes."""
    m, e = np.frexp(_least_hashes(hashes).astype(np.float64))
    mantissa = np.where(m > 0, (m * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return ((_VALUE - e) << MANTISSA).astype(np.uint16) | mantissa


def _sketched(batches):
    """(doc_id, text, text_key) -> (doc_id, text_key, n, digest, sketch)."""
    for b in batches:
        n, digest, sketch = [], [], []
        for s in shingle_sets(b.column(1)):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketch.append(_sketch(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "text_key", "n", "digest", "sketch"])


def _registers(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _dealt(batches):
    """(nid, sketch) -> (key, nid), a row for each band; a key names band and registers."""
    for b in batches:
        if b.num_rows:
            key = _mix(np.ascontiguousarray(_registers(b.column(1))).view(np.uint64) ^ _BAND_SEED).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), key.shape[1]))], ["key", "nid"])


def _cells(n: np.ndarray) -> np.ndarray:
    """Probabilities of the leading-zero counts of a register, by set size."""
    ends = np.exp(-(np.maximum(n, 1)[:, None] / REGISTERS) * 2.0 ** -np.append(np.arange(_VALUE), np.inf))
    return np.diff(ends, axis=1) / (1 - ends[:, :1])


def _corrected(same, chance):
    """Jaccard estimate from the share of registers that agree; some agree by chance though they keep different hashes."""
    return (same - chance) / (1 - chance)


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches (rows of registers) of sets of those sizes."""
    return _corrected((a == b).mean(axis=1), (_cells(na) * _cells(nb)).sum(axis=1) / (1 << MANTISSA))


_LIKELY = PERCENT / 100 - _SIGMAS * (0.25 / REGISTERS) ** 0.5


def _likely(batches):
    """(a, b, sketch and size of a, of b) -> the pairs (a, b) whose estimate is near the threshold."""
    for x in batches:
        if x.num_rows:
            j = estimated(_registers(x.column(2)), _registers(x.column(4)), x.column(3).to_numpy().astype(float), x.column(5).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(j >= _LIKELY))


def _sets_of(batches):
    """(nid, text) -> (nid, hashes), sorted."""
    for b in batches:
        nid, sets, size = [], [], 0
        for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
            nid.append(i)
            sets.append(np.sort(s.view(np.int64)))
            size += len(s)
            if size > 1 << 20:
                yield _set_rows(nid, sets)
                nid, sets, size = [], [], 0
        if nid:
            yield _set_rows(nid, sets)


def _set_rows(nid, sets):
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(nid, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["nid", "hashes"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges: (a, b) -> (nid, comp), comp the smallest reachable node, for nodes with edges.

    Each round takes the least label of all neighbours, then jumps to the label's
    own label, so long chains shrink fast.  Everything stays in tables.
    """
    both = scratch.table(edges.select(F.col("a").alias("nid"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("nid"), F.col("a").alias("other"))), f"{name}-both")
    labels, last = scratch.table(both.groupBy("nid").agg(F.least(F.min("other"), F.col("nid")).alias("comp")), f"{name}-0"), 0
    while True:
        heard = both.join(labels.select(F.col("nid").alias("other"), F.col("comp").alias("said")), "other").groupBy("nid").agg(F.min("said").alias("said"))
        least = labels.join(heard, "nid").select("nid", F.col("comp").alias("was"), F.least("comp", "said").alias("comp"))
        jumped = least.join(labels.select(F.col("nid").alias("comp"), F.col("comp").alias("up")), "comp", "left")
        new = scratch.table(jumped.select("nid", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), f"{name}-{last + 1}")
        changed = new.where("comp < was").limit(1).count()
        scratch.drop(f"{name}-{last}")
        labels, last = new.select("nid", "comp"), last + 1
        if not changed:
            scratch.drop(f"{name}-both")
            return labels


class _Links:
    """Components of the verified links so far, and how to verify more."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, scratch: Scratch):
        self.nodes, self.sets, self.scratch, self.labels, self.round = nodes.select("nid", "n", "sketch"), sets, scratch, None, 0

    def add(self, pairs: DataFrame) -> None:
        """pairs: (a, b); components follow those that are linked."""
        self.round += 1
        side = lambda x: self.nodes.select(F.col("nid").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
        p = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
        likely = self.scratch.table(p.select("a", "b", "sa", "na", "sb", "nb").mapInArrow(_likely, "a long, b long"), f"likely-{self.round}")
        sets = lambda x: self.sets.select(F.col("nid").alias(x), F.col("hashes").alias(f"h{x}"))
        met = likely.join(sets("b"), "b").join(sets("a"), "a").withColumn("both", F.size(F.array_intersect("ha", "hb")).cast("long"))
        linked = met.where(f"both > 0 and 100 * both >= {PERCENT} * (size(ha) + size(hb) - both)")
        new = self.scratch.table(linked.select("a", "b"), f"edges-{self.round}")
        self.take(new)
        self.scratch.drop(f"likely-{self.round}", f"edges-{self.round}")

    def take(self, new: DataFrame) -> None:
        """Verified links between components join these; earlier components count as single nodes, so no earlier link is read again."""
        if self.labels is not None:
            label = lambda x: self.labels.select(F.col("nid").alias(x), F.col("comp").alias(f"c{x}"))
            lifted = new.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            new = self.scratch.table(lifted.where("a <> b").distinct(), f"lifted-{self.round}")
        if not new.limit(1).count():
            return
        up = components(new, self.scratch, f"labels-{self.round}")
        if self.labels is not None:
            moved = self.labels.join(up.select(F.col("nid").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("nid", F.coalesce("up", "comp").alias("comp"))
            fresh = up.join(self.labels.select("nid"), "nid", "left_anti").select("nid", "comp")
            up = self.scratch.table(moved.unionByName(fresh), f"all-labels-{self.round}")
            self.scratch.drop(f"lifted-{self.round}")
        self.labels = up

    def of(self, members: DataFrame) -> DataFrame:
        """members with comp: their component so far."""
        if self.labels is None:
            return members.withColumn("comp", F.col("nid"))
        return members.join(self.labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))

    def open(self, members: DataFrame, keys: list[str], name: str, turn: int = 0) -> DataFrame:
        """members (keys, nid, weight) of groups that hold several components, with comp, the group's size and a hub.

        weight says how much of its groups a node shares, so an original outweighs its
        copies.  The hub is a group's heaviest node; on later turns it is the heaviest,
        then any node, outside of that one's component.
        """
        m = self.scratch.table(self.of(members), f"{name}-members-{self.round}")
        heaviest = lambda w: F.max(F.struct(w, (-F.col("nid")).alias("least"), "comp"))
        stats = m.groupBy(*keys).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), heaviest("weight").alias("top"), F.count(F.lit(1)).alias("size")).where("lo < hi")
        m = self.scratch.table(m.join(self.scratch.table(stats.select(*keys, "top", "size"), f"{name}-groups-{self.round}"), keys), f"{name}-open-{self.round}")
        self.scratch.drop(f"{name}-members-{self.round}", f"{name}-groups-{self.round}")
        if turn:
            by = F.col("weight") if turn == 1 else F.xxhash64("nid", F.lit(turn)).alias("weight")
            m = m.drop("top").join(self.scratch.table(m.where("comp <> top.comp").groupBy(*keys).agg(heaviest(by).alias("top")), f"{name}-hubs-{self.round}"), keys)
        return m.withColumns({"hub": -F.col("top.least"), "hub_comp": F.col("top.comp")}).drop("top")


def _hub_pairs(m: DataFrame) -> DataFrame:
    return m.where("comp <> hub_comp").select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b"))


def _cross_pairs(m: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a group's members in different components."""
    x, y = (m.select(*keys, F.col("nid").alias(v), F.col("comp").alias(f"c{v}")) for v in "ab")
    return x.join(y, keys).where("a < b and ca <> cb").select("a", "b")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of links that connect all that the links (a, b) connect, without a cycle."""
    top: dict = {}

    def root(x):
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            top[x] = y
            keep.append(i)
    return keep


def _common(x, y, sizes_x, sizes_y) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, from the product of their incidence matrices, some shared hashes at a time."""
    shared = np.intersect1d(x, y)
    both = np.zeros((len(sizes_x), len(sizes_y)), np.float32)
    for k in range(0, len(shared), 8192):
        part, incidence = shared[k : k + 8192], []
        for v, sizes in ((x, sizes_x), (y, sizes_y)):
            at = np.searchsorted(part, v)
            hit = at < len(part)
            hit[hit] = part[at[hit]] == v[hit]
            one = np.zeros((len(sizes), len(part)), np.float32)
            one[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
            incidence.append(one)
        both += incidence[0] @ incidence[1].T
    return both.astype(np.int64)


def _block(members):
    """One row's array of (nid, comp, n, sketch, hashes), as arrays."""
    x = members.values
    return *(x.field(f).to_numpy() for f in ("nid", "comp", "n")), _registers(x.field("sketch")), x.field("hashes").flatten().to_numpy()


def _tile_links(batches):
    """Rows of two blocks -> links between different components, as many as connect what the tile connects."""
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            (na, ca, sa, ka, ha), (nb, cb, sb, kb, hb) = _block(left), _block(right)
            same = np.stack([(ka == k).mean(axis=1) for k in kb], axis=1)
            likely = (_corrected(same, _cells(sa) @ _cells(sb).T / (1 << MANTISSA)) >= _LIKELY) & (ca[:, None] != cb[None, :])
            if likely.any():
                both = _common(ha, hb, sa, sb)
                i, j = np.nonzero(likely & (both > 0) & (100 * both >= PERCENT * (sa[:, None] + sb[None, :] - both)))
                keep = _forest(ca[i], cb[j])
                p, q = na[i[keep]], nb[j[keep]]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), pa.int64()), pa.array(np.maximum(p, q), pa.int64())], ["a", "b"])


def _tiled_pairs(m: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """m: (key, nid, comp, size), members of large groups -> links that connect what a group's links across components connect.

    A node belongs to the largest of its groups, whose nodes are dealt to blocks at
    random, so blocks are few and full.  Two blocks meet once if they share a key; of
    keys that stand in the same blocks only one is asked.
    """
    own = scratch.table(m.groupBy("nid", "comp").agg(F.max(F.struct("size", "key")).alias("top")).join(nodes.select("nid", "n"), "nid"), "tile-nodes")
    room = own.groupBy("top").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES)).alias("blocks"))
    placed = scratch.table(own.join(room, "top").select("nid", "comp", F.xxhash64("top", F.pmod(F.xxhash64("nid"), F.col("blocks"))).alias("block")), "tile-blocks")
    at = scratch.table(m.select("key", "nid").join(placed.select("nid", "block"), "nid").select("key", "block").distinct(), "block-keys")
    stands = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("block")).alias("x"), F.bit_xor(F.xxhash64("block", F.lit(1))).alias("y"))
    asked = at.join(stands.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    met = asked.join(asked.withColumnRenamed("block", "other"), "key").where("block <= other").select("block", "other").distinct()
    full = placed.join(sets, "nid").join(nodes.select("nid", "n", "sketch"), "nid")
    blocks = scratch.table(full.groupBy("block").agg(F.collect_list(F.struct("nid", "comp", "n", "sketch", "hashes")).alias("members")), "blocks")
    pairs = met.join(blocks.withColumnRenamed("members", "left"), "block").join(blocks.select(F.col("block").alias("other"), F.col("members").alias("right")), "other")
    return pairs.select("left", "right").mapInArrow(_tile_links, "a long, b long")


def _rare_prefixes(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """sets: (nid, hashes) -> (key, nid, n, df): each set's rarest shingles, as many as any partner must share one of, that others have too."""
    shingles = sets.select("nid", F.size("hashes").alias("n"), F.explode("hashes").alias("key"))
    common = scratch.table(shingles.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    known = shingles.join(common, "key")
    # shingles of one text only come first in the order and take their share of the prefix
    ranked = known.groupBy("nid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("own"))
    length = F.expr(f"int(n - (n * {PERCENT} + 99) div 100 + 1 - (n - size(own)))")
    return ranked.select("nid", "n", F.explode(F.slice("own", F.lit(1), F.greatest(length, F.lit(0)))).alias("k")).select(F.col("k.key").alias("key"), "nid", "n", "k.df")


def _weighed(members: DataFrame, size_col: str) -> DataFrame:
    """members with weight, the summed sizes of their node's groups, in place of the sizes."""
    return members.join(members.groupBy("nid").agg(F.sum(size_col).alias("weight")), "nid").drop(size_col)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of non-white-space, A-Z lower-cased; fewer than five words make one
    shingle.  Null, empty and blank texts have no shingles and are linked with nothing:
    they are kept.  component_id is the smallest id of the component (null ids don't
    count unless all are null); rows that repeat an id share its fate, and rows that
    repeat a text are one node.  Shingles are compared as 64-bit hashes and sets told
    apart by 128-bit digests.  A very long text is read in pieces, as a whole set; an
    empty table gives no rows; other columns are ignored.  A pair at exactly the
    threshold shares no band with a probability of 2.5e-7, whatever its size.  Texts
    are read twice, and found again by a 128-bit digest.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text_key"))
    made = d.mapInArrow(_sketched, "doc_id long, text_key binary, n long, digest binary, sketch binary")
    read = scratch.table(made.withColumn("row", F.monotonically_increasing_id()), "sketched")
    named = scratch.table(read.where("n > 0").groupBy("digest").agg(F.min("row").alias("nid"), F.min("doc_id").alias("min_doc")), "named")
    nodes = scratch.table(read.select(F.col("row").alias("nid"), "n", "sketch", "text_key").join(named.select("nid"), "nid", "left_semi"), "nodes")
    rows = scratch.table(nodes.select("nid", "sketch").mapInArrow(_dealt, "key long, nid long"), "dealt")
    shared = scratch.table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    members = scratch.table(_weighed(scratch.table(rows.join(shared, "key"), "shared-rows"), "size"), "members")
    scratch.drop("dealt", "shared", "shared-rows")
    wanted = scratch.table(nodes.select("nid", "text_key").join(members.select("nid").distinct(), "nid", "left_semi"), "wanted")
    texts = d.select("text_key", "text").dropDuplicates(["text_key"]).join(wanted, "text_key")  # copies are met before the shuffle
    sets = scratch.table(texts.select("nid", "text").mapInArrow(_sets_of, "nid long, hashes array<long>"), "sets-read")
    links = _Links(nodes, sets, scratch)
    links.add(_hub_pairs(links.open(members, ["key"], "bucket")))
    scratch.drop("bucket-open-0")
    left = links.open(members, ["key"], "bucket")
    scratch.drop("members")
    links.add(_cross_pairs(left.where(f"size <= {SMALL}"), ["key"]))
    large = links.of(left.where(f"size > {SMALL}").select("key", "nid")).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    hard = scratch.table(left.join(large, "key", "left_semi").select("nid").distinct(), "hard")
    if hard.limit(1).count():
        tokens = scratch.table(_rare_prefixes(sets.join(hard, "nid"), scratch), "token-rows")
        tokens = scratch.table(_weighed(tokens, "df"), "tokens")
        scratch.drop("common", "token-rows")
        for i in range(HUB_ROUNDS):
            round_before = links.round
            links.add(_hub_pairs(links.open(tokens, ["key"], f"token{i}", i)))
            scratch.drop(f"token{i}-open-{round_before}", f"token{i}-hubs-{round_before}")
        rest = links.open(tokens, ["key"], "rest")
        links.add(_cross_pairs(rest.where(f"size <= {SMALL}"), ["key"]))
        tiled = scratch.table(_tiled_pairs(rest.where(f"size > {SMALL}"), nodes, sets, scratch), "tiled")
        links.round += 1
        links.take(tiled)
    member = scratch.table(links.of(named), "member")
    least = scratch.table(member.groupBy("comp").agg(F.min("min_doc").alias("component_id")), "least")
    by_digest = scratch.table(member.join(least, "comp").select("digest", "component_id"), "by-digest")
    out = read.select("doc_id", "n", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
