"""Token counts as delta-maintained rollups.

Inserts, deletes and revisions of documents become signed counts, summed by source,
language and tokenizer version, and committed as batches.  A batch's sums are written
to a folder of their own; one marker file, made only if it isn't there yet, makes
them count.  So of several writers of a batch one wins, a batch that is sent again
changes nothing, and a batch that fails half-way leaves nothing that counts.  Totals
are the sums of all batches; no document is counted twice to keep them.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

KEYS = ["source", "lang", "tokenizer_version"]
_encodings: dict = {}


def _encoding(version: str, path: str | None = None):
    """Byte-level BPE of a .tiktoken file; without a path the packaged public one of that name. Loaded once a worker."""
    if (version, path) not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(f"{version}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[version, path] = tiktoken.Encoding("rollup", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[version, path]


def signed_counts(changes: DataFrame, tokenizer_version: str = "byte_bpe_50k", tokenizer_path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """changes: (sign, source, lang, text) -> KEYS, documents, tokens, a row for each change, and the columns named in ``keep``.

    sign is 1 for an insert and -1 for a delete; a revision is a delete of the old
    row and an insert of the new one.  Null and empty texts have no tokens but count
    as documents; null sources and languages are keys of their own; changes without a
    sign don't count.  Repeated rows each count.  A very long text is one text to the
    tokenizer; an empty table gives no rows; other columns are ignored.  Written with
    an id, the counts let later deletes be signed without their texts.
    """

    def run(batches):
        enc = _encoding(tokenizer_version, tokenizer_path)
        for b in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in b.column(3))]
            signs = b.column(0).to_pylist()
            tokens = pa.array([s * c for s, c in zip(signs, counts, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), tokens, *b.columns[4:]], ["source", "lang", "documents", "tokens", *keep])

    small_batches(changes.sparkSession)
    rows = changes.select(F.col("sign").cast("long").alias("sign"), "source", "lang", "text", *keep).where("sign is not null")
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    counted = rows.mapInArrow(run, f"source string, lang string, documents long, tokens long{kept}")
    return counted.select("source", "lang", F.lit(tokenizer_version).alias("tokenizer_version"), "documents", "tokens", *keep)


_SUMS = "source string, lang string, tokenizer_version string, documents long, tokens long"


class TokenRollup:
    """A store of batches under ``root``, a folder that driver and executors share and whose file system makes a new file in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _publish(self, content: dict, *parts: str) -> bool:
        """Make a marker, whole from the start; False if it was there already.

        It is written aside and then takes its name in one step. A local file takes it as a link,
        since Hadoop's local file system looks first and writes then, and would let two writers in.
        """
        fs, p = self._path(*parts)
        _, aside = self._path("staged", uuid.uuid4().hex)
        for folder in (p.getParent(), aside.getParent()):
            fs.mkdirs(folder)
        out = fs.create(aside, False)
        out.write(json.dumps(content).encode())
        out.close()
        try:
            written = fs.resolvePath(aside).toUri()
            if written.getScheme() != "file":
                return not fs.exists(p) and fs.rename(aside, p)
            os.link(written.getPath(), os.path.join(fs.resolvePath(p.getParent()).toUri().getPath(), p.getName()))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(aside, False)

    def _markers(self, kind: str) -> dict[str, dict]:
        fs, top = self._path(kind)
        if not fs.exists(top):
            return {}
        paths = [s.getPath() for s in fs.listStatus(top)]
        read = self.spark.read.text([p.toString() for p in paths], wholetext=True).selectExpr("element_at(split(input_file_name(), '/'), -1) AS name", "value") if paths else None
        return {r.name: json.loads(r.value) for r in read.collect()} if read else {}

    def _staged(self, counts: DataFrame) -> tuple[str, DataFrame]:
        name = uuid.uuid4().hex
        sums = counts.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")
        folder = self._path("sums", name)[1].toString()
        sums.write.parquet(folder)
        return name, self.spark.read.schema(_SUMS).parquet(folder)

    def commit(self, batch_id: str, counts: DataFrame) -> bool:
        """Add signed counts as one batch; False, and no change, if that batch is there already.

        A batch that is sent again must hold the same sums, or it is an error.  An empty
        batch counts as sent.
        """
        name, sums = self._staged(counts)
        print_ = sums.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*KEYS, "documents", "tokens")).alias("x")).first()
        content = {"sums": name, "rows": print_["n"], "hash": print_["x"]}
        if self._publish(content, "batches", batch_id):
            return True
        known = self._markers("batches")[batch_id]
        fs, folder = self._path("sums", name)
        fs.delete(folder, True)
        if (known["rows"], known["hash"]) != (content["rows"], content["hash"]):
            raise ValueError(f"batch {batch_id} is there with other sums")
        return False

    def _live(self) -> tuple[list[str], dict[str, dict], int]:
        """Folders whose sums make the totals, the batches, and the number of the last base."""
        batches, bases = self._markers("batches"), self._markers("bases")
        last = max(map(int, bases), default=0)
        base = bases.get(str(last), {"sums": None, "batches": []})
        return [x for x in (base["sums"],) if x] + [b["sums"] for i, b in batches.items() if i not in set(base["batches"])], batches, last

    def compact(self) -> None:
        """Sum all batches so far into one base; batches that are sent again are still known."""
        folders, batches, last = self._live()
        if len(folders) > 1:
            name, _ = self._staged(self._sums(folders))
            self._publish({"sums": name, "batches": sorted(batches)}, "bases", str(last + 1))

    def _sums(self, folders: list[str]) -> DataFrame:
        paths = [self._path("sums", f)[1].toString() for f in folders]
        return self.spark.read.schema(_SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], _SUMS)

    def totals(self) -> DataFrame:
        """KEYS, documents, tokens over all batches; keys whose counts are all back to zero are left out."""
        rows = self._sums(self._live()[0])
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after four batches over all documents.

    All are loaded; those labelled toxic are deleted; those labelled as of low quality
    are revised, their white space collapsed, in a batch that is sent twice; what is
    there then is counted with a second tokenizer.  Every text, and every collapsed one
    that differs, is counted once a tokenizer; labels meet the written counts, so no text
    is shuffled.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.lit(1).alias("sign"))
    collapsed = F.regexp_replace("text", r"\s+", " ")
    docs = docs.withColumn("changes", F.coalesce(F.col("text").rlike(r"\s\s|[\t\n\x0B\f\r]"), F.lit(False)))  # that is, collapsed differs
    marks = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"), F.max(F.col("quality") == 0).alias("low"))
    scratch = Scratch(spark)

    def counts(version: str) -> tuple[DataFrame, DataFrame]:
        """Counts of the texts, and of the collapsed ones that differ, with their labels."""
        marked = lambda df, name: scratch.table(df, f"{name}-{version}").join(marks, "doc_id", "left").fillna(False, ["toxic", "low"])
        return marked(signed_counts(docs, version, keep=("doc_id", "changes")), "old"), marked(signed_counts(docs.where("changes").withColumn("text", collapsed), version, keep=("doc_id",)), "new")

    (old, new), (old_second, new_second) = counts("byte_bpe_50k"), counts("byte_bpe_multi_50k")
    negative = lambda df: df.select(*KEYS, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))
    sums = [*KEYS, "documents", "tokens"]
    store = TokenRollup(spark, f"{scratch.root}/rollup")
    store.commit("load", old.select(sums))
    store.commit("toxic", negative(old.where("toxic")))
    for _ in range(2):
        store.commit("revise", negative(old.where("low and not toxic and changes")).unionByName(new.where("low and not toxic").select(sums)))
    left = old_second.where("not toxic and not (low and changes)").select(sums).unionByName(new_second.where("low and not toxic").select(sums))
    store.commit("second-tokenizer", left)
    return store.totals()
