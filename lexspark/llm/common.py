"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.shared import new_folder

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a Python worker is given at once, and that are read from a file at once.
TEXTS, READ = 1000, 256
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(c, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Give Python workers TEXTS rows at once in this session and read READ of a file at once, unless it says how many.

    Rows hold whole texts here; Spark's 10,000 of them fill buffers on both sides that
    an executor keeps for its life, and its 4,096 a file fill arrays that double as they
    grow, each too large for a region of the heap.
    """
    own = spark.sparkContext.getConf()
    for name, rows, usual in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS, 10000), ("spark.sql.parquet.columnarReaderBatchSize", READ, 4096)):
        if not own.contains(name) and int(spark.conf.get(name)) == usual:
            spark.conf.set(name, rows)


class Scratch:
    """Intermediate tables under the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, new_folder(spark)

    def _path(self, path: str, f):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return f(p.getFileSystem(sc._jsc.hadoopConfiguration()), p)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            self._path(f"{self.root}/{name}", lambda fs, p: fs.delete(p, True))
