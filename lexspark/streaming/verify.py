"""Verification of a stream of documents: one row is one document, so detection and arbitration carry no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.operators.index import Index
from lexspark.plans.verify import verify
from lexspark.shared import scope


def verify_stream(spark: SparkSession, folder: str, index: Index, out: str, checkpoint: str, schema: str = "document_id string, raw string", **modes):
    """Verify parquet files of documents as they arrive; each micro-batch appends its citations to ``out``.

    The batch's number is part of the path, so a batch that runs again replaces its own rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        with scope(spark):
            verify(batch, index, **modes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
