"""Findings as they arrive: new scan files run through the batch operators.

An extension: each micro-batch is fingerprinted and only fingerprints not seen
before are appended.  Batches are written under their number, so that a batch
that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.suppress import fingerprinted
from ..schema import FINDING


def arriving(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FINDING).json(path)


def append_new(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write each batch's unseen findings to ``out``/batch=<n>."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = fingerprinted(transform(batch)).dropDuplicates(["fp"])
        try:
            known = spark.read.option("basePath", out).parquet(f"{out}/batch=*").where(f"batch <> {number}").select("fp")
            rows = rows.join(known, "fp", "left_anti")
        except Exception as e:  # the first batch has nothing before it
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
