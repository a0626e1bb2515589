"""Streaming forms: first-seen rows with a watermark, and keyed upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.dedupe import dedupe, key_columns


def first_seen(stream: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Rows whose normalised DOI was not seen within the watermark; blank DOIs pass once per title."""
    key = F.when(T.doi("doi") != "", T.doi("doi")).otherwise(F.concat(F.lit("title:"), T.title("title")))
    return stream.withColumn("_key", key).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


BUCKETS = 64


def upsert_batches(stream: DataFrame, folder: str, checkpoint: str):
    """foreachBatch sink: rows are appended by bucket of their key, so a batch writes no more than it brings.

    A batch that runs again replaces its own files only. ``current`` merges what the folder holds."""

    def write(batch: DataFrame, epoch: int) -> None:
        keyed = key_columns(batch)
        bucket = F.pmod(F.xxhash64("key_kind", "key_value"), F.lit(BUCKETS)).cast("int")
        rows = keyed.select(*batch.columns, bucket.alias("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/epoch={epoch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """One row per key over all batches so far, with counts and lists of all its rows."""
    return dedupe(spark.read.option("basePath", folder).parquet(f"{folder}/epoch=*").drop("epoch", "bucket"))
