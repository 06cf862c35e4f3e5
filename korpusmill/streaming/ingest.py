"""Incremental ingest with Structured Streaming: file batches, upserted once each, known ids skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str) -> None:
    """Append to the Parquet table target the rows of new files under source whose key it doesn't have; ends when all are read.

    Each micro-batch writes a folder named after its number, so a batch that is run again replaces its own rows.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            known = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target).where(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
            rows = rows.join(known.select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.select(*schema.names).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and window of event time, for a streaming or a static table."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def watermark(harvest: DataFrame, key: str, stamp: str) -> DataFrame:
    """The latest stamp and the number of records of each harvested set; to be stored only after a complete scan."""
    return harvest.groupBy(key).agg(F.max(stamp).alias("latest"), F.count("*").alias("records"))


def remembered(old: DataFrame, new: DataFrame, key: str, complete: bool) -> DataFrame:
    """The next version of the stored marks (key, latest, records): counts add up, and a stamp moves on, never back, only after a complete scan.

    A scan that was cut off by a limit has seen late stamps while older records are still unread; moving on would skip them for good.
    """
    met = old.withColumnsRenamed({"latest": "was", "records": "had"}).join(new, key, "full_outer")
    moved = F.greatest("was", "latest") if complete else F.col("was")
    return met.select(key, moved.alias("latest"), (F.coalesce("had", F.lit(0)) + F.coalesce("records", F.lit(0))).alias("records"))
