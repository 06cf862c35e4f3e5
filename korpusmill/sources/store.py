"""A versioned Parquet table: a version is written, compared with what it was made from, and only then becomes the current one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionError(RuntimeError):
    """A new version that doesn't hold what it should."""


def differences(old: DataFrame, new: DataFrame, key: str, text: str) -> dict[str, int]:
    """Rows of both tables, and the (key, text) pairs that one holds more often than the other; a null text equals an empty one."""
    pair = lambda df, side: df.select(F.col(key).alias("k"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("t"), F.lit(side).alias("side"))
    counted = pair(old, 1).unionByName(pair(new, -1)).groupBy("k", "t").agg(F.sum("side").alias("balance"), F.count_if(F.col("side") == 1).alias("o"), F.count_if(F.col("side") == -1).alias("n"))
    return counted.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("old"), F.coalesce(F.sum("n"), F.lit(0)).alias("new"), F.count_if(F.col("balance") != 0).alias("different")).first().asDict()


def publish(table: DataFrame, root: str, key: str, text: str, change: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None) -> str:
    """Write change(table), or the table itself, as a new version under root, in so many files; returns the version's path.

    Older versions stay, so they are the backup. A version that lacks rows or has other texts is never made current.
    """
    spark, path = table.sparkSession, f"{root}/versions/{uuid.uuid4().hex}"
    new = change(table) if change else table
    (new.repartition(files) if files else new).write.parquet(path)
    found = differences(table, spark.read.parquet(path), key, text)
    if found["old"] != found["new"] or found["different"]:
        raise VersionError(f"not made current: {found}")
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(path).alias("path")).coalesce(1).write.mode("append").parquet(f"{root}/current")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was made current last."""
    return spark.read.parquet(spark.read.parquet(f"{root}/current").orderBy(F.desc("at")).first()["path"])


def by_id(table: DataFrame, key: str, value: object) -> DataFrame:
    """A point lookup; the filter reaches the Parquet scan."""
    return table.where(F.col(key) == F.lit(value))


def index_feed(table: DataFrame) -> DataFrame:
    """id and text to be indexed: the text, then the abstract on a line of its own where there is one."""
    return table.select("id", F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("\n"), "abstract"), F.lit(""))).alias("text"))
