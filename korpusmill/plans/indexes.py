"""The application's stored indexes: one for each table folder, built when first asked for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korpusmill.operators import index, search


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def stored_index(spark: SparkSession, sf: str, name: str = "documents", change: Callable[[str], None] | None = None) -> str:
    """The folder of the application's index of the documents' texts, built when first asked for, again when the table has changed, and deleted with the driver."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    source = hadoop.Path(f"{sf}/documents.parquet")
    status = source.getFileSystem(conf).getFileStatus(source)
    version = f"{sf}/{name}/{status.getModificationTime()}/{status.getLen()}"
    folder = f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}-{hashlib.md5(version.encode()).hexdigest()}"
    place = hadoop.Path(f"{folder}/figures/_SUCCESS")
    files = place.getFileSystem(conf)
    if not files.exists(place):
        files.delete(place.getParent().getParent(), True)
        files.deleteOnExit(place.getParent().getParent())
        (change or (lambda to: index.build(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), to)))(folder)
    return folder


def asked(spark: SparkSession, sf: str, phrases: list[list[str]], **how) -> DataFrame:
    """The best documents by the stored index."""
    return search.best(found(spark, sf, phrases, **how))


def found(spark: SparkSession, sf: str, phrases: list[list[str]], **how) -> DataFrame:
    return index.search(spark, stored_index(spark, sf), phrases, **how)
