"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of the six ASCII white-space bytes; words are what stands between such runs.
WHITE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that no other script changes."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and outlives lost executors. It goes when the driver ends, or by drop()."""
    path = f"{shared_folder(df.sparkSession)}/korpusmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _files(df.sparkSession, path)
    files.deleteOnExit(place)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that everything later was already written from; a later read of them fails."""
    for t in tables:
        files, place = _files(t.sparkSession, t._stored_at)
        files.delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffled data of tables that are written and no longer referred to; else it stays until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """docs and a key of each row, (file, at): the file it stands in and its place there. Unlike a number given while reading, it's the same however
    the files are split among tasks, so jobs that read docs again can be joined by it. What isn't plainly read from files is stored first."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation"):
        docs = stored(docs)
    at = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at")))


#: Row keys of 16 bytes up to which a list of rows is broadcast (16 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def listed(rows: DataFrame) -> DataFrame:
    """A stored list of row keys, marked for a broadcast if it is short enough: the other side, texts most often, then stays where it is."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def quoted(columns: list[str]) -> list[str]:
    """Names as select() takes them, whatever dots or spaces they have."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shift_left(x: Column, n: Column) -> Column:
    """x << n for a column n."""
    return F.call_function("shiftleft", x, n)


def shift_right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def values(spark: SparkSession, name: str, items: list[str]) -> DataFrame:
    """A table of one string column from a short list, without Python on the executors."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in items]) if items else F.lit([]).cast("array<string>")).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of about this size at most for the jobs that run inside; wide rows then fit a Python worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)
