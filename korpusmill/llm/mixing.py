"""Mixing sources to target weights by systematic sampling (native: DataFrame functions only).

Targets: the sources in code-point order (null last) weigh ``weights`` in turn and share ``growth`` times all words; a target
stops at ``cap`` times its source's size and the excess is shared among the others by weight (water filling over one row per source).

Copies: every document of a source expects ``target / size of the source`` copies. The documents stand in a fixed order, near
to that of their sizes; the prefix sum of expected copies plus the source's one random offset (from ``seed``) crosses an integer
boundary once per emitted copy. Walking by size keeps the words taken near the target, within about one large document. The prefix sum runs
in two levels, counts per (source, size class, hash bucket) and ranks inside a bucket, so that no source lands in one task.

Defined results: a null or empty text has size 0 and takes 0 words; a source without words has target 0; null source is a source of
its own; repeated rows are documents each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.llm.common import free_name, quoted, shift_right, stored, with_row, words

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
GROWTH, CAP = 1.5, 2
BUCKETS = 256
CLASS_BITS = 5  # leading bits of a size that tell size classes apart


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, growth: float = GROWTH, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """_source, source_size, target, expected (copies of each document) and offset per source."""
    sums = sized.groupBy("_source", "source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    t = sums.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    t = t.withColumn("total", growth * F.sum("source_size").over(everything))
    upto = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.withColumn("most_upto", F.sum("most").over(upto)).withColumn("weight_after", F.sum("weight").over(everything) - F.sum("weight").over(upto))
    full = F.col("most_upto") * F.col("weight") + F.col("most") * F.col("weight_after") <= F.col("total") * F.col("weight")
    t = t.withColumn("full", full)
    t = t.withColumn("left", F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything))
    t = t.withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * F.col("left") / F.col("open_weight")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "_source")), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)
    t = t.withColumn("target", target).withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    return t.select("_source", "source_size", "target", "expected", offset.alias("offset"))


def size_class(size: Column) -> Column:
    """Number of a class of sizes that share their leading bits; it grows with the size."""
    drop = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    return drop * (1 << CLASS_BITS) + shift_right(size, drop)


def copies(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (or the columns keep), size, source_size, target, copies of each document."""
    named = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "source"))
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    kept = keep or (id_col,)
    sized = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], "source", named.alias("_source"), F.size(words(F.col("text"))).cast("bigint").alias("size"), digest.alias("_digest"))
    sized = stored(sized.withColumn("_class", size_class(F.col("size"))).withColumn("_bucket", F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int")))
    cell = ["_source", "_class", "_bucket"]
    counts = sized.groupBy(*cell).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("_source").orderBy("_class", "_bucket")) - F.col("n")).drop("n")
    ranked = sized.join(before, cell).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(*cell).orderBy("size", "_digest")))
    ranked = ranked.join(source_targets(sized), "_source")
    crossed = lambda r: F.floor(F.col("expected") * r + F.col("offset"))
    n = F.least(crossed(F.col("rank")) - crossed(F.col("rank") - 1), F.lit(CAP)).cast("bigint")
    return ranked.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target", n.alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    c = copies(docs)
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the sample emits it."""
    row, times = free_name(docs, "row"), free_name(docs, "copies")
    keyed = with_row(docs, row)
    n = copies(keyed, keep=(row,)).where("copies > 0").select(row, F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias(times))
    return keyed.join(n, row).withColumn(times, F.explode(times)).select(*quoted(docs.columns))
