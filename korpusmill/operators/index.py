"""A stored inverted index: postings by bucket of a token's first letters, lengths by document, and one row of figures.

A question reads the buckets of its own terms (folders that are pruned by name, row groups that are pruned by token), never the texts. A phrase is found inside one column.
Scores are those of search.ranked() over the same columns. An update takes the postings of the changed documents out, old tokens included, and puts theirs in.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.functions.text import tokens
from korpusmill.operators.search import B, K1, LEAST_IDF, matches

BUCKETS, LETTERS = 64, 2


def bucket(start: Column) -> Column:
    return F.pmod(F.xxhash64(start), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, column, token, pos, bucket: a row for each token, as it stands; a question gathers those of its terms."""
    each = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), tokens(F.col(c)).alias("t")) for c in columns])).alias("x"))
    spots = each.select("doc_id", "x.column", F.posexplode("x.t").alias("pos", "token"))
    return spots.withColumn("bucket", bucket(F.substring("token", 1, LETTERS)))


def write(posted: DataFrame, ids: DataFrame, folder: str) -> None:
    """ids: doc_id of all documents, those without a token too."""
    spark = ids.sparkSession
    # rebalanced, so that a bucket of frequent tokens is split over several files and small ones share a task
    posted.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{folder}/postings")
    size = spark.read.parquet(f"{folder}/postings").groupBy("doc_id").agg(F.count("*").alias("length"))
    ids.join(size, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).alias("length")).write.parquet(f"{folder}/lengths")
    spark.read.parquet(f"{folder}/lengths").agg(F.count("*").alias("n"), F.avg("length").alias("avg")).write.parquet(f"{folder}/figures")


def build(docs: DataFrame, folder: str, columns: tuple[str, ...] = ("text",)) -> None:
    """Index the columns of docs (doc_id unique) in a new folder."""
    write(postings(docs, list(columns)), docs.select("doc_id"), folder)


def update(docs: DataFrame, old: str, folder: str, columns: tuple[str, ...] = ("text",)) -> None:
    """The index in old with docs in place of what it had of their ids, in a new folder."""
    spark, ids = docs.sparkSession, docs.select("doc_id")
    kept = lambda name: spark.read.parquet(f"{old}/{name}").join(ids, "doc_id", "left_anti")
    write(kept("postings").unionByName(postings(docs, list(columns))), kept("lengths").select("doc_id").unionByName(ids), folder)


def search(spark: SparkSession, folder: str, phrases: list[list[str]], every: bool = True, scope: str | None = None) -> DataFrame:
    """doc_id and score (lower is better) of the documents with all phrases, or with any. A phrase's last token may be a prefix (``abc*``)."""
    terms = list(dict.fromkeys(t for p in phrases for t in p))
    stems = {t: t.rstrip("*")[:LETTERS] for t in terms}
    posted = spark.read.parquet(f"{folder}/postings")
    if all(len(s) == LETTERS or not t.endswith("*") for t, s in stems.items()):  # a shorter prefix is in every bucket
        wanted = spark.range(1).select(*[bucket(F.lit(s)).alias(f"b{i}") for i, s in enumerate(stems.values())]).first()
        posted = posted.where(F.col("bucket").isin(sorted(set(wanted))))
    posted = posted.where(reduce(lambda a, b: a | b, [matches(F.col("token"), t) for t in terms]))
    if scope:
        posted = posted.where(F.col("column") == scope)
    places = lambda t, k: F.collect_set(F.when(matches(F.col("token"), t), F.col("pos") - k))
    starts = [F.size(reduce(F.array_intersect, [places(t, k) for k, t in enumerate(p)])).alias(f"tf{i}") for i, p in enumerate(phrases)]
    found = posted.groupBy("doc_id", "column").agg(*starts).groupBy("doc_id").agg(*[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(phrases))])
    tf = [F.col(f"tf{i}") for i in range(len(phrases))]
    figures = spark.read.parquet(f"{folder}/figures").first()
    df = found.agg(*[F.count_if(t > 0).alias(f"df{i}") for i, t in enumerate(tf)]).first()
    sized = found.join(spark.read.parquet(f"{folder}/lengths"), "doc_id")
    score = F.lit(0.0)
    for i, t in enumerate(tf):
        idf = max(math.log((figures["n"] - df[i] + 0.5) / (df[i] + 0.5)), LEAST_IDF) if figures["n"] else 0.0
        score = score - F.lit(idf) * (t * (K1 + 1)) / (t + K1 * (1 - B + B * F.col("length") / F.lit(figures["avg"] or 1.0)))
    hits = [t > 0 for t in tf]
    return sized.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hits)).select("doc_id", F.round(score, 6).alias("score"))
