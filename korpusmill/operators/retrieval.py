"""Exact vector top-k, reciprocal rank fusion with provenance, and retrieval measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
#: Vectors or queries that meet at once.
BLOCK = 1024


def blocks(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row for about BLOCK rows each: their keys and values as a list of structs (key, value)."""
    n = max(1, -(-rows.count() // BLOCK))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))).alias(name)).select(name)


def matrix(block: pa.StructScalar) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys in ascending order, their vectors as rows filled up with 0, and the vectors' sizes, -1 for a null."""
    keys, lists = block.values.field("key"), block.values.field("value")
    order = pc.sort_indices(keys, null_placement="at_start")
    keys, lists = keys.take(order), lists.take(order)
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    out = np.zeros((len(keys), max(int(size.max()), 1)))
    out[np.arange(out.shape[1]) < size[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    return keys, out, size


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, vec_id, sim, rank: the k most similar vectors (vec_id, embedding) of each query (qid, query), of which there may be many.

    Blocks of vectors meet blocks of queries, and each meeting keeps the k best of a query; these are ranked in the end.
    The similarity is null, which ranks last, if a vector is null, has a null or NaN in it or differs in size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, q in zip(b.column("v"), b.column("q")):
                (ids, x, n), (qids, y, m) = matrix(v), matrix(q)
                wide = min(x.shape[1], y.shape[1])
                sim = y[:, :wide] @ x[:, :wide].T
                sim = np.copysign(np.floor(np.abs(sim) * 1e5 + 0.5), sim) / 1e5
                sim[(m[:, None] != n) | (m[:, None] < 0)] = np.nan
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(sim, best, 1).ravel()
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.repeat(np.arange(len(qids)), best.shape[1]))), ids.take(pa.array(best.ravel())), pa.array(top, mask=np.isnan(top))], names=["qid", "vec_id", "sim"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    met = blocks(vectors, "vec_id", "embedding", "v").crossJoin(blocks(queries, "qid", "query", "q"))
    scored = met.mapInArrow(run, f"qid {kind(queries, 'qid')}, vec_id {kind(vectors, 'vec_id')}, sim double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id"))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def fuse(hits: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """doc_id, score, provenance of ranked hits (label, branch, weight, doc_id, rank): the sum of weight / (k + rank)."""
    part = F.col("weight") / (rrf_k + F.col("rank"))
    trace = F.struct((-F.round(part, 9)).alias("order"), "label", "branch", "rank")
    out = hits.groupBy("doc_id").agg(F.sum(part).alias("score"), F.sort_array(F.collect_list(trace)).alias("t"))
    named = F.array_join(F.transform("t", lambda x: F.concat_ws("/", x["label"], x["branch"], x["rank"].cast("string"))), " ")
    return out.select("doc_id", F.round("score", 9).alias("score"), named.alias("provenance"))


def ablations(hits: DataFrame, gold: DataFrame, branches: list[str], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """without (empty: every branch takes part), found: gold documents (doc_id) among the first k of the hits fused without one branch at a time.

    Ties go to the smaller doc_id; a run that has no hits left has no row.
    """
    runs = F.explode(F.array(*[F.lit(b) for b in ["", *branches]])).alias("without")
    kept = hits.select("*", runs).where(~F.col("branch").eqNullSafe(F.col("without")))
    scored = kept.groupBy("without", "doc_id").agg(F.round(F.sum(F.col("weight") / (rrf_k + F.col("rank"))), 9).alias("score"))
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("without").orderBy(F.desc("score"), "doc_id"))).where(F.col("place") <= k)
    met = top.join(gold.select("doc_id", F.lit(True).alias("good")).distinct(), "doc_id", "left")
    return met.groupBy("without").agg(F.count("good").alias("found"))


def united(hits: DataFrame) -> DataFrame:
    """doc_id, groups, best: every document that any group (label, doc_id, rank) found, the groups' names in order and the best rank."""
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("groups"), F.min("rank").alias("best"))


def ranks(scored: DataFrame, label: str, branch: str, weight: float = 1.0, depth: int = 40) -> DataFrame:
    """Ranked hits of one query in one branch, from (doc_id, score), least score first."""
    top = scored.orderBy("score", "doc_id").limit(depth)
    rank = F.row_number().over(Window.orderBy("score", "doc_id")).cast("bigint")
    return top.select("doc_id", rank.alias("rank"), F.lit(label).alias("label"), F.lit(branch).alias("branch"), F.lit(weight).alias("weight"))


def recall_at(gold: DataFrame, ranked_hits: DataFrame, ks: list[int]) -> DataFrame:
    """k, found, total for a gold set (doc_id) and ranked hits (doc_id, rank)."""
    met = gold.join(ranked_hits, "doc_id", "left")
    one = met.agg(F.count("*").alias("total"), *[F.count_if(F.col("rank") <= k).alias(f"at{k}") for k in ks])
    return one.select("total", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"at{k}").alias("found")) for k in ks])).alias("x")).select("x.k", "x.found", "total")


def expected_recall(gold: DataFrame, scored: DataFrame, ks: list[int]) -> DataFrame:
    """k and the expected number of gold documents in the first k when ties are broken at random."""
    blocks = scored.join(gold.withColumn("g", F.lit(1)), "doc_id", "left").groupBy("score").agg(F.count("*").alias("n"), F.sum(F.coalesce("g", F.lit(0))).alias("g"))
    blocks = blocks.withColumn("before", F.sum("n").over(Window.orderBy("score")) - F.col("n"))
    share = lambda k: F.round(F.sum(F.col("g") * F.least(F.greatest(F.lit(k) - F.col("before"), F.lit(0)), F.col("n")) / F.col("n")), 6)
    one = blocks.agg(*[share(k).alias(f"at{k}") for k in ks])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"at{k}").alias("expected")) for k in ks])).alias("x")).select("x.k", "x.expected")


def f1_report(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """average (micro, macro), precision, recall, f1 of label sets given as rows (doc_id, label); 0 where nothing divides."""
    joined = predicted.withColumn("p", F.lit(1)).join(truth.withColumn("t", F.lit(1)), ["doc_id", "label"], "full_outer")
    p, t = F.coalesce("p", F.lit(0)), F.coalesce("t", F.lit(0))
    by = joined.groupBy("label").agg(F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    rates = lambda tp, fp, fn: [safe(tp, tp + fp), safe(tp, tp + fn), safe(2 * tp, 2 * tp + fp + fn)]
    names = ["precision", "recall", "f1"]
    micro = by.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("micro").alias("average"), *[F.round(r, 6).alias(n) for n, r in zip(names, rates(F.col("tp"), F.col("fp"), F.col("fn")))])
    macro = by.select(*[r.alias(n) for n, r in zip(names, rates(F.col("tp"), F.col("fp"), F.col("fn")))]).agg(*[F.round(F.avg(n), 6).alias(n) for n in names]).select(F.lit("macro").alias("average"), *names)
    return micro.unionByName(macro)


def by_document(hits: DataFrame, least: float, weight: float = 0.3) -> DataFrame:
    """doc_id, score, passages: the best passage's score plus a bonus for the number of passages (doc_id, score) above least."""
    many = F.count_if(F.col("score") > least)
    return hits.groupBy("doc_id").agg(F.round(F.max("score") + weight * F.log1p(many), 6).alias("score"), many.alias("passages"))


def label_report(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of (doc_id, label, truth, predicted), and rows (micro), (macro), (weighted) and (samples). What would be divided by 0 is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = [F.count_if(F.col("truth") & F.col("predicted")).alias("tp"), F.count_if("predicted").alias("said"), F.count_if("truth").alias("support")]
    scores = [ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1")]
    names = ["precision", "recall", "f1"]
    by = pairs.groupBy("label").agg(*sums).select("label", *scores, "support")
    micro = pairs.agg(*sums).select(F.lit("(micro)").alias("label"), *scores, "support")
    macro = by.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("(macro)").alias("label"), *names, "support")
    weighted = by.agg(*[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("(weighted)").alias("label"), *names, "support")
    samples = pairs.groupBy("doc_id").agg(*sums).select(*scores, "support").agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("(samples)").alias("label"), *names, "support")
    every = by.unionByName(micro).unionByName(macro).unionByName(weighted).unionByName(samples)
    return every.select("label", *[F.round(n, 6).alias(n) for n in names], F.col("support").cast("bigint").alias("support"))


def gold_report(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (10, 20, 50, 100, 200)) -> DataFrame:
    """class, size, first (the best rank of one of the class; null if none is ranked) and found_<k> for each cut, of ranked (doc_id, rank) and gold (doc_id, class)."""
    best = ranked.groupBy("doc_id").agg(F.min("rank").alias("rank"))
    met = gold.join(best, "doc_id", "left")
    return met.groupBy("class").agg(F.count("*").alias("size"), F.min("rank").cast("bigint").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in cuts])


def precision_at(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """distinct documents among the first k, those of the gold set, and precision."""
    top = ranked.where(F.col("rank") <= k).select("doc_id").distinct().join(gold.select("doc_id", F.lit(True).alias("good")).distinct(), "doc_id", "left")
    return top.agg(F.count("*").alias("documents"), F.count_if(F.coalesce("good", F.lit(False))).alias("good")).withColumn("precision", F.round(F.try_divide("good", F.lit(k)), 6))


def reranked(hits: DataFrame, features: dict[str, float]) -> DataFrame:
    """Hits in the order of score plus the weighted sum of their feature columns (null counts 0); ties by doc_id."""
    total = F.col("score")
    for name, weight in features.items():
        total = total + weight * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return hits.withColumn("total", F.round(total, 9)).orderBy(F.desc("total"), "doc_id")
