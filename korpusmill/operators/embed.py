"""Embeddings of passages by any encoder, an incremental passage index, and the hybrid search over it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.text import tokens
from korpusmill.operators import retrieval, search
from korpusmill.operators.chunking import chunk

Encoder = Callable[[list[str]], np.ndarray]
DIMS = 384
PREFIXES = ("query", "passage")
#: Texts that an encoder gets at once.
GROUP = 128


def hashed_words(texts: list[str]) -> np.ndarray:
    """A bag of words, each counted at the crc32 of its first four letters: deterministic, and no model is needed."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        for w in t.split():
            out[i, zlib.crc32(w[:4].encode()) % DIMS] += 1
    return out


def encoded(df: DataFrame, text: str, prefix: str, encoder: Encoder = hashed_words) -> DataFrame:
    """df with embedding: the encoder's vector of ``prefix: text`` in length 1 (zeros stay zeros); null for a null text."""
    if prefix not in PREFIXES:
        raise ValueError(f"prefix {prefix!r}; it must be one of {', '.join(PREFIXES)}")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP):
                b = whole.slice(at, GROUP)
                texts = b.column(names.index(text)).to_pylist()
                v = np.asarray(encoder([f"{prefix}: {t or ''}" for t in texts]), np.float32)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else x.tolist() for t, x in zip(texts, v)], pa.list_(pa.float32()))], names=[*names, "embedding"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "embedding array<float>"]))


def index_passages(docs: DataFrame, old: DataFrame | None = None, ids: DataFrame | None = None, most: int | None = None, again: bool = False, encoder: Encoder = hashed_words) -> DataFrame:
    """doc_id, ord, chunk, embedding: the old index and the passages of documents that it doesn't have yet; again indexes chosen documents anew and leaves none of
    their old passages. Only the ids (doc_id) are chosen if given, and at most so many, in order of doc_id. A blank text has no passage."""
    chosen = docs.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    if ids is not None:
        chosen = chosen.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if old is not None and not again:
        chosen = chosen.join(old.select("doc_id").distinct(), "doc_id", "left_anti")
    if most is not None:
        chosen = chosen.orderBy("doc_id").limit(most)
    new = encoded(chunk(chosen), "chunk", "passage", encoder)
    if old is None:
        return new
    return (old.join(chosen.select("doc_id"), "doc_id", "left_anti") if again else old).unionByName(new)


def index_figures(docs: DataFrame, passages: DataFrame, dims: int = DIMS) -> DataFrame:
    """documents, indexed, passages, mean (passages of an indexed document), mb (of vectors), coverage (per cent)."""
    of = passages.agg(F.count_distinct("doc_id").alias("indexed"), F.count("*").alias("passages"))
    each = docs.agg(F.count("*").alias("documents")).crossJoin(of)  # one row each
    return each.select("documents", "indexed", "passages", F.round(F.try_divide("passages", "indexed"), 6).alias("mean"), F.round(F.col("passages") * (4.0 * dims) / (1 << 20), 6).alias("mb"), F.round(F.try_divide(100 * F.col("indexed"), "documents"), 6).alias("coverage"))


def hybrid(passages: DataFrame, questions: list[dict], k: int = 20, depth: int = 60, encoder: Encoder = hashed_words) -> DataFrame:
    """doc_id (of the passage: ``document/ord``), score and provenance of the k best passages of a bundle of questions (text, and optionally label, weight, branch:
    hibrid, vektor or bm25, prefix). All questions of one prefix are encoded in one pass."""
    spark = passages.sparkSession
    named = passages.withColumn("vec_id", F.concat_ws("/", "doc_id", "ord"))
    hits = []
    for prefix in PREFIXES:
        own = [(i, q["text"]) for i, q in enumerate(questions) if q.get("prefix", "query") == prefix and q.get("branch", "hibrid") != "bm25"]
        if own:
            asked = encoded(spark.createDataFrame(own, "qid int, text string"), "text", prefix, encoder).selectExpr("qid", "embedding as query")
            top = retrieval.vector_topk(named.select("vec_id", "embedding"), asked, depth)
            facts = spark.createDataFrame([(i, q.get("label", q["text"]), float(q.get("weight", 1.0))) for i, q in enumerate(questions)], "qid int, label string, weight double")
            hits.append(top.join(F.broadcast(facts), "qid").select(F.col("vec_id").alias("doc_id"), "rank", "label", F.lit("vektor").alias("branch"), "weight"))
    texts = named.select(F.col("vec_id").alias("doc_id"), F.col("chunk").alias("text"))
    for q in questions:
        if q.get("branch", "hibrid") != "vektor":
            words = spark.range(1).select(tokens(F.lit(q["text"])).alias("t")).first()["t"]
            if words:
                scored = search.ranked(texts, [[w] for w in dict.fromkeys(words)], every=False)
                hits.append(retrieval.ranks(scored, q.get("label", q["text"]), "bm25", float(q.get("weight", 1.0)), depth))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    return retrieval.fuse(every).orderBy(F.desc("score"), "doc_id").limit(k)


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their documents' columns. The join is after the cut, so a passage whose document is gone makes the result shorter."""
    split = hits.withColumn("ord", F.element_at(F.split("doc_id", "/"), -1).cast("int")).withColumn("passage", F.col("doc_id")).drop("doc_id")
    key = F.expr("substring(passage, 1, length(passage) - length(cast(ord as string)) - 1)")
    return split.withColumn("doc_id", key.cast(docs.schema["doc_id"].dataType)).join(docs, "doc_id")


def as_json(hits: DataFrame) -> DataFrame:
    """rank (1 ..) and json: each hit with its score to six places."""
    listed = hits.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "doc_id", "provenance", "score"))).alias("all"))  # k rows at most
    each = listed.select(F.posexplode("all").alias("at", "h"))
    return each.select((F.col("at") + 1).alias("rank"), F.to_json(F.struct((F.col("at") + 1).alias("rank"), F.col("h.doc_id").alias("doc_id"), F.round("h.score", 6).alias("score"), F.col("h.provenance").alias("provenance"))).alias("json"))
