"""Features and baselines for multi-label text classification."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.functions.text import tokens


def tfidf(docs: DataFrame, least_df: int = 3) -> DataFrame:
    """doc_id, term, value of words and pairs of words, as ``weighed`` gives them."""
    t = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return weighed(docs, t.select("doc_id", F.explode(F.concat("t", pairs)).alias("term")), least_df)


def char_tfidf(docs: DataFrame, least_df: int = 3, most: int = 200_000, sizes: tuple[int, int] = (3, 5)) -> DataFrame:
    """doc_id, term, value of the strings of 3 to 5 characters inside each word between two spaces, weighed as by ``weighed``, of the ``most`` most frequent terms (ties by term); a word shorter than a size has none of it.

    The strings are many times the text, so they are never shuffled: texts are dealt by doc_id, and each document's strings are counted where it stands, once for the
    vocabulary (collected, ``most`` terms) and once for the values.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", tokens(F.col("text")).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, total = Grams(sizes), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def seen() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(grams.ids), pa.string()), pa.array(df[: len(grams.ids)]), pa.array(total[: len(grams.ids)])], names=["term", "df", "all"])

        for _, ids, tf, _ in counted(batches, grams):
            if len(df) < len(grams.ids):
                df, total = (np.concatenate([x, np.zeros(2 * len(grams.ids) - len(x), np.int64)]) for x in (df, total))
            df[ids] += 1
            total[ids] += tf
            if len(grams.ids) > TERMS:
                yield seen()
                grams.clear()
                df, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(grams.ids):
            df, total = (np.concatenate([x, np.zeros(max(0, len(grams.ids) - len(x)), np.int64)]) for x in (df, total))
            yield seen()

    every = dealt.mapInArrow(count, "term string, df bigint, all bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all")).where(F.col("df") >= least_df)
    n, rows = docs.count(), every.orderBy(F.desc("all"), "term").limit(most).collect()
    shared = spark.sparkContext.broadcast({r["term"]: 1 + math.log((1 + n) / (1 + r["df"])) for r in rows})

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(sizes, shared.value)
        terms, idf = pa.array(list(shared.value), pa.string()), np.array(list(shared.value.values()), np.float64)

        def part() -> pa.RecordBatch:
            ids, x = np.concatenate([i for _, i, _ in held]), np.concatenate([x for _, _, x in held])
            own = pa.array([d for d, _, _ in held], doc_type).take(pa.array(np.repeat(np.arange(len(held)), [len(i) for _, i, _ in held])))
            return pa.RecordBatch.from_arrays([own, terms.take(pa.array(ids)), pa.array(x)], names=["doc_id", "term", "value"])

        held, rows_held, doc_type = [], 0, None
        for doc, ids, tf, doc_type in counted(batches, grams):
            x = (1 + np.log(tf)) * idf[ids]
            held.append((doc, ids, x / np.sqrt((x * x).sum())))
            rows_held += len(ids)
            if rows_held >= PART:
                yield part()
                held, rows_held = [], 0
        if held:
            yield part()

    return dealt.mapInArrow(values, f"doc_id {kind}, term string, value double")


#: Strings and words that a task remembers, at most about; rows of a batch that it gives.
TERMS, WORDS, PART = 1_000_000, 200_000, 100_000


class Grams:
    """Numbers of the strings inside words; of a fixed vocabulary's only, if there is one."""

    def __init__(self, sizes: tuple[int, int], vocabulary: dict[str, float] | None = None):
        self.sizes, self.fixed = sizes, vocabulary is not None
        self.ids = {t: i for i, t in enumerate(vocabulary)} if self.fixed else {}
        self.words: dict[str, np.ndarray] = {}

    def clear(self) -> None:
        self.ids, self.words = {}, {}

    def of(self, word: str) -> np.ndarray:
        if (found := self.words.get(word)) is None:
            w, ids = f" {word} ", self.ids
            strings = [w[i : i + n] for n in range(self.sizes[0], min(self.sizes[1], len(w)) + 1) for i in range(len(w) - n + 1)]
            found = np.array([ids[s] for s in strings if s in ids] if self.fixed else [ids.setdefault(s, len(ids)) for s in strings], np.int64)
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = found
        return found


def counted(batches: Iterator[pa.RecordBatch], grams: Grams) -> Iterator[tuple[object, np.ndarray, np.ndarray, pa.DataType]]:
    """doc_id, numbers of its strings and how often each occurs, of rows that are sorted by doc_id. Rows of one doc_id are one document; their words are held as counts."""

    def done() -> Iterator[tuple[object, np.ndarray, np.ndarray, pa.DataType]]:
        parts = [(grams.of(w), times) for w, times in held.items()]
        if parts and sum(len(p) for p, _ in parts):
            ids, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            yield doc, ids, np.bincount(at, np.repeat([float(t) for _, t in parts], [len(p) for p, _ in parts])).astype(np.int64), kind

    doc, held, kind, first = None, Counter(), None, True
    for b in batches:
        kind = b.column("doc_id").type
        for d, words in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist()):
            if not first and d != doc:
                yield from done()
                held = Counter()
            doc, first = d, False
            held.update(words)
    yield from done()


def weighed(docs: DataFrame, terms: DataFrame, least_df: int) -> DataFrame:
    """doc_id, term, value: sublinear term frequency times smooth idf, of unit length per document; of terms in least_df documents."""
    tf = terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    n = docs.agg(F.count("*").alias("n"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("x", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("value", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))).select("doc_id", "term", "value")


def label_rows(labels: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, label for each flag that is 1."""
    return labels.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in names]))).alias("label"))


def trivial_labels(rows: DataFrame, documents: int) -> list[str]:
    """The most frequent labels, as many as a document has on average (rounded, one at least)."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").collect()
    mean = sum(r["n"] for r in counts) / max(documents, 1)
    return [r["label"] for r in counts[: max(1, round(mean))]]


def one_vs_rest(docs: DataFrame, rows: DataFrame, labels: list[str], features: int = 1 << 14, c: float = 4.0) -> DataFrame:
    """doc_id, label, held_out of the predicted labels: a balanced logistic regression per label on hashed tf-idf features; every fourth document by hash is held out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    t = docs.select("doc_id", tokens(F.col("text")).alias("t")).withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    hashed = HashingTF(inputCol="t", outputCol="tf", numFeatures=features).transform(t)
    weighed = IDF(inputCol="tf", outputCol="x").fit(hashed).transform(hashed)
    ready = Normalizer(inputCol="x", outputCol="features").transform(weighed).select("doc_id", "held_out", "features")
    out = None
    for name in labels:
        own = ready.join(rows.where(F.col("label") == name).select("doc_id", F.lit(1.0).alias("y")), "doc_id", "left").fillna({"y": 0.0})
        fit = own.where("not held_out")
        n, yes = fit.count(), fit.where("y = 1").count()
        if not yes or yes == n:
            continue
        fit = fit.withColumn("w", F.when(F.col("y") == 1, n / (2.0 * yes)).otherwise(n / (2.0 * (n - yes))))
        model = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / (c * n), standardization=False, maxIter=50).fit(fit)
        part = model.transform(own).where("prediction = 1").select("doc_id", F.lit(name).alias("label"), "held_out")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else ready.where("false").select("doc_id", F.lit("").alias("label"), "held_out")
