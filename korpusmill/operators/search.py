"""Full-text search: boolean, phrase, prefix and column queries, ranked by BM25.

A query is a list of phrases; a phrase is a list of folded tokens, the last of which may be a prefix (``abc*``). The corpus's figures (documents, average
length, documents per phrase) are always those of the whole corpus, so a filter on documents never changes a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.functions.text import fold, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def matches(token: Column, term: str) -> Column:
    return token.startswith(term[:-1]) if term.endswith("*") else token == term


def places(toks: Column, phrase: list[str]) -> Column:
    """Indexes at which the phrase begins."""
    at = F.sequence(F.lit(0), F.size(toks) - F.lit(len(phrase)))
    hit = lambda i: reduce(lambda a, b: a & b, [matches(F.get(toks, i + k), t) for k, t in enumerate(phrase)])
    return F.when(F.size(toks) >= len(phrase), F.filter(at, hit)).otherwise(F.array().cast("array<int>"))


def frequency(toks: Column, phrase: list[str]) -> Column:
    return F.size(F.filter(toks, lambda x: matches(x, phrase[0]))) if len(phrase) == 1 else F.size(places(toks, phrase))


def ranked(docs: DataFrame, phrases: list[list[str]], every: bool | Callable[[list[Column]], Column] = True, where: Column | None = None, columns: list[str] | None = None, scope: str | list[str | None] | None = None) -> DataFrame:
    """doc_id and score (lower is better) of the documents with all phrases, with any, or that pass a test of the phrases' hits. columns are
    indexed; scope limits the match to one of them, for all phrases or for each."""
    names = columns or ["text"]
    whole = tokens(F.concat_ws("\n", *names))
    tf = [F.col(f"_tf{i}") for i in range(len(phrases))]
    scopes = scope if isinstance(scope, list) else [scope] * len(phrases)
    df = docs.select("*", F.size(whole).alias("_len"))
    for s in dict.fromkeys(scopes):
        own = [i for i, x in enumerate(scopes) if x == s]
        # the transform over one array binds the tokens once; as a column they would be split again for every token
        all_tf = lambda t: F.array(*[frequency(t, phrases[i]) for i in own])  # noqa: B023,E731
        df = df.select("*", F.get(F.transform(F.array(tokens(F.col(s)) if s else whole), all_tf), F.lit(0)).alias("_all"))
        df = df.select("*", *[F.get("_all", F.lit(k)).alias(f"_tf{i}") for k, i in enumerate(own)]).drop("_all")
    figures = df.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *[F.count_if(t > 0).alias(f"df{i}") for i, t in enumerate(tf)]).first()
    score = F.lit(0.0)
    for i, t in enumerate(tf):
        df_i = figures[f"df{i}"]
        idf = max(math.log((figures["n"] - df_i + 0.5) / (df_i + 0.5)), LEAST_IDF) if figures["n"] else 0.0
        score = score - F.lit(idf) * (t * (K1 + 1)) / (t + K1 * (1 - B + B * F.col("_len") / F.lit(figures["avg"] or 1.0)))
    found = [t > 0 for t in tf]
    df = df.where(every(found) if callable(every) else reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), found))
    return (df.where(where) if where is not None else df).select("doc_id", F.round(score, 6).alias("score"))


def best(scored: DataFrame, n: int = 20) -> DataFrame:
    return scored.orderBy("score", "doc_id").limit(n)


def document_frequency(docs: DataFrame, forms: list[str]) -> DataFrame:
    """form and df: documents with a token of each form."""
    df = docs.select(tokens(F.col("text")).alias("t"))
    test = lambda form: F.exists("t", lambda x: matches(x, form))
    one = df.agg(*[F.count_if(test(f)).alias(f) for f in forms])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"`{f}`").alias("df")) for f in forms])).alias("x")).select("x.form", "x.df")


def snippet(text: Column, phrase: list[str], width: int = 24, marks: tuple[str, str] = ("»", "«")) -> Column:
    """The width words that hold most hits, with the hit words marked: of the windows that begin with a hit or hold it in the middle, the first one with most."""
    ws = F.split(text, "\\s+")
    hit = lambda w: F.exists(tokens(w), lambda t: reduce(lambda a, b: a | b, [matches(t, p) for p in phrase]))
    spots = lambda w: F.filter(F.transform(w, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())
    begins = lambda at: F.transform(F.concat(F.transform(at, lambda i: F.greatest(i - width // 2, F.lit(0))), at), lambda i: F.struct((-F.size(F.filter(at, lambda j: (j >= i) & (j < i + width)))).alias("hits"), i.alias("at")))
    best = F.get(F.transform(F.array(spots(ws)), lambda at: F.coalesce(F.array_min(begins(at))["at"], F.lit(0))), F.lit(0))
    part = F.transform(F.slice(ws, best + 1, F.lit(width)), lambda w: F.when(hit(w), F.concat(F.lit(marks[0]), w, F.lit(marks[1]))).otherwise(w))
    return F.array_join(part, " ")


def contains(docs: DataFrame, query: str, most: int = 50) -> DataFrame:
    """The fallback for a query that isn't valid syntax: the folded query as a substring of the lower-cased text (whose marked letters stay), rank 0, and the first
    300 characters, of so many documents in order of doc_id."""
    folded = fold(F.lit(query.replace('"', "")))
    return docs.where(F.contains(F.lower("text"), folded)).select("doc_id", F.lit(0.0).alias("score"), F.substring("text", 1, 300).alias("excerpt")).orderBy("doc_id").limit(most)


def postings(docs: DataFrame) -> DataFrame:
    """token, doc_id, tf, positions: an inverted index to be written sorted by token."""
    each = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return each.groupBy("token", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def prefix_growth(docs: DataFrame, word: str, least: int = 3, step: float = 3.0) -> DataFrame:
    """prefix, size, df, growth (against the prefix that is a letter longer; null for the word itself) and take: whether the word may be shortened
    so far, that is, whether no step on the way multiplies the documents by more than step."""
    forms = {n: word[:n] for n in range(least, len(word) + 1)}
    found = document_frequency(docs, [f"{p}*" for p in forms.values()]).select(F.expr("substring(form, 1, length(form) - 1)").alias("prefix"), F.col("df").cast("bigint").alias("df"))
    sized = found.withColumn("size", F.length("prefix"))
    longer = Window.orderBy(F.desc("size"))  # one row for each letter of a word
    grown = sized.withColumn("growth", F.round(F.try_divide("df", F.lag("df").over(longer)), 6))
    return grown.withColumn("take", F.coalesce(F.max("growth").over(longer.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) <= step)
