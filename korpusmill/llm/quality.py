"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Each document's figures come from one pass over its whole text. Per language and source, the ratios of the documents that
pass the base rule go into log-bucket quantile sketches (a count per bucket of relative width ``GAMMA``): sketches of any
parts merge by adding counts, so the shuffle carries one row per task, group and bucket, and reruns agree. The sketches' quartiles
give the fences that take the place of fixed cutoffs, and the documents are filtered by a join with them.

Defined results: a null text has no words and fails the base rule; null lang or source form groups of their own; repeated
rows are judged each and count each in the sketches; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.llm.common import shift_left, shift_right, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Relative width of a sketch bucket: quantiles are right within 1 %.
GAMMA = 1.02
#: Ratio -> smallest distance of a fence from its quartile. Where most documents agree, the quartiles alone would condemn every other one.
SPREAD = {"symbol_ratio": 0.05, "dup_line_ratio": 0.3, "repeat_ratio": 0.2, "word_length": 3.0}
REACH = 3.0  # interquartile ranges between a quartile and its fence
#: Rows of thresholds up to which they are broadcast (about 100 bytes each); beyond, the join is salted.
BROADCAST_ROWS = 20_000
SALTS = 32


def repeat_words(ws: str) -> dict[str, Column]:
    """Steps that end in n_repeat_words: words in 3-word windows found twice or more. ws names an array of words.

    A window's key has its hash above and its start below, so one primitive sort brings equal windows together; equal
    hashes are confirmed on the words themselves.
    """
    n, w, bits = F.size(ws), F.col(ws), F.length(F.bin(F.size(ws)))
    mask = shift_left(F.lit(1).cast("bigint"), F.col("_bits")) - 1
    at = lambda i: F.get(w, i.cast("int"))
    start = lambda x: x.bitwiseAND(F.col("_mask"))
    get = lambda j: F.get(F.col("_keys"), j)

    def same(j: Column) -> Column:
        a, b = get(j), get(j - 1)
        alike = shift_right(a, F.col("_bits")) == shift_right(b, F.col("_bits"))
        for k in range(3):
            alike = alike & (at(start(a) + k) == at(start(b) + k))
        return alike

    covered = F.aggregate("_starts", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-3).cast("bigint").alias("last")), lambda s, p: F.struct((s.sum + F.least(F.lit(3).cast("bigint"), p - s.last)).alias("sum"), p.alias("last")), lambda s: s.sum)
    return {
        "_bits": bits,
        "_mask": mask,
        "_keys": F.when(n >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: shift_left(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), F.col("_bits")).bitwiseOR(i.cast("bigint"))))),
        "_twins": F.when(F.size("_keys") > 1, F.filter(F.sequence(F.lit(1), F.size("_keys") - 1), same)),
        "_starts": F.when(F.size("_twins") > 0, F.sort_array(F.array_distinct(F.flatten(F.transform("_twins", lambda j: F.array(start(get(j - 1)), start(get(j)))))))),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
    }


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the figures of each document."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", "lang", "source", text.alias("_text"), words(F.col("text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    df = df.select(
        "doc_id", "lang", "source", "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    df = df.withColumn("n_lines", F.size("_lines").cast("bigint")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    for name, step in repeat_words("_words").items():
        df = df.withColumn(name, step)
    return df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))


def ratios() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")}


def sketches(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, metric, bucket, n: a mergeable quantile sketch of each value (>= 0) per group. Bucket null holds the zeros."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("x")) for k, v in values.items()])
    each = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", F.when(F.col("p.x") > 0, F.ceil(F.log("p.x") / F.lit(math.log(GAMMA)))).cast("int").alias("bucket"))
    return each.groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """keys, metric and a column for each q: the smallest bucket at which the counts reach that share."""
    group = [*keys, "metric"]
    w = Window.partitionBy(*group)
    run = sketch.select("*", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first())).alias("upto"), F.sum("n").over(w).alias("total"))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2.0 * F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) / (GAMMA + 1.0))
    return run.groupBy(*group).agg(*[F.min(F.when(F.col("upto") >= q * F.col("total"), value)).alias(k) for k, q in qs.items()])


def thresholds(df: DataFrame) -> DataFrame:
    """lang, source and the fences <ratio>_low and <ratio>_high."""
    keys = ["lang", "source"]
    q = quantiles(sketches(df.where("not base_failed"), keys, ratios()), keys, {"q1": 0.25, "q3": 0.75})
    pick = lambda m, e: F.max(F.when(F.col("metric") == m, e))
    reach = lambda m: F.greatest(REACH * (F.col("q3") - F.col("q1")), F.lit(SPREAD[m]))
    return q.groupBy(*keys).agg(*[pick(m, F.col("q3") + reach(m)).alias(f"{m}_high") for m in SPREAD], pick("word_length", F.col("q1") - reach("word_length")).alias("word_length_low"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the ratios."""
    measured = stored(figures(docs))
    fences = stored(thresholds(measured))
    few = fences.count() <= BROADCAST_ROWS
    left = measured.withColumns(ratios())
    on = F.col("l.lang").eqNullSafe(F.col("f.lang")) & F.col("l.source").eqNullSafe(F.col("f.source"))
    if few:
        fences = F.broadcast(fences)
    else:
        left = left.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)))
        fences = fences.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        on = on & (F.col("l._salt") == F.col("f._salt"))
    joined = left.alias("l").join(fences.alias("f"), on, "left")
    inside = F.lit(True)
    for m in SPREAD:
        inside = inside & (F.col(m) <= F.col(f"{m}_high"))
    inside = inside & (F.col("word_length") >= F.col("word_length_low"))
    return joined.select("l.doc_id", *[f"l.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), *[f"l.{m}" for m in SPREAD])
