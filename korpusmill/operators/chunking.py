"""Texts to overlapping passages, as a fold over paragraphs or numbered points (native: higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Target, hard maximum, overlap and least length of a passage, in characters.
TARGET, MOST, OVERLAP, LEAST = 1100, 1600, 200, 60
POINT = "(?md)^\\s*\\d{1,3}(?:\\.\\d{1,2})*\\.?\\s"


def windows(s: Column, width: int, step: int) -> Column:
    """Stretches of width characters, a new one every step, as long as something new begins."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda a: F.substr(s, a + 1, F.lit(width)))


def segments(text: Column) -> Column:
    """Numbered points if there are three or more, else lines."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t]+", " "))
    return F.when(F.regexp_count(t, F.lit(POINT)) >= 3, F.split(t, f"(?={POINT})")).otherwise(F.split(t, "\n"))


def passages(text: Column) -> Column:
    """Packed passages in order: a full buffer is closed and its tail opens the next; an overlong segment goes in windows."""
    strip = lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")
    parts = F.filter(F.transform(segments(text), strip), lambda s: s != "")
    none = F.array().cast("array<string>")
    closed = lambda st: F.when(st.buf != "", F.concat(st.out, F.array(st.buf))).otherwise(st.out)

    def add(st: Column, s: Column) -> Column:
        long = F.struct(F.concat(closed(st), windows(s, TARGET, TARGET - OVERLAP)).alias("out"), F.lit("").alias("buf"))
        tail = F.when(F.length(st.buf) > OVERLAP, F.concat(F.right(st.buf, F.lit(OVERLAP)), F.lit("\n"))).otherwise("")
        full = F.struct(closed(st).alias("out"), F.concat(tail, s).alias("buf"))
        more = F.struct(st.out.alias("out"), F.when(st.buf == "", s).otherwise(F.concat(st.buf, F.lit("\n"), s)).alias("buf"))
        return F.when(F.length(s) > MOST, long).when((st.buf != "") & (F.length(st.buf) + F.length(s) + 1 > TARGET), full).otherwise(more)

    packed = F.aggregate(parts, F.struct(none.alias("out"), F.lit("").alias("buf")), add, closed)
    guarded = F.flatten(F.transform(packed, lambda c: F.when(F.length(c) > MOST, windows(c, MOST, MOST - OVERLAP)).otherwise(F.array(c))))
    return F.filter(F.transform(guarded, strip), lambda c: F.length(c) > LEAST)


def chunk(docs: DataFrame) -> DataFrame:
    """doc_id, ord, chunk."""
    return docs.select("doc_id", F.posexplode(passages(F.col("text"))).alias("ord", "chunk"))


def masked_lines(text: Column) -> Column:
    """Trimmed lower-case lines with # for digits, of 8 to 120 characters."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.regexp_replace(F.lower(F.trim(s)), "[0-9]", "#")), lambda s: F.length(s).between(8, 120))


def running_lines(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, line, times of the lines that a document repeats so often."""
    each = docs.select("doc_id", F.explode(masked_lines(F.col("text"))).alias("line"))
    return each.groupBy("doc_id", "line").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def upper_median_line(text: Column, more_than: int = 20) -> Column:
    """Upper median of the lengths of lines longer than that; null if there is none."""
    n = F.array_sort(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.length), lambda x: x > more_than))
    return F.when(F.size(n) > 0, F.element_at(n, (F.floor(F.size(n) / 2) + 1).cast("int")))
