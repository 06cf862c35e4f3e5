"""Articles from PDF text to passages under their headings, as folds over lines (native: higher-order functions).

Lines lose hyphenation, page numbers and running headers; the bibliography is cut; hard-wrapped lines join up to paragraphs; paragraphs are packed
with their heading in front. A null or empty text has no passages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.text import squeeze
from korpusmill.operators.chunking import LEAST, MOST, OVERLAP, TARGET, windows

# Patterns and words that tell headings, page numbers and bibliographies.
HYPHEN = "([a-zà-ž])\\s*[-­]\\s*\\n\\s*([a-zà-ž])"
PAGE_NUMBER = "(?U)^\\s*[^\\w\\s]{0,2}\\s*\\d{1,4}\\s*[^\\w\\s]{0,2}\\s*$"
NUMBERED = "^\\s*\\d{1,2}(?:\\.\\d{1,2}){0,3}\\.?\\s+\\S"
HEADING_WORDS = ["uvod", "zakljucak", "zaključak", "sazetak", "sažetak", "summary", "abstract", "introduction", "conclusion", "keywords", "kljucne rijeci", "ključne riječi"]
BIBLIOGRAPHY = "(?iuU)^\\s*(?:\\d{1,2}\\.?\\s*)?(?:popis\\s+)?(?:literatur\\w*|bibliografij\\w*|reference\\w*|references|izvori\\s+i\\s+literatura|pravni\\s+izvori)\\s*:?\\s*$"
# A paragraph's least length, the least line that can go on, and the part of the median line below which a line ends a paragraph.
PARAGRAPH, SHORT_LINE, SHARE = 40, 28, 0.75


def blank() -> Column:
    return F.lit("")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, even where body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, "(?U)^\\s+|\\s+$", "")


def line_key(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), "(?U)\\d+", "#")


def clean_lines(text: Column) -> Column:
    """Lines without hyphenation, page numbers and running headers (lines found three times or more, unless they are over a quarter of all)."""
    whole = F.replace(F.regexp_replace(F.coalesce(text, blank()), HYPHEN, "$1$2"), F.lit("­"), blank())
    sorted_keys = lambda ls: F.array_sort(F.filter(F.transform(ls, line_key), lambda k: F.length(k).between(8, 120)))
    third = lambda ks: F.array_distinct(F.filter(ks, lambda k, i: (i >= 2) & (F.get(ks, i - 2) == k)))

    def kept(ls: Column, running: Column) -> Column:
        hits = F.size(F.filter(ls, lambda x: F.array_contains(running, line_key(x))))
        few = hits <= F.greatest(F.lit(3), F.floor(F.size(ls) / 4))
        return let(few, lambda ok: F.filter(ls, lambda x: (x != "") & ~x.rlike(PAGE_NUMBER) & ~(ok & F.array_contains(running, line_key(x)))))

    return let(F.transform(F.split(whole, "\n"), strip), lambda ls: let(let(sorted_keys(ls), third), lambda running: kept(ls, running)))


def is_heading(line: Column) -> Column:
    """A heading word, a numbered line or one in capitals, of 3 to 100 characters, that doesn't end as a sentence does."""
    numbered, n = line.rlike(NUMBERED), F.length(line)
    capitals = line.rlike("\\p{Lu}") & ~line.rlike("\\p{Ll}")
    letters = F.regexp_count(line, F.lit("\\p{L}"))
    known = F.regexp_replace(F.lower(line), "^[ :.]+|[ :.]+$", "").isin(HEADING_WORDS)
    marked = known | numbered & (n <= 90) & ~line.rlike("[,;]$") | (letters >= 4) & (F.regexp_count(line, F.lit("\\p{Lu}")) > 0.8 * letters)
    return n.between(3, 100) & (~line.rlike("[.,;:]$") | numbered | capitals) & marked


def without_bibliography(lines: Column) -> Column:
    """Lines up to the first bibliography heading that stands after 40 % of them."""
    at = F.array_min(F.transform(lines, lambda x, i: F.when((i > 0.4 * F.size(lines)) & x.rlike(BIBLIOGRAPHY), i)))
    return F.slice(lines, F.lit(1), F.coalesce(at, F.size(lines)))


def paragraphs(lines: Column) -> Column:
    """Array of struct(title, text): paragraphs under the last heading before them; a line shorter than most ends one."""
    lengths = F.array_sort(F.filter(F.transform(lines, F.length), lambda n: n > 20))
    median = F.get(lengths, F.floor(F.size(lengths) / 2).cast("int"))
    short = F.coalesce(F.greatest(F.lit(SHORT_LINE), F.floor(median * SHARE).cast("int")), F.lit(1 << 30))
    pair = lambda title, text: F.array(F.struct(title.alias("title"), text.alias("text")))
    closed = lambda st, buf: F.when(F.length(squeeze(buf)) >= PARAGRAPH, F.concat(st.out, pair(st.title, squeeze(buf)))).otherwise(st.out)
    state = lambda out, title, buf: F.struct(out.alias("out"), title.alias("title"), buf.alias("buf"))

    def add(least: Column) -> Callable[[Column, Column], Column]:
        def step(st: Column, x: Column) -> Column:
            joined = F.when(st.buf == "", x).otherwise(F.concat(st.buf, F.lit(" "), x))
            return F.when(is_heading(x), state(closed(st, st.buf), x, blank())).when(F.length(x) < least, state(closed(st, joined), st.title, blank())).otherwise(state(st.out, st.title, joined))

        return step

    none = F.array().cast("array<struct<title:string,text:string>>")
    found = let(short, lambda least: F.aggregate(lines, state(none, blank(), blank()), add(least), lambda st: closed(st, st.buf)))
    bare = F.transform(F.filter(lines, lambda x: is_heading(x) & (F.length(x) >= PARAGRAPH)), lambda x: F.struct(blank().alias("title"), x.alias("text")))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(bare))


def headed(title: Column, body: Column) -> Column:
    """The body with its heading in front, unless it begins with it already."""
    there = F.contains(F.lower(F.substring(body, 1, 120)), F.lower(title))
    return F.when((title != "") & ~there, F.concat(title, F.lit("\n"), body)).otherwise(body)


def pack(pairs: Column) -> Column:
    """Passages of struct(title, text): a full buffer is closed and its tail opens the next; an overlong paragraph goes in windows."""
    state = lambda out, buf, title: F.struct(out.alias("out"), buf.alias("buf"), title.alias("title"))
    closed = lambda st, title: F.when(strip(st.buf) != "", F.concat(st.out, F.array(headed(title, strip(st.buf))))).otherwise(st.out)

    def add(st: Column, p: Column) -> Column:
        title = F.when(st.buf == "", p.title).otherwise(st.title)
        cut = F.transform(windows(p.text, TARGET, TARGET - OVERLAP), lambda w: headed(p.title, strip(w)))
        tail = F.when(F.length(st.buf) > OVERLAP, F.concat(F.right(st.buf, F.lit(OVERLAP)), F.lit("\n"))).otherwise("")
        more = F.when(st.buf == "", p.text).otherwise(F.concat(st.buf, F.lit("\n"), p.text))
        long = F.length(p.text) + F.length(p.title) + 1 > MOST
        full = (st.buf != "") & (F.length(st.buf) + F.length(p.text) + F.length(title) + 2 > TARGET)
        return F.when(long, state(F.concat(closed(st, st.title), cut), blank(), p.title)).when(full, state(closed(st, title), F.concat(tail, p.text), p.title)).otherwise(state(st.out, more, title))

    packed = F.aggregate(pairs, state(F.array().cast("array<string>"), blank(), blank()), add, lambda st: closed(st, st.title))
    guarded = F.flatten(F.transform(packed, lambda c: F.when(F.length(c) > MOST, windows(c, MOST, MOST - OVERLAP)).otherwise(F.array(c))))
    return F.filter(F.transform(guarded, strip), lambda c: F.length(c) > LEAST)


def article_passages(text: Column) -> Column:
    return let(clean_lines(text), lambda ls: let(without_bibliography(ls), lambda body: let(paragraphs(body), pack)))


def chunk_articles(docs: DataFrame) -> DataFrame:
    """doc_id, ord, chunk."""
    return docs.select("doc_id", F.posexplode(article_passages(F.col("text"))).alias("ord", "chunk"))
