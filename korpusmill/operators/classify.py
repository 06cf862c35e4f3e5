"""Rule classifiers on columns: licences and redistribution, proximity of patterns, weighted signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.text import ascii_only, squeeze

# Licence codes by strictness, and whether texts under them may be passed on.
STRICTEST_FIRST = ["cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc-by-nc", "cc-by", "cc0"]

# Words of permission, of negation and of passing a text on, in both languages.
PERMISSION = "allowed|permitted|free to|entitled|granted|may|can|dopu[sš]t\\w*|smij\\w*|slobodno"
NEGATION = "not|nor|cannot|nikad\\w*|ne\\s+smij\\w*"
PASSING_ON = "re-?distribut\\w+|distribut\\w+|share|shared|sharing|copy|copies|copied|umno[zž]\\w+|dijelit\\w*|raspa[cč]\\w+"


def redistribution(licence: Column) -> Column:
    """slobodna, uvjetna, zabranjena, or null where the text names no known licence."""
    t = F.trim(F.regexp_replace(F.lower(ascii_only(licence)), "[^a-z0-9]+", " "))
    has = t.rlike
    by = has("\\bby\\b|attribution")
    return (
        F.when(has("sva prava pridrzana|all rights reserved"), "zabranjena")
        .when(has("cc0|public domain|javno dobro|\\bpdm\\b"), "slobodna")
        .when(~(by | has("creative commons|\\bcc\\b")), None)
        .when(has("\\b(nc|nd)\\b|non ?commercial|no ?deriv"), "uvjetna")
        .when(by | has("\\bsa\\b|sharealike"), "slobodna")
    )


def cc_marks(text: Column) -> Column:
    """Distinct Creative Commons codes that a text names, by address or in words; without either, by the licence's full name."""
    urls = F.regexp_extract_all(text, F.lit("(?i)creativecommons\\.org/(?:licenses|publicdomain)/([a-z0-9-]+)"), 1)
    said = F.regexp_extract_all(text, F.lit("(?i)(?:\\bCC|creative commons)[\\s:,(\\[\"-]*(?:licen[cs]e[\\s:(-]*)?\\b(BY(?:[\\s-]?N[CD])*(?:[\\s-]?SA)?|ZERO|0)\\b"), 1)
    code = lambda x: F.when(x.rlike("(?i)^(0|zero)"), "cc0").otherwise(F.concat(F.lit("cc-"), F.regexp_replace(F.lower(x), "[\\s-]+", "-")))
    marks = F.concat(urls, said)
    chain = F.regexp_extract(text, "(?iU)\\battribution((?:[\\s–-]*(?:non-?commercial|no-?deriv\\w*|share-?alike))*)", 1)
    parts = [F.when(chain.rlike("(?i)commercial"), "nc"), F.when(chain.rlike("(?i)deriv"), "nd").when(chain.rlike("(?i)share"), "sa")]
    full = F.when((F.size(marks) == 0) & text.rlike("(?i)creative\\s+commons") & text.rlike("(?iU)\\battribution"), F.array(F.concat_ws("-", F.lit("cc-by"), *parts))).otherwise(F.array().cast("array<string>"))
    return F.array_intersect(F.array_distinct(F.concat(F.transform(marks, code), full)), F.array(*[F.lit(c) for c in STRICTEST_FIRST]))


def licence_class(rights: Column) -> Column:
    """struct(code, redistributable, ambiguous) of a rights text; the strictest of several marks counts."""
    text = F.coalesce(rights, F.lit(""))
    t, marks = F.lower(text), cc_marks(text)
    strictest = F.coalesce(*[F.when(F.array_contains(marks, c), c) for c in STRICTEST_FIRST])
    # a verb of passing on, with a word of permission close before it and no negation in between
    may = t.rlike(f"(?U)\\b({PERMISSION})\\b(?:(?!\\b({NEGATION})\\b).){{0,66}}?\\b({PASSING_ON})\\b")
    code = (
        F.when(F.trim(text) == "", "nepoznata")
        .when(t.rlike("all rights reserved|sva prava pridr"), "sva-prava")
        .when(F.size(marks) > 0, strictest)
        .when(t.rlike("(?U)permission of the (editor|publisher)|dozvol\\w+ ured"), "dozvola")
        .when(t.rlike("(?U)\\b(personal|educational|osobn\\w+|obrazovn\\w+)\\b[^.;]{0,60}?\\b(purpose\\w*|use|uporab\\w+|svrh\\w+|potreb\\w+)\\b"), "osobno")
        .when(may, "proza-otvorena")
        .when(t.rlike("(?U)\\b(can ?not|may not|must not)\\b|\\bnije dopu[sš]|\\bne smij"), "proza-ogranicena")
        .otherwise("nepoznata")
    )
    return F.struct(code.alias("code"), (code.startswith("cc") | (code == "proza-otvorena")).cast("int").alias("redistributable"), ((F.size(marks) > 1) & code.startswith("cc")).cast("int").alias("ambiguous"))


def near(text: Column, a: str, b: str, window: int = 400) -> Column:
    """Whether a match of pattern a and one of pattern b begin within window characters of each other."""
    return text.rlike(f"(?isu)(?={a}).{{0,{window}}}(?={b})|(?={b}).{{0,{window}}}(?={a})")


def signal_score(text: Column, signals: list[tuple[str, str, int]]) -> tuple[Column, Column]:
    """Sum of the weights of the patterns that a text has, and their names in order."""
    score, names = F.lit(0), []
    for name, pattern, weight in signals:
        hit = F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))
        score = score + F.when(hit, weight).otherwise(0)
        names.append(F.when(hit, F.lit(name)))
    return score, F.array_compact(F.array(*names))


def quoted_in(quote: Column, chunk: Column) -> Column:
    """Whether a quotation stands in a chunk, white space aside."""
    return F.contains(squeeze(chunk), squeeze(quote))


def training_set(docs: DataFrame, labels: DataFrame, least: int = 30, more_than: int = 500) -> DataFrame:
    """doc_id, text, labels: documents (doc_id, text) longer than so many characters, with their labels (doc_id, label) that have enough examples among
    them; documents without such a label are out."""
    long = docs.where(F.length("text") > more_than).select("doc_id", "text")
    pairs = labels.where("label is not null").select("doc_id", "label").distinct().join(long, "doc_id")
    kept = pairs.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
    own = pairs.select("doc_id", "label").join(kept, "label", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return long.join(own, "doc_id")
