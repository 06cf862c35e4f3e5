"""Scoring of decisions by patterns: a statute's article near its name, weighted signals, another statute's penalty, the outcome and contexts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.text import squeeze


@dataclass(frozen=True)
class Scoring:
    article: str
    statute: str
    signals: tuple[tuple[str, str, int], ...]
    other: str  # a statute whose mention without the statute counts against a decision
    granted: str
    rejected: str
    window: int = 400
    bonus: int = 6
    threshold: int = 6
    names: tuple[str, str] = ("near", "other statute")
    outcomes: tuple[str, str] = ("granted", "rejected")


# Names, patterns and weights of the exchange of forest land under article 55.
FOREST_EXCHANGE = Scoring(
    article="čl(?:anak|anka|ankom|anku|\\.)\\s*55|\\b55\\.\\s*(?:st|Zakona)",
    statute="zakon[a-z]*\\s+o\\s+šumama|\\bZŠ\\b",
    signals=(
        ("okrupnjivanje šuma", "okrupnjivanj[a-z]*\\s+(?:šum|drž)", 4),
        ("gospodarska jedinica", "(?:iste|susjedn[a-z]*)\\s+gospodarsk[a-z]*\\s+jedinic", 4),
        ("ugovor o zamjeni nekretnina", "ugovor[a-z]*\\s+o\\s+zamjeni\\s+nekretnin", 3),
        ("odluka o zamjeni šuma", "odluk[a-z]*\\s+o\\s+zamjeni\\s+šum", 5),
        ("srazmjerna vrijednost / 5 %", "srazmjern[a-z]*\\s+vrijednost|odstupanj[a-z]*\\s+od\\s*5\\s*%", 3),
        ("zamjena + šumsko zemljište", "zamjen[a-z]*[^.]{0,120}šumsk[a-z]*\\s+zemljišt", 2),
        ("Hrvatske šume / javni šumoposjednik", "Hrvatske\\s+šume|javn[a-z]*\\s+šumoposjednik", 1),
        ("ministar sklapa ugovor", "ministar[a-z]*\\s+sklapa\\s+ugovor", 3),
    ),
    other="zakon[a-z]*\\s+o\\s+naknadi",
    granted="usvaja\\s+se\\s+tužben|poništava\\s+se\\s+rješenj|nalaže\\s+se[^.]{0,80}sklopi|utvrđuje\\s+se\\s+da\\s+je[^.]{0,80}zamjen",
    rejected="odbija\\s+se\\s+tužben[a-z]*\\s+zahtjev|odbija\\s+se\\s+tužba|odbija\\s+se\\s+žalba",
    names=("čl.55 + Zakon o šumama (blizina)", "(!) čl.55 Zakona o naknadi — drugi propis"),
    outcomes=("zahtjev USVOJEN (barem djelomično)", "zahtjev ODBIJEN"),
)


def any_case(pattern: str) -> str:
    return f"(?iU)(?:{pattern})"


def starts(text: Column, pattern: str) -> Column:
    """Where the pattern's matches begin, from 0: the texts between them and the matches add up."""
    between, found = F.split(text, any_case(pattern), -1), F.regexp_extract_all(text, F.lit(any_case(pattern)), 0)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("f"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda s, p: F.struct((s["at"] + F.length(p["b"]) + F.length(p["f"])).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(p["b"]))).alias("all"))
    return F.aggregate(pairs, begin, step, lambda s: s["all"])


def contexts(text: Column, a: str, b: str, window: int = 400, before: int = 200, after: int = 500) -> Column:
    """For each match of a that begins within window characters of one of b: the text round the earlier of the two, its white space squeezed."""
    def near(x: Column, others: Column) -> Column:
        first = F.get(F.filter(others, lambda y: F.abs(x - y) <= window), F.lit(0))
        return F.when(first.isNotNull(), F.least(x, first))

    def cut(x: Column) -> Column:
        begin = F.greatest(x - before, F.lit(0))
        return squeeze(F.substr(text, begin + 1, x + after - begin))

    spots = F.transform(F.array(starts(text, b)), lambda others: F.array_compact(F.transform(starts(text, a), lambda x: near(x, others))))
    return F.transform(F.get(spots, F.lit(0)), cut)


def assess(docs: DataFrame, rules: Scoring = FOREST_EXCHANGE) -> DataFrame:
    """doc_id, score, signals, outcome ('' if none shows) and up to three contexts. A null text has no signal."""
    text = F.coalesce("text", F.lit(""))
    has = lambda p: text.rlike(any_case(p))
    near = contexts(text, rules.article, rules.statute, rules.window)
    df = docs.select("doc_id", "text", near.alias("_near"))
    tests = [(rules.names[0], F.size("_near") > 0, rules.bonus), *((n, has(p), w) for n, p, w in rules.signals), (rules.names[1], has(rules.other) & ~has(rules.statute), -rules.bonus)]
    score = F.lit(0)
    for _, test, weight in tests:
        score = score + F.when(test, weight).otherwise(0)
    outcome = F.when(has(rules.granted), rules.outcomes[0]).when(has(rules.rejected), rules.outcomes[1]).otherwise("")
    return df.select("doc_id", score.alias("score"), F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t, _ in tests])).alias("signals"), outcome.alias("outcome"), F.slice("_near", 1, 3).alias("contexts"))


def candidates(assessed: DataFrame, threshold: int = 6) -> DataFrame:
    """The decisions that reach the threshold, best first; ties by doc_id."""
    return assessed.where(F.col("score") >= threshold).orderBy(F.desc("score"), "doc_id")


def cooccurrence(docs: DataFrame, a: str, b: str, windows: tuple[int, ...] = (1600, 360)) -> DataFrame:
    """scope ('document' or a window in characters), documents: how many have both patterns, and how many within each window."""
    both = F.coalesce(F.col("text").rlike(any_case(a)) & F.col("text").rlike(any_case(b)), F.lit(False))
    within = lambda w: F.exists(F.transform(F.array(starts(F.col("text"), b)), lambda ys: F.exists(starts(F.col("text"), a), lambda x: F.exists(ys, lambda y: F.abs(x - y) <= w))), lambda x: x)
    found = docs.where(both).agg(F.count("*").alias("document"), *[F.count_if(within(w)).alias(str(w)) for w in windows])
    names = ["document", *map(str, windows)]
    return found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("scope"), F.col(n).alias("documents")) for n in names])).alias("x")).select("x.*")


def naive_precision(docs: DataFrame, article: str, statute: str, window: int = 400) -> DataFrame:
    """naive (documents with the article), near (those with the statute's name close by) and their ratio."""
    hit = docs.where(F.col("text").rlike(any_case(article))).select(F.size(contexts(F.col("text"), article, statute, window)).alias("n"))
    return hit.agg(F.count("*").alias("naive"), F.count_if(F.col("n") > 0).alias("near")).withColumn("precision", F.round(F.try_divide("near", "naive"), 6))
