"""URL filtering with a Bloom filter cascade over listed rule keys (native: DataFrame functions only).

A rule is a host and a path prefix. A url's candidate keys are its host suffixes joined to its path prefixes, for the
(labels, path length) shapes that occur among the rules. The cascade for a list holds level 1 over the listed keys, level 2
over the keys of the corpus's complete universe that pass level 1 without being listed, level 3 over the listed keys that pass
level 2, and so on until nothing passes wrongly. A key of the universe is listed iff it passes an odd number of levels in a row,
so membership is exact and needs no join: each level is one bit array, read through a scalar subquery.

Defined results: a null url, or one without ``://``, has empty host and path and matches no rule; repeated rows are judged
each; an empty table or an empty list gives no match; extra columns are ignored. A key in both lists counts as blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.llm.common import ascii_lower, shift_left, stored, values

#: Bits of one level at most (16 MB): what one task may hold of it. A longer list has to be split by host.
MAX_BITS = 1 << 27


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # block or allow

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidate(host: Column, path: Column, shape: tuple[int, int]) -> Column:
    """The url's key of one shape; null if its host or path is too short for it."""
    labels, length = shape
    suffix = F.substring_index(host, ".", -labels)
    fits = (F.size(F.split(host, "\\.")) >= labels) & (F.length(path) >= length) & (host != "")
    return F.when(fits, F.concat(suffix, F.substring(path, 1, length)))


@dataclass(frozen=True)
class Level:
    bits: DataFrame  # one row: words array<bigint>
    m: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed + j)), F.lit(self.m)) for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        held = self.bits.scalar()
        tests = [F.getbit(F.element_at(held, (F.floor(p / 64) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.positions(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def build_level(keys: DataFrame, n: int, bits_per_key: float, hashes: int, seed: int) -> Level:
    """Bit array of the keys (column key): set bits are or-ed per word, then laid out as one row."""
    spark = keys.sparkSession
    m = max(64, -(-int(n * bits_per_key) // 64) * 64)
    if m > MAX_BITS:
        raise ValueError(f"{n} keys need {m} bits in one level; the bound is {MAX_BITS}. Split the list by host.")
    empty = Level(None, m, hashes, seed)
    spots = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    by_word = spots.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(shift_left(F.lit(1).cast("bigint"), F.pmod(F.col("p"), F.lit(64)).cast("int"))).alias("bits"))
    dense = spark.range(m // 64).select(F.col("id").alias("word")).join(by_word, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    row = dense.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")).select(F.transform("all", lambda x: x.bits).alias("words"))
    return Level(stored(row), m, hashes, seed)


class Cascade:
    """Exact membership of the universe's keys in a list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, bits_per_key: float = 10.0, hashes: int = 4) -> Cascade:
        """Both have a column key. Keys outside the universe are never asked for, so they are left out."""
        distinct = listed.where("key is not null").select("key").distinct()
        marked = universe.where("key is not null").select("key").distinct().join(distinct.withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.col("listed").isNotNull())
        marked = stored(marked)
        inside, other = marked.where("listed").select("key"), marked.where("not listed").select("key")
        levels, n = [], inside.count()
        while n:
            first = not levels
            level = build_level(inside, n, bits_per_key if first else 2.0, hashes if first else 1, 1000 * (len(levels) + 1))
            levels.append(level)
            wrong = stored(other.where(level.passes(F.col("key"))))
            inside, other, n = wrong, inside, wrong.count()
        return cls(levels)

    def listed(self, key: Column) -> Column:
        """Odd number of levels passed in a row; false for a null key."""
        out = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[at].passes(key), out).otherwise(F.lit(at % 2 == 1))
        return F.when(key.isNull(), F.lit(False)).otherwise(out) if self.levels else F.lit(False)


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict of each row of pages (page_id, url)."""
    spark: SparkSession = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    shapes = sorted({r.shape for r in rules})
    keys = [candidate(F.col("host"), F.col("path"), s) for s in shapes]
    if not shapes:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    universe = stored(parts.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct())
    lists = {v: values(spark, "key", [r.key for r in rules if r.verdict == v]) for v in ("block", "allow")}
    cascades = {v: Cascade.build(keys_of, universe) for v, keys_of in lists.items()}
    keyed = parts.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    hits = []
    for i in range(len(shapes)):
        key = F.col(f"_k{i}")
        verdict = F.when(cascades["block"].listed(key), F.lit("block")).when(cascades["allow"].listed(key), F.lit("allow"))
        hits.append(F.when(verdict.isNotNull(), F.struct(F.length(key).alias("n"), key.alias("rule"), verdict.alias("verdict"))))
    best = F.array_max(F.array_compact(F.array(*hits)))
    return keyed.withColumn("_best", best).select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
