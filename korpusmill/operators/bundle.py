"""Query bundles: several questions asked together, by words, by vectors or both, and fused with their provenance."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The branches and the prefixes that queries are embedded with.
HYBRID, VECTOR, WORDS = "hibrid", "vektor", "bm25"
QUERY, PASSAGE = "query", "passage"


@dataclass(frozen=True)
class Question:
    """One question: its text, branch, embedding prefix, weight and label. A passage is only ever looked for by vectors."""

    text: str
    branch: str = HYBRID
    prefix: str = QUERY
    weight: float = 1.0
    label: str = ""

    def __post_init__(self):
        text = (self.text or "").strip()
        if not text:
            raise ValueError("an empty question")
        if self.branch not in (HYBRID, VECTOR, WORDS):
            raise ValueError(f"no such branch: {self.branch}")
        if self.prefix not in (QUERY, PASSAGE):
            raise ValueError(f"no such prefix: {self.prefix}")
        if self.prefix == PASSAGE and self.branch == WORDS:
            raise ValueError("a passage can't be looked for by words")
        short = " ".join(text.split())
        short = short if len(short) <= 56 else short[:53].rstrip() + "..."
        for name, value in (("text", text), ("branch", VECTOR if self.prefix == PASSAGE else self.branch), ("label", self.label or short)):
            object.__setattr__(self, name, value)

    @classmethod
    def hypothetical(cls, passage: str, weight: float = 1.0) -> Question:
        """A made-up answer, looked for by vectors as if it were a passage."""
        plain = cls(passage, VECTOR, PASSAGE, weight)
        return cls(passage, VECTOR, PASSAGE, weight, f"hyde: {plain.label}")

    @property
    def branches(self) -> list[str]:
        return [WORDS, VECTOR] if self.branch == HYBRID else [self.branch]


def questions(given: str | dict | Question | Iterable) -> list[Question]:
    """Questions in order from strings, dicts and questions; the first of those with equal text, branch and prefix stays."""
    one = lambda x: x if isinstance(x, Question) else Question(**x) if isinstance(x, dict) else Question(x)
    found = [one(given)] if isinstance(given, (str, dict, Question)) else [one(x) for x in given]
    return list({(q.text, q.branch, q.prefix): q for q in reversed(found)}.values())[::-1]


def table(spark: SparkSession, asked: list[Question]) -> DataFrame:
    """qpos, text, branch, prefix, weight, label: a row for each branch of each question."""
    rows = [(i, q.text, b, q.prefix, float(q.weight), q.label) for i, q in enumerate(asked) for b in q.branches]
    return spark.createDataFrame(rows, "qpos int, text string, branch string, prefix string, weight double, label string")


def explain(fused: DataFrame, most: int = 3) -> DataFrame:
    """fused hits (score, provenance as written by retrieval.fuse) with labels, branches and a line of explanation."""
    parts = F.split("provenance", "(?<=/\\d{1,9}) ")
    at = lambda k: F.array_distinct(F.transform(parts, lambda p: F.regexp_extract(p, "^(.*)/([^/]*)/\\d+$", k)))
    return fused.select("*", at(1).alias("labels"), at(2).alias("branches"), F.array_join(F.slice(parts, 1, most), "; ").alias("explanation"))
