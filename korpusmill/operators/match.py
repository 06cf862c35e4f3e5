"""The query language of full-text search: words, "phrases", prefixes*, column filters, AND, OR, NOT and brackets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame

from korpusmill.functions.text import MARKED, PLAIN
from korpusmill.operators import search

PIECE = re.compile(r'\s*(?:(?P<column>\w+)\s*:|"(?P<phrase>[^"]*)"\s*(?P<open>\*)?|(?P<word>\w+)(?P<star>\*)?|(?P<bracket>[()]))')
Test = Callable[[list[Column]], Column]


class QueryError(ValueError):
    """A query that isn't valid syntax."""


@dataclass
class Parsed:
    """Phrases of folded tokens, the column that each is limited to (or None), and how their hits combine."""

    phrases: list[list[str]] = field(default_factory=list)
    scopes: list[str | None] = field(default_factory=list)
    test: Test | None = None


def folded(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(MARKED, PLAIN)))


def parse(query: str) -> Parsed:
    pieces, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = PIECE.match(query, at)
        if not m:
            raise QueryError(f"not understood at {at}: {query[at:]!r}")
        pieces.append(m)
        at = m.end()
    out = Parsed()

    def word_is(*names: str) -> bool:
        return bool(pieces) and pieces[0]["word"] in names and not pieces[0]["star"]

    def unit() -> Test:
        if not pieces or word_is("AND", "OR", "NOT"):
            raise QueryError("a word or phrase is missing")
        p = pieces.pop(0)
        if p["bracket"] == "(":
            inner = either()
            if not pieces or pieces.pop(0)["bracket"] != ")":
                raise QueryError("a bracket is open")
            return inner
        scope = p["column"]
        if scope:
            if not pieces:
                raise QueryError("a column filter without a word")
            p = pieces.pop(0)
        tokens = folded(p["word"] or p["phrase"] or "")
        if not tokens:
            raise QueryError("an empty phrase")
        if p["star"] or p["open"]:
            tokens[-1] += "*"
        out.phrases.append(tokens)
        out.scopes.append(scope)
        return lambda hits, k=len(out.phrases) - 1: hits[k]

    def minus() -> Test:
        left = unit()
        while word_is("NOT"):
            pieces.pop(0)
            left = lambda hits, a=left, b=unit(): a(hits) & ~b(hits)
        return left

    def every() -> Test:
        parts = [minus()]
        while pieces and not word_is("OR") and pieces[0]["bracket"] != ")":
            if word_is("AND"):
                pieces.pop(0)
            parts.append(minus())
        return lambda hits: reduce(lambda a, b: a & b, [p(hits) for p in parts])

    def either() -> Test:
        parts = [every()]
        while word_is("OR"):
            pieces.pop(0)
            parts.append(every())
        return lambda hits: reduce(lambda a, b: a | b, [p(hits) for p in parts])

    out.test = either()
    if pieces:
        raise QueryError("a bracket is closed that wasn't open")
    return out


def ask(docs: DataFrame, query: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id and score of a query string; a query that isn't valid raises QueryError."""
    q = parse(query)
    unknown = {s for s in q.scopes if s} - set(columns or ["text"])
    if unknown:
        raise QueryError(f"no such column: {', '.join(sorted(unknown))}")
    return search.ranked(docs, q.phrases, every=q.test, where=where, columns=columns, scope=q.scopes)


def search_text(docs: DataFrame, query: str, columns: list[str] | None = None, limit: int = 50) -> DataFrame:
    """The best documents of a query string; one that isn't valid syntax is looked for as a plain substring."""
    try:
        return search.best(ask(docs, query, columns), limit)
    except QueryError:
        return search.contains(docs, query).select("doc_id", "score").orderBy("doc_id").limit(limit)
