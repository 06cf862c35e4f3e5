"""Command line: python -m korpusmill search|chunk|stats|run, over a folder of Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.operators import article, chunking, match
from korpusmill.plans import registry


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="korpusmill", description=__doc__)
    p.add_argument("--tables", required=True, help="folder of Parquet tables")
    p.add_argument("--output", help="write the result as Parquet here rather than show it")
    sub = p.add_subparsers(dest="command", required=True)
    search = sub.add_parser("search", help="documents that match a query string, best first")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=50)
    chunk = sub.add_parser("chunk", help="passages of all documents")
    chunk.add_argument("--articles", action="store_true")
    sub.add_parser("stats", help="documents and bytes by source")
    run = sub.add_parser("run", help="a registered query")
    run.add_argument("name", choices=sorted(registry.QUERIES))
    return p.parse_args(given)


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command == "run":
        return registry.QUERIES[a.name](spark, a.tables)
    docs = registry.read(spark, a.tables, "documents")
    if a.command == "search":
        return match.search_text(docs, a.query, limit=a.limit)
    if a.command == "chunk":
        return (article.chunk_articles if a.articles else chunking.chunk)(docs)
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("documents"), "source")


def main(given: list[str] | None = None) -> None:
    a = arguments(given)
    found = result(SparkSession.builder.appName("korpusmill").getOrCreate(), a)
    found.write.parquet(a.output) if a.output else found.show(50, truncate=100)


if __name__ == "__main__":
    main()
