"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from korpusmill.operators import retrieval

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 20


def test_vector_search_in_blocks(spark, monkeypatch):
    """Every 50th row asks, and blocks, nulls, sizes and ties give the rows of brute force."""
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    found = entry.queries()["vector_topk"](spark, SF)
    assert found.select("qid").distinct().count() == asked
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(90)] + [(90, None), (91, [1.0]), (92, [1.0, None, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = retrieval.vector_topk(v, v.where("vec_id % 2 = 0").selectExpr("vec_id qid", "embedding query"), 5).collect()
    want = set()
    for qid, q in rows[::2]:
        sims = [(None if not (q and x and len(q) == len(x) and None not in q + x) else float(sum(a * b for a, b in zip(q, x))), i) for i, x in rows]
        sims.sort(key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))
        want |= {(qid, i, s, r + 1) for r, (s, i) in enumerate(sims[:5])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
