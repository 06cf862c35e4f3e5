"""The stored index, decision contexts, articles and the passage index where SQL can't follow."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from korpusmill.operators import articles, classify, decisions, embed, index, learn, retrieval, search
from korpusmill.plans import extended
from korpusmill.sources import records

DOCS = [(1, "the old oak stands near the old mill", "Oak"), (2, "an oak and a mill", "Mill"), (3, "šume i oaks", None), (4, None, "the old"), (5, "", "")]


def test_index_scores_as_the_plain_search(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    index.build(docs, str(tmp_path / "i"), ("text", "title"))
    for phrases, every in (([["old"]], True), ([["the", "old"]], True), ([["oak*"], ["mill"]], False), ([["o*"]], True), ([["sume"]], True), ([["none"]], False)):
        got = sorted(map(tuple, index.search(spark, str(tmp_path / "i"), phrases, every).collect()))
        assert got == sorted(map(tuple, search.ranked(docs, phrases, every, columns=["text", "title"]).collect()))
    assert [r["doc_id"] for r in index.search(spark, str(tmp_path / "i"), [["old"]], scope="title").collect()] == [4]
    index.update(spark.createDataFrame([(1, "new words", "x")], "doc_id long, text string, title string"), str(tmp_path / "i"), str(tmp_path / "j"), ("text", "title"))
    assert [r["doc_id"] for r in index.search(spark, str(tmp_path / "j"), [["old"]]).collect()] == [4]
    assert [r["doc_id"] for r in index.search(spark, str(tmp_path / "j"), [["new", "words"]]).collect()] == [1]


def test_places_and_contexts_of_matches(spark):
    at = lambda t, p: spark.range(1).select(decisions.starts(F.lit(t), p).alias("x")).first()["x"]
    assert at("aXbbXX", "x") == [1, 4, 5] and at("none", "x") == [] and at("XX", "x") == [0, 1] and at("Čl. 55 i čl. 55", "čl\\. 55") == [0, 9]
    found = {r["doc_id"]: r for r in decisions.assess(spark.createDataFrame([*extended.DECISIONS, (8, "čl. 55. Zakona o šumama. " * 20)], extended.DECISION)).collect()}
    assert len(found[8]["contexts"]) == 3 and found[8]["score"] == 6
    assert found[7]["contexts"] == [] and found[1]["contexts"][0].startswith("Prema čl. 55.") and found[6]["signals"] == []
    (r,) = decisions.naive_precision(spark.createDataFrame(extended.DECISIONS, extended.DECISION), decisions.FOREST_EXCHANGE.article, decisions.FOREST_EXCHANGE.statute).collect()
    assert (r["naive"], r["near"], r["precision"]) == (3, 1, 0.333333)


def test_a_record_without_licence_or_address_stops_the_job(spark):
    ok = [("CC BY", "u"), (" ", "u")]
    with pytest.raises(Exception, match="without a licence"):
        articles.checked(spark.createDataFrame(ok, "licence string, url string")).collect()
    with pytest.raises(Exception, match="without an address"):
        articles.checked(spark.createDataFrame([("CC BY", None)], "licence string, url string")).collect()


def test_articles_are_replaced_whole(spark):
    old, new = (spark.createDataFrame(rows, "oai_id string, title string") for rows in ([("a", "A"), ("b", "B")], [("b", None), ("c", "C")]))
    assert sorted(map(str, articles.save(old, new).collect())) == sorted(map(str, spark.createDataFrame([("a", "A"), ("b", None), ("c", "C")], "oai_id string, title string").collect()))


def test_passages_are_indexed_once_and_anew(spark):
    body = lambda w: "\n".join(f"{i}. " + f"{w} " * 60 for i in (1, 2, 3))
    docs = spark.createDataFrame([(1, body("alpha")), (2, body("beta")), (3, " "), (4, body("gamma"))], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (2,), (9,)], "doc_id long")
    first = embed.index_passages(docs, ids=ids).cache()
    assert {r["doc_id"] for r in first.collect()} == {2}
    whole = embed.index_passages(docs, first).cache()
    assert {r["doc_id"] for r in whole.collect()} == {1, 2, 4} and whole.where("doc_id = 2").count() == first.count()
    assert embed.index_passages(docs, ids=ids.where("doc_id = 7")).count() == 0
    changed = docs.where("doc_id = 2").withColumn("text", F.lit("delta " * 40))
    anew = embed.index_passages(changed, whole, again=True)
    assert anew.where("doc_id = 2").count() == 1 and anew.where("doc_id <> 2").count() == whole.where("doc_id <> 2").count()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in whole.collect())
    with pytest.raises(ValueError):
        embed.encoded(docs, "text", "neither")
    hits = embed.hybrid(whole, [{"text": "gamma gamma", "label": "g"}], k=2)
    rows = hits.collect()
    assert rows[0]["doc_id"].startswith("4/") and "g/vektor/1" in rows[0]["provenance"]
    assert embed.with_documents(hits, docs.where("doc_id <> 4")).where("doc_id = 4").count() == 0
    listed = [json.loads(r["json"]) for r in embed.as_json(hits).orderBy("rank").collect()]
    assert [x["rank"] for x in listed] == [1, 2] and listed[0]["score"] == round(rows[0]["score"], 6)


def test_gate(spark):
    urls = spark.createDataFrame([("http://Free.org/x",), ("https://closed.org/robots.txt",)], "url string")
    rules = spark.createDataFrame([("closed.org", "/robots.txt")], "host string, path string")
    assert records.gate(urls, rules).count() == 2
    closed = urls.unionByName(spark.createDataFrame([("https://closed.org/d/1",)], "url string"))
    with pytest.raises(PermissionError, match="closed.org/d/1"):
        records.gate(closed, rules)
    assert records.gate(closed, rules, "class/1").count() == 3


def test_rerank(spark):
    hits = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.5, 1.0), ("c", 1.0, None)], "doc_id string, score double, lead double")
    assert [r["doc_id"] for r in retrieval.reranked(hits, {"lead": 0.6}).collect()] == ["b", "a", "c"]


def test_training_set_of_rare_labels_is_empty(spark):
    docs = spark.createDataFrame([(1, "x" * 501), (2, "x" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, None)], "doc_id long, label string")
    assert classify.training_set(docs, labels, least=2).count() == 0
    assert [r["labels"] for r in classify.training_set(docs, labels, least=1).collect()] == [["a"]]


def test_strings_of_words_are_not_shuffled(spark):
    """The values are those of a plain loop, for repeated and null ids too, and no exchange has rows of strings."""
    rows = [(1, "abc abcd"), (2, "abc xyz"), (1, "ABC"), (None, "abcd xyz"), (None, "xyz"), (3, None), (4, "a"), (5, "xyz šume")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tf = {}
    for d, t in rows:
        for w in (t or "").lower().replace("š", "s").split():
            for n in (3, 4, 5):
                for i in range(len(w) + 3 - n):
                    tf.setdefault(d, Counter())[f" {w} "[i : i + n]] += 1
    df, every = Counter(t for x in tf.values() for t in x), sum(tf.values(), Counter())
    terms = sorted((t for t in df if df[t] >= 2), key=lambda t: (-every[t], t))[:7]
    want = {}
    for d, x in tf.items():
        raw = {t: (1 + math.log(x[t])) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t in terms if t in x}
        want |= {(d, t): round(v / math.sqrt(sum(y * y for y in raw.values())), 9) for t, v in raw.items()}
    found = learn.char_tfidf(docs, 2, 7)
    got = [((r["doc_id"], r["term"]), round(r["value"], 9)) for r in found.collect()]
    assert dict(got) == want and len(got) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange" in x]
    assert exchanges and not any("term" in x for x in exchanges)
