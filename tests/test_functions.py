from pyspark.sql import functions as F

from korpusmill.functions import text as tx
from korpusmill.operators import chunking, classify, corpus, search
from korpusmill.streaming.ingest import ingest_new


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, tx.fold(F.col("t")), t="ŠUMA Žito đak") == "suma zito đak"
    assert one(spark, tx.doi(F.col("t")), t="v. 10.1234/ab.c. itd") == "10.1234/ab.c"
    assert one(spark, tx.shorten(F.col("t")), t="a " * 60) == ("a " * 26 + "a") + "..."
    assert one(spark, tx.citation(F.col("v"), F.col("i"), F.col("y")), v="3", i=None, y="2020") == "Vol. 3, 2020"
    assert one(spark, tx.capital_labels(F.col("t")), t="ŠUMARSTVO; pravo VLASNIŠTVO  NAD") == ["ŠUMARSTVO", "VLASNIŠTVO NAD"]
    assert one(spark, tx.html_text(F.col("t")), t="<p>a &amp; b</p><script>x</script><nav>n</nav>c") == "a & b\nc"


def test_passages(spark):
    out = one(spark, chunking.passages(F.col("t")), t="\n".join(f"{i}. " + "x" * 500 for i in range(1, 9)))
    assert all(60 < len(c) <= 1600 for c in out) and sum(c.count("x") for c in out) >= 4000
    assert one(spark, chunking.passages(F.col("t")), t="y" * 60) == []
    assert len(one(spark, chunking.passages(F.col("t")), t="y" * 61)) == 1
    assert one(spark, chunking.passages(F.col("t")), t=None) == []


def test_licences(spark):
    code = lambda t: tuple(one(spark, classify.licence_class(F.col("t")), t=t))
    assert code("") == ("nepoznata", 0, 0)
    assert code("All rights reserved. CC BY") == ("sva-prava", 0, 0)
    assert code("Creative Commons license (BY-NC-ND)") == ("cc-by-nc-nd", 1, 0)
    assert code("CC BY 4.0 or CC BY-NC") == ("cc-by-nc", 1, 1)
    assert code("may be used for personal or educational purposes") == ("osobno", 0, 0)
    assert code("can be downloaded and redistributed but they cannot be modified") == ("proza-otvorena", 1, 0)
    assert code("may not be altered") == ("proza-ogranicena", 0, 0)
    assert one(spark, classify.redistribution(F.col("t")), t="CC BY-NC-ND 4.0") == "uvjetna"


def test_sample_grows_by_prefix(spark):
    df = spark.range(200).select(F.lit("s").alias("s"), "id")
    ids = lambda n: {r["id"] for r in corpus.stratum_sample(df, ["s"], "id", n).collect()}
    assert ids(5) < ids(20)


def test_snippet_marks_the_hit(spark):
    assert "»šuma«" in one(spark, search.snippet(F.col("t"), ["suma"]), t="velika šuma raste")
    far = "hit " + "a " * 60 + "hit b hit c hit " + "d " * 60
    assert one(spark, search.snippet(F.col("t"), ["hit"], width=8), t=far).count("»") == 3
    assert one(spark, search.snippet(F.col("t"), ["hit"], width=2), t="none of it") == "none of"


def test_ingest_takes_each_id_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(10).write.parquet(f"{src}/a")
    schema = spark.range(1).schema
    ingest_new(spark, f"{src}/*", schema, out, mark, "id")
    spark.range(5, 15).write.parquet(f"{src}/b")
    ingest_new(spark, f"{src}/*", schema, out, mark, "id")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(15))
