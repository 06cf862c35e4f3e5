import pytest
from pyspark.sql import functions as F

from korpusmill.__main__ import main
from korpusmill.operators import article, bundle, match, search
from korpusmill.sources import records, sinks, store

RECORD = """<OAI-PMH><ListRecords><record><header><identifier>oai:x:7</identifier><datestamp>2020-01-02</datestamp></header><metadata>
<oai_dc:dc xmlns:oai_dc="a" xmlns:dc="b"><dc:title xml:lang="eng">Forests</dc:title><dc:title xml:lang="hrv">Šume</dc:title><dc:creator>A. B.</dc:creator><dc:subject xml:lang="eng">law</dc:subject>
<dc:subject xml:lang="hrv">Pravo</dc:subject><dc:subject>LAW</dc:subject><dc:identifier>https://x.org/7</dc:identifier><dc:relation>doi 10.1234/ab.7.</dc:relation><dc:source>Journal X</dc:source><dc:source>Volume 3</dc:source>
<dc:date>2019-05-01</dc:date></oai_dc:dc></metadata></record><record><header status="deleted"><identifier>oai:x:8</identifier></header></record>
<resumptionToken> t2 </resumptionToken></ListRecords></OAI-PMH>"""


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_dublin_core(spark):
    responses = spark.createDataFrame([(RECORD,), (None,), ("",)], "xml string")
    (r,) = records.dublin_core(records.responses_to_records(responses)).collect()
    assert (r["oai_id"], r["title"], r["title_alt"], r["keywords"], r["journal"], r["volume"], r["year"], r["doi"], r["url"]) == ("oai:x:7", "Šume", "Forests", "Pravo; law", "Journal X", "3", 2019, "10.1234/ab.7", "https://x.org/7")
    assert tuple(one(spark, records.resumption(F.col("t")), t=RECORD)) == ("t2", None)


def test_portal_fields(spark):
    assert one(spark, records.result_count(F.col("t")), t="Pronađeno 1.234 rezultata") == 1234
    assert one(spark, records.result_count(F.col("t")), t=None) == -1
    assert one(spark, records.labelled(F.col("t"), ["Sud", "Vrsta odluke"]), t="Sud: Općinski u Puli; Vrsta odluke: Presuda.") == {"Sud": "Općinski u Puli", "Vrsta odluke": "Presuda"}
    assert tuple(one(spark, records.split_title(F.col("t")), t="U-I-1/2000 - 5.3.2001. - zakon - Odluka")) == ("U-I-1/2000", "2001-03-05", "zakon", "Odluka")
    assert records.read_ids("a, b # c\nb;d") == ["a", "b", "d"] == records.read_ids('[{"id": "a"}, "b", {"doc_id": "d"}]')


def test_query_language():
    q = match.parse('(šuma OR naslov:"a b"*) AND x NOT y')
    assert q.phrases == [["suma"], ["a", "b*"], ["x"], ["y"]] and q.scopes == [None, "naslov", None, None]
    for wrong in ("čl. 55", "a AND", '"', "(a", "a)", "b:"):
        with pytest.raises(match.QueryError):
            match.parse(wrong)


def test_boolean_tree(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "b c"), (4, None)], "doc_id long, text string")
    ids = lambda q: sorted(r["doc_id"] for r in match.ask(docs, q).collect())
    assert ids("a OR b") == [1, 2, 3] and ids("a NOT c") == [1] and ids("(a OR b) c") == [2, 3] and ids('"b c"') == [3]


def test_articles(spark):
    body = "\n".join(f"ovo je redak broj {i} koji je dovoljno dug da ostane u odlomku" for i in "abcdefgh")
    text = "\n".join(["ZAGLAVLJE ČASOPISA 1", "1. Uvod", body, "ZAGLAVLJE ČASOPISA 2", "12", "rastav-\nljeno je sve ovo što slijedi iza prethodnog odlomka.", "ZAGLAVLJE ČASOPISA 3", "Literatura", "Knjiga koja se ovdje ne smije pojaviti nikada više"])
    out = one(spark, article.article_passages(F.col("t")), t=text)
    assert len(out) == 1 and out[0].startswith("1. Uvod\n") and "rastavljeno" in out[0] and "ZAGLAVLJE" not in out[0] and "Knjiga" not in out[0]
    assert one(spark, article.article_passages(F.col("t")), t=None) == [] == one(spark, article.article_passages(F.col("t")), t="")
    assert all(len(c) <= 1600 for c in one(spark, article.article_passages(F.col("t")), t="x" * 5000))
    heads = {"1.2. Naslov": True, "Ovo je rečenica.": False, "UVOD I SVRHA": True, "Sažetak": True, "obični redak": False}
    assert {h: one(spark, article.is_heading(F.col("t")), t=h) for h in heads} == heads


def test_questions():
    asked = bundle.questions(["a", {"text": "a"}, bundle.Question.hypothetical("b " * 40)])
    assert len(asked) == 2 and asked[1].label.startswith("hyde: b b") and asked[1].branches == ["vektor"]
    for wrong in ({"text": " "}, {"text": "a", "branch": "x"}, {"text": "a", "branch": "bm25", "prefix": "passage"}):
        with pytest.raises(ValueError):
            bundle.questions(wrong)


def test_explanation(spark):
    (r,) = bundle.explain(spark.createDataFrame([(1, "a b/bm25/2 c/d/vektor/10 a b/vektor/3",)], "doc_id long, provenance string"), most=2).collect()
    assert (r["labels"], r["branches"], r["explanation"]) == (["a b", "c/d"], ["bm25", "vektor"], "a b/bm25/2; c/d/vektor/10")


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "id long, text string")
    root = str(tmp_path / "s")
    first = store.publish(old, root, "id", "text")
    assert store.publish(old, root, "id", "text") != first
    assert sorted(map(str, store.current(spark, root).collect())) == sorted(map(str, old.collect()))
    with pytest.raises(store.VersionError):
        store.publish(old, root, "id", "text", change=lambda df: df.where("id = 1"))
    with pytest.raises(store.VersionError):
        store.publish(old, root, "id", "text", change=lambda df: df.selectExpr("id", "concat(text, '!') as text"))
    assert store.current(spark, root).count() == 3


def test_prefixes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["šume", "suma", "sumski", "sum", "sunce"])], "doc_id long, text string")
    got = [(r["prefix"], r["df"], r["take"]) for r in search.prefix_growth(docs, "sumski", least=2, step=1.5).orderBy("size").collect()]
    assert got == [("su", 5, False), ("sum", 4, False), ("sums", 1, True), ("sumsk", 1, True), ("sumski", 1, True)]


def test_sinks(spark, tmp_path):
    md = sinks.markdown(F.lit("T"), F.lit(" b "), F.lit("u"), {"k": F.lit("v"), "none": F.lit(None)})
    assert spark.range(1).select(md.alias("x")).first()["x"] == "# T\n\n- **k:** v\n- **Izvor:** u\n\n---\n\nb\n"
    assert spark.range(1).select(sinks.html(F.lit("# A & B\n\n- **k:** http://x.y\ntext")).alias("x")).first()["x"] == '<h1>A &amp; B</h1>\n<li><b>k:</b> <a href="http://x.y">http://x.y</a></li>\n<p>text</p>'
    sinks.write_documents(spark.range(2).selectExpr("concat('Naslov ', id) as n", "'text' as t"), str(tmp_path / "o"), "n", "t")
    assert {p.name for p in (tmp_path / "o").glob("name=*")} == {"name=naslov_0", "name=naslov_1"}
    assert sinks.report("R", spark.range(1)).splitlines()[2] == "| id |"


def test_command_line(spark, tmp_path):
    out = str(tmp_path / "r")
    main(["--tables", "/root/testdata/sf0.001", "--output", out, "search", '"of the"', "--limit", "5"])
    assert spark.read.parquet(out).count() == 5
    with pytest.raises(SystemExit):
        main(["--tables", "x", "run", "no_such_query"])
