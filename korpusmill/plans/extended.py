"""Queries of the stored index, decision scoring, articles, passage index and metrics, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.functions import text as tx
from korpusmill.operators import articles, classify, corpus, decisions, embed, index, learn, retrieval, search
from korpusmill.plans.indexes import asked, stored_index
from korpusmill.plans.registry import bm25_sql, query, read, tokens_sql
from korpusmill.sources import records
from korpusmill.streaming import ingest


def sql_values(rows: list[tuple], names: str) -> str:
    """A VALUES list of plain Python rows."""
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


def columns_of(schema: str) -> str:
    return ", ".join(c.split()[0] for c in schema.split(", "))


# ---- stored index ----


@query(bm25_sql(["anan*", "er"], every=False))
def index_prefix(spark, sf):
    return asked(spark, sf, [["anan*"], ["er"]], every=False)


@query("SELECT doc_id, score FROM (" + bm25_sql(["the"], limit=None).replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'nothing left' ELSE text END AS text FROM documents) AS changed") + ") AS r ORDER BY score, doc_id LIMIT 20")
def index_update(spark, sf):
    """An update takes a document's old tokens out."""
    old = stored_index(spark, sf)
    changed = read(spark, sf, "documents").where("doc_id % 10 = 0").select("doc_id", F.lit("nothing left").alias("text"))
    new = stored_index(spark, sf, "changed", lambda folder: index.update(changed, old, folder))
    return search.best(index.search(spark, new, [["the"]]))


# ---- decisions ----

DECISION = "doc_id int, text string"
DECISIONS = [
    (1, "Prema čl. 55. Zakona o šumama ministar sklapa ugovor o zamjeni nekretnina radi okrupnjivanja šuma. Usvaja se tužbeni zahtjev."),
    (2, "Članak 55 Zakona o naknadi primjenjuje se na povrat. Odbija se žalba."),
    (3, "U istoj gospodarskoj jedinici; susjedne gospodarske jedinice i srazmjerna vrijednost. Poništava se rješenje."),
    (4, "Nema ničega."), (5, ""), (6, None),
    (7, "Zakon o šumama." + " x" * 300 + " čl. 55. stavak 1. Hrvatske šume."),
]


def rule_sql(rules: decisions.Scoring, near: dict[int, bool]) -> str:
    """near: which decisions have the article close to the statute; SQL has no places of matches."""
    ascii_words = lambda p: p.replace("\\b", "")
    has = lambda p: f"regexp_matches(coalesce(text, ''), '(?i){ascii_words(p)}')"
    close = f"doc_id IN ({', '.join(str(k) for k, v in near.items() if v)})"
    tests = [(rules.names[0], close, rules.bonus), *((n, has(p), w) for n, p, w in rules.signals), (rules.names[1], f"{has(rules.other)} AND NOT {has(rules.statute)}", -rules.bonus)]
    score = " + ".join(f"CASE WHEN {t} THEN {w} ELSE 0 END" for _, t, w in tests)
    names = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t, _ in tests)
    return f"""SELECT doc_id, {score} AS score, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), '; ') AS signals,
CASE WHEN {has(rules.granted)} THEN '{rules.outcomes[0]}' WHEN {has(rules.rejected)} THEN '{rules.outcomes[1]}' ELSE '' END AS outcome FROM {sql_values(DECISIONS, columns_of(DECISION))}"""


@query(rule_sql(decisions.FOREST_EXCHANGE, {1: True}))
def decision_score(spark, sf):
    found = decisions.assess(spark.createDataFrame(DECISIONS, DECISION))
    return found.select("doc_id", "score", F.array_join("signals", "; ").alias("signals"), "outcome")


@query(f"SELECT doc_id, score FROM ({rule_sql(decisions.FOREST_EXCHANGE, {1: True})}) AS r WHERE score >= 6 ORDER BY score DESC, doc_id")
def decision_candidates(spark, sf):
    return decisions.candidates(decisions.assess(spark.createDataFrame(DECISIONS, DECISION))).select("doc_id", "score")


@query("""WITH p AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)der')),
w AS (SELECT (SELECT count(*) FROM p) AS document, (SELECT count(*) FROM p WHERE regexp_matches(text, '(?is)(the(.{0,357})der)|(der(.{0,357})the)')) AS w360)
SELECT 'document' AS scope, document AS documents FROM w UNION ALL SELECT '360', w360 FROM w""")
def cooccurrence_windows(spark, sf):
    return decisions.cooccurrence(read(spark, sf, "documents"), "the", "der", (360,))


# ---- articles ----

ARTICLE = "rid int, oai_id string, set_spec string, title string, authors string, journal string, volume string, issue string, year int, licence string, licence_code string, redistributable boolean, pdf_url string, status string, has_text boolean, text string, url string"
ARTICLES = [
    (1, "oai:x:11", "journal:18", "Prvi", '["A. B.","C. D."]', "Zbornik A", "44.", "2", 2019, "CC BY 4.0", "cc-by", True, "p1", "ok", True, "Prvi tekst.", "u1"),
    (2, "oai:x:12", "journal:18", "Drugi", "E. F.", "Zbornik A", None, None, 2021, "All rights reserved", "sva-prava", False, "p2", None, False, None, "u2"),
    (3, "oai:x:13", "journal:18", "Treći", None, "Zbornik A", "45", None, 2020, "CC BY-NC-ND", "cc-by-nc-nd", True, "p3", None, False, "", None),
    (4, "oai:x:14", "journal:101", "Četvrti", "[]", "Glasnik", "1", "1", 2018, None, "cc-by", True, "", "sken", False, "ostatak", "u4"),
    (5, "oai:x:15", "journal:101", "Peti", None, None, None, None, None, " ", None, False, None, "ok", True, "Peti tekst", "u5"),
    (6, "oai:x:16", "journal:101", "Šesti", '["G"]', "Glasnik", "2", None, 2022, "Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc", True, "p6", "sken", False, "Šesti", "u6"),
]
ARTICLE_SQL = sql_values(ARTICLES, columns_of(ARTICLE))


def article_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARTICLES, ARTICLE)


@query(f"SELECT rid, year FROM {ARTICLE_SQL} WHERE set_spec = 'journal:18' AND trim(coalesce(pdf_url, '')) <> '' AND status IS NULL AND redistributable ORDER BY year DESC, rid")
def text_candidates(spark, sf):
    return articles.waiting_for_text(article_table(spark), "journal:18").select("rid", "year")


@query(f"SELECT rid FROM {ARTICLE_SQL} WHERE set_spec = 'journal:101' AND trim(coalesce(pdf_url, '')) <> '' AND NOT has_text ORDER BY year DESC, rid LIMIT 1")
def text_candidates_again(spark, sf):
    return articles.waiting_for_text(article_table(spark), "journal:101", personal=True, again=True, most=1).select("rid")


@query("SELECT * FROM (VALUES ('no_licence', 1), ('no_text', 2), ('not_free', 1), ('transferred', 2)) AS t(outcome, articles)")
def article_outcomes(spark, sf):
    return articles.outcome_counts(articles.outcome(article_table(spark)))


@query("""SELECT * FROM (VALUES ('hrcak:11', 'u1', 'A. B.; C. D.', 'Vol. 44, br. 2, 2019', 'CC BY 4.0', 'slobodna'), ('hrcak:14', 'u4', '', 'Vol. 1, br. 1, 2018', 'cc-by', 'slobodna')) AS t(id, url, authors, citation, licence, class)""")
def free_to_share(spark, sf):
    found = articles.corpus_records(articles.outcome(article_table(spark)))
    return articles.free_to_share(articles.checked(found)).select("id", "url", "authors", "citation", "licence", "class")


@query(f"SELECT coalesce(status, '(not tried)') AS status, count(*) AS articles FROM {ARTICLE_SQL} GROUP BY ALL ORDER BY articles DESC, status")
def text_status_counts(spark, sf):
    return articles.status_counts(article_table(spark))


@query(f"SELECT set_spec, count(*) AS articles, count(*) FILTER (has_text) AS with_text, coalesce(sum(CASE WHEN status = 'ok' THEN octet_length(encode(text)) END), 0)::BIGINT AS bytes FROM {ARTICLE_SQL} GROUP BY set_spec")
def set_sizes(spark, sf):
    table = article_table(spark)
    return articles.set_sizes(table, articles.bodies(table))


@query(f"SELECT set_spec, min(journal) AS journal, count(*) AS articles, count(*) FILTER (has_text) AS with_text FROM {ARTICLE_SQL} GROUP BY set_spec ORDER BY articles DESC, set_spec LIMIT 15")
def largest_sets(spark, sf):
    return articles.largest_sets(article_table(spark))


JOURNALS = [("journal:101", "Pravni glasnik"), ("journal:18", "Zbornik PRAVNOG fakulteta"), ("journal:7", "Kemija"), ("journal:x", "Upravno pravo")]


@query(f"SELECT set_spec, name, try_cast(regexp_extract(set_spec, '([0-9]+)$', 1) AS INT) AS number FROM {sql_values(JOURNALS, 'set_spec, name')} WHERE regexp_matches(name, '(?i)prav')")
def legal_journals(spark, sf):
    return articles.legal_journals(spark.createDataFrame(JOURNALS, "set_spec string, name string"), "prav")


@query("""WITH d AS (SELECT coalesce(lang, '?') AS c, coalesce(source, '?') AS j FROM documents)
SELECT 'class' AS by, c AS value, count(*) AS articles FROM d GROUP BY c UNION ALL (SELECT 'journal', j, count(*) AS n FROM d GROUP BY j ORDER BY n DESC, j LIMIT 15)""")
def class_counts(spark, sf):
    return articles.class_counts(read(spark, sf, "documents").selectExpr("lang as class", "source as journal"))


# ---- licences ----

#: Own texts in the manner of rights statements, with what they should give.
RIGHTS = [
    ("openAccess | Papers before 2010 are licensed under CC BY-NC. Later papers are licensed under CC BY-NC-ND.", "cc-by-nc-nd", 1, 1), ("info:eu-repo/semantics/openAccess", "nepoznata", 0, 0),
    ("Open access. Readers can not use the papers commercially.", "proza-ogranicena", 0, 0), ("All rights reserved. Some society", "sva-prava", 0, 0),
    ("Papers can be downloaded and redistributed with credit, but they cannot be modified.", "proza-otvorena", 1, 0), ("Texts may be used and reproduced for personal or educational purposes", "osobno", 0, 0),
    ("Samo za osobnu i nekomercijalnu uporabu.", "osobno", 0, 0), ("Creative Commons license BY-NC-ND, with credit", "cc-by-nc-nd", 1, 0), ("a Creative Commons license (BY-NC-ND)", "cc-by-nc-nd", 1, 0),
    ("Everyone is allowed to copy and alter as the CC BY licence says.", "cc-by", 1, 0), ("Only with the permission of the Editor.", "dozvola", 0, 0), ("Uz dozvolu uredništva", "dozvola", 0, 0),
    ("Creative Commons Attribution – NonCommercial 4.0 (https://creativecommons.org/licenses/by-nc/4.0/)", "cc-by-nc", 1, 0), ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd", 1, 0),
    ("Creative Commons Attribution-ShareAlike", "cc-by-sa", 1, 0), ("Users are permitted to read, print, distribute or link.", "proza-otvorena", 1, 0), ("Slobodno se smije umnožavati i dijeliti.", "proza-otvorena", 1, 0), ("Nije dopušteno mijenjati.", "proza-ogranicena", 0, 0),
]


@query(f"SELECT * FROM {sql_values(RIGHTS, 'rights, code, redistributable, ambiguous')}")
def licence_guard(spark, sf):
    return spark.createDataFrame([(r[0],) for r in RIGHTS], "rights string").select("rights", classify.licence_class(F.col("rights")).alias("c")).select("rights", "c.*")


# ---- passages and metrics ----

CHUNKS = [(1, 0, "a"), (1, 1, "b"), (3, 0, "c"), (3, 1, "d"), (3, 2, "e")]


@query("SELECT count(*) AS documents, 2 AS indexed, 5 AS passages, 2.5 AS mean, round(5 * 1536.0 / 1048576, 6)::DOUBLE AS mb, round(200.0 / count(*), 6)::DOUBLE AS coverage FROM documents")
def passage_index_figures(spark, sf):
    return embed.index_figures(read(spark, sf, "documents"), spark.createDataFrame(CHUNKS, "doc_id long, ord int, chunk string"))


@query()
def passage_index(spark, sf):
    """Passages of all documents with their vectors, in two steps: the second takes what the first left."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    first = embed.index_passages(docs, ids=docs.where("doc_id % 2 = 0"))
    return embed.index_passages(docs, old=first)


@query()
def hybrid_search(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    hits = embed.hybrid(embed.index_passages(docs), [{"text": "the order of the court"}, {"text": "der die das", "branch": "bm25", "weight": 0.5}], k=20)
    return embed.as_json(hits)


TRUTHS = "SELECT doc_id, 'q' AS label, quality = 1 AS truth, doc_id % 3 = 0 AS predicted FROM labels UNION ALL SELECT doc_id, 't', toxic = 1, doc_id % 5 = 0 FROM labels"


@query(f"""WITH p AS ({TRUTHS}), s AS (SELECT label, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (predicted) AS said, count(*) FILTER (truth) AS support FROM p GROUP BY label),
b AS (SELECT label, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, support FROM s),
m AS (SELECT '(micro)' AS label, coalesce(sum(tp) / nullif(sum(said), 0), 0) AS precision, coalesce(sum(tp) / nullif(sum(support), 0), 0) AS recall, coalesce(2 * sum(tp) / nullif(sum(said) + sum(support), 0), 0) AS f1, sum(support) AS support FROM s),
d AS (SELECT doc_id, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (predicted) AS said, count(*) FILTER (truth) AS support FROM p GROUP BY doc_id),
x AS (SELECT '(samples)' AS label, avg(coalesce(tp / nullif(said, 0), 0)) AS precision, avg(coalesce(tp / nullif(support, 0), 0)) AS recall, avg(coalesce(2 * tp / nullif(said + support, 0), 0)) AS f1, sum(support) AS support FROM d),
e AS (SELECT * FROM b UNION ALL SELECT * FROM m UNION ALL SELECT '(macro)', avg(precision), avg(recall), avg(f1), sum(support) FROM b
UNION ALL SELECT '(weighted)', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM b UNION ALL SELECT * FROM x)
SELECT label, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support::BIGINT AS support FROM e""")
def label_report(spark, sf):
    t = read(spark, sf, "labels")
    one = lambda name, truth, by: t.select("doc_id", F.lit(name).alias("label"), (F.col(truth) == 1).alias("truth"), (F.col("doc_id") % by == 0).alias("predicted"))
    return retrieval.label_report(one("q", "quality", 3).unionByName(one("t", "toxic", 5)))


GOLD = "CASE WHEN doc_id % 35 = 0 THEN 'strong' WHEN doc_id % 7 = 0 THEN 'weak' END"
LONGEST = "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200"


def longest(spark: SparkSession, sf: str) -> DataFrame:
    top = read(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


@query(f"""WITH r AS ({LONGEST}), g AS (SELECT doc_id, {GOLD} AS class FROM documents WHERE doc_id % 7 = 0)
SELECT class, count(*) AS size, min(rank)::BIGINT AS first, {', '.join(f'count(*) FILTER (rank <= {k}) AS found_{k}' for k in (10, 20, 50, 100, 200))} FROM g LEFT JOIN r USING (doc_id) GROUP BY class""")
def gold_report(spark, sf):
    return retrieval.gold_report(longest(spark, sf), read(spark, sf, "documents").select("doc_id", F.expr(GOLD).alias("class")).where("class is not null"))


@query(f"WITH r AS ({LONGEST}) SELECT count(*) AS documents, count(*) FILTER (doc_id % 7 = 0) AS good, round(count(*) FILTER (doc_id % 7 = 0) / 10, 6)::DOUBLE AS precision FROM r WHERE rank <= 10")
def precision_at_10(spark, sf):
    return retrieval.precision_at(longest(spark, sf), read(spark, sf, "documents").where("doc_id % 7 = 0"))


@query("""WITH p AS (SELECT DISTINCT doc_id, label FROM (SELECT doc_id, 'q' || quality AS label FROM labels UNION ALL SELECT doc_id, 't' || toxic FROM labels) AS l JOIN documents USING (doc_id) WHERE length(text) > 500 AND label IS NOT NULL),
k AS (SELECT label FROM p GROUP BY label HAVING count(*) >= 10) SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM p JOIN k USING (label) GROUP BY doc_id""")
def training_set(spark, sf):
    t = read(spark, sf, "labels")
    pairs = t.select("doc_id", F.concat(F.lit("q"), "quality").alias("label")).unionByName(t.select("doc_id", F.concat(F.lit("t"), "toxic").alias("label")))
    return classify.training_set(read(spark, sf, "documents"), pairs, least=10).select("doc_id", F.array_join("labels", ",").alias("labels"))


HITS = """SELECT doc_id, 'long' AS branch, 'a' AS label, 1.0 AS weight, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents
UNION ALL SELECT doc_id, 'late', 'b', 0.5, row_number() OVER (ORDER BY doc_id DESC) FROM documents WHERE doc_id IS NOT NULL"""


def branch_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 longest and the 100 last documents."""
    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    top = lambda rows, order, label, branch, weight: rows.orderBy(*order).limit(100).select("doc_id", F.lit(branch).alias("branch"), F.lit(label).alias("label"), F.lit(weight).alias("weight"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"))
    return top(docs, [F.desc("n_chars"), F.col("doc_id")], "a", "long", 1.0).unionByName(top(docs.where("doc_id is not null"), [F.desc("doc_id")], "b", "late", 0.5))


@query(f"""WITH h AS (SELECT * FROM ({HITS}) AS x WHERE rank <= 100), w AS (SELECT unnest(['', 'long', 'late']) AS without),
s AS (SELECT without, doc_id, round(sum(weight / (60 + rank)), 9) AS score FROM h, w WHERE branch <> without GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY without ORDER BY score DESC, doc_id) AS place FROM s)
SELECT without, count(*) FILTER (doc_id % 7 = 0) AS found FROM p WHERE place <= 50 GROUP BY without""")
def branch_ablations(spark, sf):
    return retrieval.ablations(branch_hits(spark, sf), read(spark, sf, "documents").where("doc_id % 7 = 0"), ["long", "late"], 50)


@query(f"SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS groups, min(rank)::BIGINT AS best FROM ({HITS}) AS x WHERE rank <= 100 GROUP BY doc_id")
def united_groups(spark, sf):
    return retrieval.united(branch_hits(spark, sf)).withColumn("groups", F.array_join("groups", ","))


@query(f"""WITH w AS (SELECT doc_id, ' ' || unnest({tokens_sql('text')}) || ' ' AS w FROM documents), z AS (SELECT doc_id, w, unnest(range(3, least(5, length(w)) + 1)) AS n FROM w),
g AS (SELECT doc_id, substring(w, i::INT, n::INT) AS term FROM (SELECT doc_id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM z) AS y),
f AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term HAVING count(*) >= 3 ORDER BY sum(tf) DESC, term LIMIT 200000),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM f JOIN d USING (term))
SELECT doc_id, count(*) AS terms, round(max(x) / sqrt(sum(x * x)), 6) AS largest FROM x GROUP BY doc_id""")
def tfidf_char(spark, sf):
    return learn.char_tfidf(read(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("value"), 6).alias("largest"))


MARKS = "SELECT event_type, min(ts) AS latest, 5 AS records FROM events WHERE event_type IS NOT NULL GROUP BY event_type"


@query(f"""WITH o AS ({MARKS}), n AS (SELECT event_type, max(ts) AS latest, count(*) AS records FROM events WHERE event_type IS NOT NULL GROUP BY event_type)
SELECT 'whole' AS scan, event_type, greatest(o.latest, n.latest) AS latest, o.records + n.records AS records FROM o JOIN n USING (event_type)
UNION ALL SELECT 'cut off', event_type, o.latest, o.records + n.records FROM o JOIN n USING (event_type)""")
def remembered_marks(spark, sf):
    events = read(spark, sf, "events").where("event_type is not null")
    old, new = events.groupBy("event_type").agg(F.min("ts").alias("latest"), F.lit(5).cast("bigint").alias("records")), ingest.watermark(events, "event_type", "ts")
    one = lambda name, complete: ingest.remembered(old, new, "event_type", complete).select(F.lit(name).alias("scan"), "event_type", "latest", "records")
    return one("whole", True).unionByName(one("cut off", False))


# ---- tables, addresses, small functions ----


@query("""WITH n AS (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM documents WHERE doc_id = 1 AND source IS NOT NULL)),
o AS (SELECT 7 AS id, source AS name FROM documents WHERE doc_id = 1 AND source IS NOT NULL)
SELECT id::INT AS id, name FROM o UNION ALL SELECT (row_number() OVER (ORDER BY name) + coalesce((SELECT max(id) FROM o), 0))::INT, name FROM n""")
def code_table(spark, sf):
    docs = read(spark, sf, "documents")
    old = docs.where("doc_id = 1 and source is not null").select(F.lit(7).alias("id"), F.col("source").alias("name"))
    return corpus.add_names(old, docs.select(F.col("source").alias("name")))


@query("SELECT n_nationkey AS id, n_name AS text, r_name AS region, NULL::VARCHAR AS meta, 'a' || n_nationkey AS abstract FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def public_view(spark, sf):
    n = read(spark, sf, "nation")
    bodies = n.selectExpr("n_nationkey as id", "'text' as kind", "n_name as body").unionByName(n.selectExpr("n_nationkey as id", "'abstract' as kind", "concat('a', n_nationkey) as body"))
    return corpus.public_view(n.selectExpr("n_nationkey as id", "n_regionkey as region_id"), bodies, {"region": read(spark, sf, "region").selectExpr("r_regionkey as id", "r_name as name")})


@query("SELECT url, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY url UNION ALL SELECT url, page_id FROM pages WHERE url IS NULL")
def distinct_addresses(spark, sf):
    return records.first_of_each(read(spark, sf, "pages").select("url", "page_id"), "url", "page_id")


LINES = [("P R E S U D A", True, "P R E S U D A"), ("Presuda", False, "Presuda"), ("a\n\n\n\nb", False, "a\n\nb"), ("R J E Š E N J E", True, "R J E Š E N J E")]


@query("SELECT * FROM " + sql_values([(a.replace("\n", "|"), b, c.replace("\n", "|")) for a, b, c in LINES], "raw, operative, squeezed"))
def operative_lines(spark, sf):
    rows = spark.createDataFrame([(a,) for a, _, _ in LINES], "line string")
    return rows.select(F.replace("line", F.lit("\n"), F.lit("|")).alias("raw"), tx.is_operative(F.col("line")).alias("operative"), F.replace(tx.few_newlines(F.col("line")), F.lit("\n"), F.lit("|")).alias("squeezed"))


@query("SELECT * FROM (VALUES ('[\"a\",\"b\"]', 'a|b'), ('plain', 'plain'), ('', ''), ('[]', '')) AS t(raw, items)")
def json_lists(spark, sf):
    return spark.createDataFrame([('["a","b"]',), ("plain",), ("",), ("[]",)], "raw string").select("raw", F.array_join(tx.decoded_list(F.col("raw")), "|").alias("items"))
