"""All queries of the engine's own operators by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.functions import text as tx
from korpusmill.operators import article, bundle, chunking, classify, corpus, learn, match, retrieval, search
from korpusmill.plans.indexes import asked, found
from korpusmill.sources import records, sinks
from korpusmill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- full-text search ----

def tokens_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({column}, '')), '{tx.MARKED}', '{tx.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"



def bm25_sql(phrases: list[str], every: bool = True, where: str = "", limit: int | None = 20, scope: str = "text", indexed: str = "text") -> str:
    """SQL twin of search.ranked for phrases written with spaces; a last word may end in a star."""
    tf = []
    for p in phrases:
        ws = p.split(" ")
        test = " AND ".join(f"starts_with(s[i + {k}], '{w[:-1]}')" if w.endswith("*") else f"s[i + {k}] = '{w}'" for k, w in enumerate(ws))
        tf.append(f"len(list_filter(range(1, len(s) - {len(ws) - 2}), lambda i: {test}))")
    one = lambda i: f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * d / a))"
    glue = " AND " if every else " OR "
    tail = f"ORDER BY score, doc_id LIMIT {limit}" if limit else ""
    return f"""WITH t AS (SELECT *, {tokens_sql(indexed)} AS t, {tokens_sql(scope)} AS s FROM documents),
f AS (SELECT * EXCLUDE (t, s), len(t) AS d, {', '.join(f'{x} AS tf{i}' for i, x in enumerate(tf))} FROM t),
g AS (SELECT count(*) AS n, avg(d) AS a, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(tf)))} FROM f)
SELECT doc_id, round(-({' + '.join(one(i) for i in range(len(tf)))}), 6) AS score FROM f, g
WHERE ({glue.join(f'tf{i} > 0' for i in range(len(tf)))}) {where} {tail}"""


@query(bm25_sql(["the", "tion"], every=False))
def fts_bm25_topk(spark, sf):
    return asked(spark, sf, [["the"], ["tion"]], every=False)


@query(bm25_sql(["the", "of", "er"]))
def fts_and(spark, sf):
    return asked(spark, sf, [["the"], ["of"], ["er"]])


@query(bm25_sql(["der", "que"], every=False))
def fts_or(spark, sf):
    return asked(spark, sf, [["der"], ["que"]], every=False)


@query(bm25_sql(["anan*"]))
def fts_prefix(spark, sf):
    return asked(spark, sf, [["anan*"]])


@query(bm25_sql(["of the"]))
def fts_phrase(spark, sf):
    return asked(spark, sf, [["of", "the"]])


@query(bm25_sql(["src7"], scope="source", indexed="concat_ws(chr(10), source, text)"))
def fts_column_filter(spark, sf):
    return search.best(search.ranked(read(spark, sf, "documents"), [["src7"]], columns=["source", "text"], scope="source"))


@query(bm25_sql(["in"], where="AND lang = 'de'"))
def fts_kind_filter(spark, sf):
    return search.best(search.ranked(read(spark, sf, "documents"), [["in"]], where=F.col("lang") == "de"))


@query(f"""WITH t AS (SELECT {tokens_sql('text')} AS t FROM documents)
SELECT form, count(*) FILTER (len(list_filter(t, lambda x: CASE WHEN ends_with(form, '*') THEN starts_with(x, form[:-2]) ELSE x = form END)) > 0) AS df
FROM t, (VALUES ('the'), ('the*'), ('ouean'), ('que*')) AS f(form) GROUP BY form""")
def fts_df_by_form(spark, sf):
    return search.document_frequency(read(spark, sf, "documents"), ["the", "the*", "ouean", "que*"])


@query()
def fts_snippet(spark, sf):
    return read(spark, sf, "documents").where(F.exists(tx.tokens(F.col("text")), lambda x: x == "worthless")).select("doc_id", search.snippet(F.col("text"), ["worthless"]).alias("snippet"))


@query("SELECT doc_id, 0.0::DOUBLE AS score, substr(text, 1, 300) AS excerpt FROM documents WHERE contains(lower(text), 'of the.') ORDER BY doc_id LIMIT 50")
def like_fallback(spark, sf):
    return search.contains(read(spark, sf, "documents"), '"of the."')


@query(f"""WITH t AS (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents)
SELECT token, count(*)::BIGINT AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY token""")
def fts_postings(spark, sf):
    return search.postings(read(spark, sf, "documents")).groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


# ---- vectors and fusion ----

SIM = "round(list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 5)"


@query(f"""WITH s AS (SELECT q.vec_id AS qid, v.vec_id, {SIM} AS sim FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def vector_topk(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.vector_topk(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 10)


def ranked_sql(name: str, sql: str, label: str, weight: float) -> str:
    return f"{name} AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS rank, '{label}' AS label, 'bm25' AS branch, {weight}::DOUBLE AS weight FROM ({sql}))"


FUSED = f"""WITH {ranked_sql('a', bm25_sql(['the'], limit=40), 'first', 1.0)}, {ranked_sql('b', bm25_sql(['of the'], limit=40), 'second', 3.0)},
h AS (FROM a UNION ALL FROM b)
SELECT doc_id, round(sum(weight / (60 + rank)), 9) AS score, string_agg(label || '/' || branch || '/' || rank, ' ' ORDER BY round(weight / (60 + rank), 9) DESC, label) AS provenance FROM h GROUP BY doc_id"""


@query(FUSED)
def rrf_bundle_weighted(spark, sf):
    a = retrieval.ranks(found(spark, sf, [["the"]]), "first", "bm25")
    b = retrieval.ranks(found(spark, sf, [["of", "the"]]), "second", "bm25", 3.0)
    return retrieval.fuse(a.unionByName(b))


@query(f"""WITH {ranked_sql('w', bm25_sql(['the'], limit=40), 'words', 1.0)}, s AS (SELECT v.vec_id AS doc_id, {SIM} AS sim FROM embeddings v, embeddings q WHERE q.vec_id = 0),
n AS (SELECT doc_id, row_number() OVER (ORDER BY sim DESC, doc_id) AS rank, 'near' AS label, 'vector' AS branch, 1.0::DOUBLE AS weight FROM s QUALIFY rank <= 40), h AS (FROM w UNION ALL FROM n)
SELECT doc_id, round(sum(weight / (60 + rank)), 9) AS score, string_agg(label || '/' || branch || '/' || rank, ' ' ORDER BY round(weight / (60 + rank), 9) DESC, label) AS provenance FROM h GROUP BY doc_id""")
def rrf_hybrid(spark, sf):
    v = read(spark, sf, "embeddings")
    words = retrieval.ranks(found(spark, sf, [["the"]]), "words", "bm25")
    near = retrieval.vector_topk(v, v.where("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 40)
    return retrieval.fuse(words.unionByName(near.select(F.col("vec_id").alias("doc_id"), "rank", F.lit("near").alias("label"), F.lit("vector").alias("branch"), F.lit(1.0).alias("weight"))))


@query("""WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1), r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT k, count(*) FILTER (rank <= k) AS found, count(*) AS total FROM g LEFT JOIN r USING (doc_id), (VALUES (10::BIGINT), (50), (200)) AS t(k) GROUP BY k""")
def recall_at_k(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", (-F.col("n_chars")).alias("score"))
    hits = retrieval.ranks(docs, "length", "sort", depth=200)
    return retrieval.recall_at(read(spark, sf, "labels").where("toxic = 1").select("doc_id"), hits, [10, 50, 200])


@query("""WITH s AS (SELECT d.doc_id, length(source)::DOUBLE AS score, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS g FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)),
b AS (SELECT score, count(*) AS n, sum(g) AS g FROM s GROUP BY score), c AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS before FROM b)
SELECT k, round(sum(g * least(greatest(k - before, 0), n) / n), 6) AS expected FROM c, (VALUES (10::BIGINT), (100)) AS t(k) GROUP BY k""")
def expected_recall_ties(spark, sf):
    scored = read(spark, sf, "documents").select("doc_id", F.length("source").cast("double").alias("score"))
    return retrieval.expected_recall(read(spark, sf, "labels").where("toxic = 1").select("doc_id"), scored, [10, 100])


# ---- corpus store ----


@query("SELECT count(*) AS documents, count(DISTINCT source) AS sources, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / count(*), 3) AS mean_bytes FROM documents")
def corpus_stats_total(spark, sf):
    size = F.sum(F.octet_length("text"))
    return read(spark, sf, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), size.cast("bigint").alias("bytes"), F.round(F.try_divide(size, F.count("*")), 3).alias("mean_bytes"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def corpus_stats_by_source(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def corpus_stats_top_sources(spark, sf):
    return corpus_stats_by_source(spark, sf).orderBy(F.desc("n"), "source").limit(15)


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def corpus_stats_date_range(spark, sf):
    return read(spark, sf, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))


@query("SELECT coalesce(n_name, '?') AS nation, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def corpus_stats_by_code(spark, sf):
    nation = F.broadcast(read(spark, sf, "nation"))
    return read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_name", F.lit("?")).alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS court, o_orderstatus AS register, coalesce(year(o_orderdate), -1)::INT AS year, count(*) AS n FROM orders GROUP BY ALL")
def strata_refresh(spark, sf):
    return corpus.strata(read(spark, sf, "orders"), [F.col("o_orderpriority").alias("court"), F.col("o_orderstatus").alias("register"), F.coalesce(F.year("o_orderdate"), F.lit(-1)).alias("year")])


KEY = "(concat('0x', substr(sha256(concat({}::VARCHAR, 'uzorak')), 1, 16))::UBIGINT >> 1)::BIGINT"


@query(f"SELECT doc_id, {KEY.format('doc_id')} AS sample_key FROM documents")
def sampling_key(spark, sf):
    return read(spark, sf, "documents").select("doc_id", corpus.sampling_key(F.col("doc_id")).alias("sample_key"))


@query(f"""WITH k AS (SELECT o_orderpriority, o_orderkey, {KEY.format('o_orderkey')} AS sample_key FROM orders)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sample_key, o_orderkey) AS place FROM k) WHERE place <= 20""")
def stratum_sample_all(spark, sf):
    return corpus.stratum_sample(read(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 20)


@query("""WITH o AS (SELECT doc_id, source, text, lang FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, 'new' AS source, text || '!' AS text, CASE WHEN doc_id % 4 = 0 THEN 'hr' END AS lang FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN n.source ELSE o.source END AS source, CASE WHEN n.doc_id IS NULL THEN o.text ELSE n.text END AS text, coalesce(n.lang, o.lang) AS lang, o.doc_id IS NULL AS is_new
FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def upsert_policy(spark, sf):
    d = read(spark, sf, "documents")
    old = d.where("doc_id % 3 <> 0").select("doc_id", "source", "text", "lang")
    new = d.where("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("source"), F.concat("text", F.lit("!")).alias("text"), F.when(F.col("doc_id") % 4 == 0, "hr").alias("lang"))
    return corpus.upsert(old, new, "doc_id", fixed=["source"], replaced=["text"], filled=["lang"])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY ALL")
def search_log_latest(spark, sf):
    return corpus.latest(read(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1")
def change_detection(spark, sf):
    return read(spark, sf, "documents").groupBy(corpus.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unindexed(spark, sf):
    return corpus.not_in(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels").select("doc_id"), "doc_id")


@query("SELECT v.doc_id, min(place) AS place, any_value(d.source) AS source FROM (VALUES (0, 42), (1, 7), (2, 42), (3, 99999999), (4, 1)) AS v(place, doc_id) JOIN documents d ON d.doc_id = v.doc_id GROUP BY v.doc_id")
def ordered_id_lookup(spark, sf):
    asked = spark.sql("SELECT CAST(place AS INT) place, CAST(doc_id AS BIGINT) doc_id FROM VALUES (0, 42), (1, 7), (2, 42), (3, 99999999), (4, 1) AS v(place, doc_id)")
    return corpus.in_order(read(spark, sf, "documents").select("doc_id", "source"), asked, "doc_id")


@query("SELECT event_type, max(ts) AS latest, count(*) AS records FROM events GROUP BY event_type")
def harvest_watermark(spark, sf):
    return ingest.watermark(read(spark, sf, "events"), "event_type", "ts")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    return ingest.windowed_counts(read(spark, sf, "events")).withColumn("total", F.round("total", 4))


# ---- chunks and lines ----


@query()
def chunk_decision(spark, sf):
    return chunking.chunk(read(spark, sf, "documents"))


@query("""WITH l AS (SELECT doc_id, regexp_replace(lower(trim(line)), '[0-9]', '#', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id, line, count(*) AS times FROM l WHERE length(line) BETWEEN 8 AND 120 GROUP BY ALL HAVING count(*) >= 3""")
def running_header_lines(spark, sf):
    return chunking.running_lines(read(spark, sf, "documents"))


@query("""WITH l AS (SELECT doc_id, list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: length(x)), lambda n: n > 20)) AS n FROM documents)
SELECT doc_id, n[len(n) // 2 + 1]::INT AS median FROM l WHERE len(n) > 0""")
def upper_median_line(spark, sf):
    return read(spark, sf, "documents").select("doc_id", chunking.upper_median_line(F.col("text")).alias("median")).where("median is not null")


# ---- scalar functions and rules ----


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'prazno' WHEN 4 * len(regexp_extract_all(text, '/g\\d+')) > 0.30 * length(text) THEN 'bez-unicode'
WHEN length(text) / greatest(ceil(n_chars / 1800), 1) < 80 THEN 'sken' ELSE 'ok' END AS status FROM documents""")
def text_quality_status(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.text_status(F.col("text"), F.ceil(F.col("n_chars") / 1800)).alias("status"))


DATES = {"22.2.2019.": "2019-02-22", "22. 2. 2019.": "2019-02-22", "dana 5. ožujka 2020. godine": "2020-03-05", "1. STUDENOG 2011": "2011-11-01", "nema datuma": "", "17.siječnja2018": "2018-01-17"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in DATES.items()) + ") AS t(raw, iso)")
def iso_dates(spark, sf):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in DATES])).alias("raw"))
    return rows.select("raw", tx.iso_date(F.col("raw")).alias("iso"))


@query("SELECT * FROM (VALUES ('Odluka o šumi, čl. 55!', 'odluka_o_sumi_cl_55'), ('đak', 'ak'), ('---', 'dokument'), ('  Žuti  Ćup ', 'zuti_cup')) AS t(raw, slug)")
def slugify(spark, sf):
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("Odluka o šumi, čl. 55!", "đak", "---", "  Žuti  Ćup ")])).alias("raw"))
    return rows.select("raw", tx.slug(F.col("raw")).alias("slug"))


LICENCE_LINE = "(?im)^.*(licen[cs]e|rights reserved|CC BY|CC0).*$"


@query("""WITH l AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '(?im)^.*(license|licence|rights reserved|CC BY|CC0).*$'), ' ') AS line FROM documents),
n AS (SELECT doc_id, line, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS t FROM l WHERE line <> '')
SELECT doc_id, line, CASE WHEN regexp_matches(t, 'sva prava pridrzana|all rights reserved') THEN 'zabranjena' WHEN regexp_matches(t, 'cc0|public domain|javno dobro|\\bpdm\\b') THEN 'slobodna'
WHEN NOT regexp_matches(t, '\\bby\\b|attribution|creative commons|\\bcc\\b') THEN NULL WHEN regexp_matches(t, '\\b(nc|nd)\\b|non ?commercial|no ?deriv') THEN 'uvjetna'
WHEN regexp_matches(t, '\\bby\\b|attribution|\\bsa\\b|sharealike') THEN 'slobodna' END AS class FROM n""")
def redistribution_class(spark, sf):
    line = F.array_join(F.regexp_extract_all("text", F.lit(LICENCE_LINE.replace("licen[cs]e", "license|licence")), 0), " ")
    return read(spark, sf, "documents").select("doc_id", line.alias("line")).where("line <> ''").select("doc_id", "line", classify.redistribution(F.col("line")).alias("class"))


@query()
def licence_class(spark, sf):
    line = F.array_join(F.regexp_extract_all("text", F.lit(LICENCE_LINE), 0), " ")
    return read(spark, sf, "documents").select("doc_id", line.alias("line")).where("line <> ''").select("doc_id", "line", classify.licence_class(F.col("line")).alias("c")).select("doc_id", "line", "c.*")


SIGNALS = [("the", "\\bthe\\b", 4), ("of the", "\\bof the\\b", 3), ("der", "\\bder\\b", 5)]


@query("""SELECT doc_id, (CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\bof the\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\bder\\b') THEN 5 ELSE 0 END)::INT AS score FROM documents""")
def signal_score(spark, sf):
    return read(spark, sf, "documents").select("doc_id", classify.signal_score(F.col("text"), SIGNALS)[0].alias("score"))


@query()
def proximity(spark, sf):
    return read(spark, sf, "documents").select("doc_id", classify.near(F.col("text"), "\\bthe\\b", "\\bwas\\b", 100).alias("close"))


@query()
def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


# ---- learning ----


@query("SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS label FROM labels) GROUP BY label")
def label_frequency(spark, sf):
    return learn.label_rows(read(spark, sf, "labels"), ["quality", "toxic"]).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
top AS (SELECT label FROM t GROUP BY label ORDER BY count(*) DESC, label LIMIT (SELECT greatest(1, round((SELECT count(*) FROM t) / count(*)))::INT FROM labels)),
p AS (SELECT doc_id, label FROM labels, top),
j AS (SELECT coalesce(t.label, p.label) AS label, CASE WHEN t.label IS NOT NULL AND p.label IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN t.label IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN p.label IS NULL THEN 1 ELSE 0 END AS fn FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.label = p.label),
b AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM j GROUP BY label),
r AS (SELECT 'micro' AS average, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM b UNION ALL SELECT 'macro', tp, fp, fn FROM b)
SELECT average, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS recall, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS f1 FROM r GROUP BY average""")
def trivial_baseline(spark, sf):
    labels = read(spark, sf, "labels")
    truth = learn.label_rows(labels, ["quality", "toxic"])
    top = learn.trivial_labels(truth, labels.count())
    return retrieval.f1_report(labels.select("doc_id", F.explode(F.array(*[F.lit(x) for x in top])).alias("label")), truth)


@query(f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents),
g AS (SELECT doc_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM t),
f AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term HAVING count(*) >= 3),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM f JOIN d USING (term))
SELECT doc_id, count(*) AS terms, round(max(x) / sqrt(sum(x * x)), 6) AS largest FROM x GROUP BY doc_id""")
def tfidf_word(spark, sf):
    return learn.tfidf(read(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("value"), 6).alias("largest"))


@query()
def ovr_logreg_metrics(spark, sf):
    labels = read(spark, sf, "labels")
    truth = learn.label_rows(labels, ["quality", "toxic"])
    docs = read(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    found = learn.one_vs_rest(docs, truth, ["quality", "toxic"])
    held = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).select("doc_id")
    return retrieval.f1_report(found.where("held_out").select("doc_id", "label"), truth.join(held, "doc_id", "left_semi"))


# ---- query strings, articles, samples, sinks ----


@query(bm25_sql(["of the", "der*"], every=False))
def fts_query_string(spark, sf):
    return search.best(match.ask(read(spark, sf, "documents"), '"of the" OR der*'))


@query()
def fts_query_fallback(spark, sf):
    return match.search_text(read(spark, sf, "documents"), "of the.")


@query()
def chunk_article(spark, sf):
    return article.chunk_articles(read(spark, sf, "documents"))


@query()
def topic_quota_sample(spark, sf):
    docs = read(spark, sf, "documents").where(F.length("text").between(500, 120_000))
    return corpus.quota_sample(spark, [(match.ask(docs, q), n) for q, n in (('"of the"', 6), ("the OR der", 6), ("que", 4))], 14)


SAMPLED = "(o_orderkey % 7 = 0)"


@query(f"""WITH s AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER {SAMPLED.replace('(', '(WHERE ')} AS sampled FROM orders GROUP BY 1), t AS (SELECT sum(n) AS a, sum(sampled) AS b FROM s)
SELECT o_orderpriority, n, sampled, round(n / a, 9) AS share, round(sampled / b, 9) AS sample_share, round(greatest(n / a - sampled / b, 0), 9) AS deficit FROM s, t""")
def representativeness(spark, sf):
    orders = read(spark, sf, "orders")
    return corpus.representativeness(orders, orders.where(SAMPLED), ["o_orderpriority"])


@query(f"""WITH s AS (SELECT count(*) AS n, count(*) FILTER {SAMPLED.replace('(', '(WHERE ')} AS m FROM orders GROUP BY o_orderpriority)
SELECT round(sum(abs(round(n / (SELECT sum(n) FROM s), 9) - round(m / (SELECT sum(m) FROM s), 9))) / 2, 6) AS tvd FROM s""")
def total_variation(spark, sf):
    return corpus.total_variation(representativeness(spark, sf))


@query(f"""WITH k AS (SELECT c_custkey, c_nationkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) > 1 THEN c_nationkey END AS s, {KEY.format('c_custkey')} AS k FROM customer)
SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY s ORDER BY k, c_custkey) <= ceil(count(*) OVER (PARTITION BY s) * 0.25) AS is_test FROM k""")
def stratified_split(spark, sf):
    return corpus.stratified_split(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey")


@query("""SELECT l_orderkey AS doc_id, round(max(l_quantity::DOUBLE) + 0.3 * ln(1 + count(*) FILTER (l_quantity > 20)), 6) AS score, count(*) FILTER (l_quantity > 20) AS passages
FROM lineitem GROUP BY 1""")
def doc_aggregation(spark, sf):
    return retrieval.by_document(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").cast("double").alias("score")), 20.0)


@query("SELECT asked AS doc_id FROM (VALUES (42::BIGINT), (99999999), (-5)) AS v(asked) WHERE asked NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def missing_ids(spark, sf):
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("bigint") for x in (42, 99999999, -5)])).alias("doc_id"))
    return corpus.not_in(asked, read(spark, sf, "documents").select("doc_id"), "doc_id")


@query()
def bundle_explained(spark, sf):
    docs = read(spark, sf, "documents")
    asked = bundle.questions([{"text": "the", "branch": bundle.WORDS, "label": "first"}, {"text": '"of the"', "branch": bundle.WORDS, "weight": 3.0, "label": "second"}])
    hits = [retrieval.ranks(match.ask(docs, q.text), q.label, b, q.weight) for q in asked for b in q.branches]
    return bundle.explain(retrieval.fuse(functools.reduce(lambda a, b: a.unionByName(b), hits)))


@query()
def html_links(spark, sf):
    return records.page_links(read(spark, sf, "pages"))


@query("SELECT doc_id, '# ' || source || chr(10) || chr(10) || coalesce('- **lang:** ' || nullif(lang, '') || chr(10), '') || '- **Izvor:** ' || doc_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || trim(coalesce(text, '')) || chr(10) AS md FROM documents WHERE source IS NOT NULL")
def markdown_export(spark, sf):
    docs = read(spark, sf, "documents").where("source is not null")
    return docs.select("doc_id", sinks.markdown(F.col("source"), F.col("text"), F.col("doc_id").cast("string"), {"lang": F.col("lang")}).alias("md"))


# ---- prefixes, statistics and literals ----


@query(f"""WITH t AS (SELECT {tokens_sql('text')} AS t FROM documents), f AS (SELECT 'anania'[:n] AS prefix, n AS size FROM range(3, 7) AS r(n)),
d AS (SELECT prefix, size::INT AS size, count(*) FILTER (len(list_filter(t, lambda x: starts_with(x, prefix))) > 0) AS df FROM t, f GROUP BY ALL),
g AS (SELECT *, CASE WHEN lag(df) OVER (ORDER BY size DESC) > 0 THEN round(df / lag(df) OVER (ORDER BY size DESC), 6) END AS growth FROM d)
SELECT *, coalesce(max(growth) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING), 0) <= 3 AS take FROM g""")
def prefix_growth(spark, sf):
    return search.prefix_growth(read(spark, sf, "documents"), "anania")


@query(f"""SELECT o_orderkey, {KEY.format('o_orderkey')} AS sample_key FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1995 ORDER BY sample_key, o_orderkey LIMIT 25""")
def stratum_sample(spark, sf):
    one = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and year(o_orderdate) = 1995")
    return one.select("o_orderkey", corpus.sampling_key(F.col("o_orderkey")).alias("sample_key")).orderBy("sample_key", "o_orderkey").limit(25)


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def dedupe_latest(spark, sf):
    return corpus.latest(read(spark, sf, "events"), ["user_id"], [F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT doc_id, length(text)::INT AS size FROM documents WHERE length(text) BETWEEN 500 AND 120000")
def length_filter(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.length("text").alias("size")).where(F.col("size").between(500, 120_000))


@query("""SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(*) FILTER (lang IS NOT NULL) AS labelled, round(100 * count(*) FILTER (lang IS NOT NULL) / greatest(count(*), 1), 3) AS percent,
min(n_chars) AS shortest, max(n_chars) AS longest FROM documents""")
def corpus_stats_conditional(spark, sf):
    labelled = F.count_if(F.col("lang").isNotNull())
    return read(spark, sf, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), labelled.alias("labelled"), F.round(100 * labelled / F.greatest(F.count("*"), F.lit(1)), 3).alias("percent"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("SELECT coalesce(lang, '?') AS lang, source, max(n_chars) AS longest, count(*) AS n FROM documents GROUP BY ALL")
def corpus_stats_two_keys(spark, sf):
    return read(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), "source").agg(F.max("n_chars").alias("longest"), F.count("*").alias("n"))


@query("""SELECT * FROM (VALUES ('v. https://doi.org/10.1234/ab.c-9. i dalje', '10.1234/ab.c-9', 2004, 'Vol. 3, br. 2, 2004', '2004_05_12_345', 'Rev'), ('bez', NULL, 2004, 'Vol. 3, br. 2, 2004', NULL, 'Rev'))
AS t(raw, doi, year, citation, gazette, register)""")
def literals(spark, sf):
    rows = spark.range(1).select(F.explode(F.array(F.struct(F.lit("v. https://doi.org/10.1234/ab.c-9. i dalje").alias("raw"), F.lit("/sluzbeni/2004_05_12_345.html").alias("url")), F.struct(F.lit("bez").alias("raw"), F.lit("/x").alias("url")))).alias("r")).select("r.*")
    cited = tx.citation(F.lit("3"), F.lit("2"), F.lit("2004"))
    return rows.select("raw", tx.doi(F.col("raw")).alias("doi"), tx.any_year(F.lit("objavljeno 2004.")).alias("year"), cited.alias("citation"), tx.gazette_id(F.col("url")).alias("gazette"), tx.register_of(F.lit("Rev-533/2015-2")).alias("register"))


@query("SELECT phrase, count(*) FILTER (contains(lower(text), phrase)) AS documents, count(*) FILTER (contains(lower(text), phrase)) = 0 AS suspicious FROM documents, (VALUES ('the'), ('of the'), ('zzqxj')) AS p(phrase) GROUP BY phrase")
def control_phrases(spark, sf):
    phrases = ["the", "of the", "zzqxj"]
    one = read(spark, sf, "documents").agg(*[F.count_if(F.contains(F.lower("text"), F.lit(p))).alias(p) for p in phrases])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"`{p}`").alias("documents")) for p in phrases])).alias("x"))
    return rows.select("x.*", (F.col("x.documents") == 0).alias("suspicious"))


@query("""WITH v AS (SELECT vec_id, embedding FROM embeddings), s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 5) AS sim FROM v, v AS q WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk_batch(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.vector_topk(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 5)


from korpusmill.plans import extended  # noqa: E402,F401  registers its queries
