"""The ten queries over whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.llm import chat, gru_lm, jaccard, langid, matroska, mixing, packing, quality, suffix_dedup, url_filter
from korpusmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that the contract of op2 states.
URL_RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]

PROBE = "</s>[INST] ok [/INST]"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs)
    marked = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(marked, net, ["doc_id", "held_out"])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_report(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant")))).select("conv_id", F.col("pos").cast("bigint").alias("turn"), F.col("col").alias("role"), F.lit(PROBE).alias("text"))
    return chat.read_back(chat.format_chats(turns.unionByName(probe)))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_report(table(spark, sf_dir, "documents"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.text_media(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_quality_rules, op4_source_mix, op5_suffix_dedup, op6_chat_format, op7_jaccard_join, op8_matroska, op9_best_fit_packing, op10_gru_scores)}

ORACLES: dict[str, str] = {}

ORACLES["op2_url_filter"] = """
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT *, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""

ORACLES["op3_quality_rules"] = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
f AS (SELECT t.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM t JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_ratio,
             n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS word_length FROM f),
m AS (UNPIVOT (SELECT lang, source, symbol_ratio, dup_line_ratio, repeat_ratio, word_length FROM b WHERE NOT base_failed)
      ON symbol_ratio, dup_line_ratio, repeat_ratio, word_length INTO NAME metric VALUE x),
s AS (SELECT lang, source, metric, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.02::DOUBLE))::INT END AS bucket, count(*) AS n FROM m GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total,
             CASE WHEN bucket IS NULL THEN 0.0 ELSE 2.0 * pow(1.02::DOUBLE, bucket) / 2.02 END AS v FROM s),
q AS (SELECT lang, source, metric, min(v) FILTER (upto >= 0.25 * total) AS q1, min(v) FILTER (upto >= 0.75 * total) AS q3 FROM u GROUP BY ALL),
h AS (SELECT lang, source, max(q3 + greatest(3.0 * (q3 - q1), 0.05)) FILTER (metric = 'symbol_ratio') AS a, max(q3 + greatest(3.0 * (q3 - q1), 0.3)) FILTER (metric = 'dup_line_ratio') AS d,
             max(q3 + greatest(3.0 * (q3 - q1), 0.2)) FILTER (metric = 'repeat_ratio') AS p, max(q3 + greatest(3.0 * (q3 - q1), 3.0)) FILTER (metric = 'word_length') AS hi,
             max(q1 - greatest(3.0 * (q3 - q1), 3.0)) FILTER (metric = 'word_length') AS lo FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_ratio <= a AND dup_line_ratio <= d AND repeat_ratio <= p AND word_length <= hi AND word_length >= lo, true) AS kept,
       symbol_ratio, dup_line_ratio, repeat_ratio, word_length
FROM b LEFT JOIN h ON b.lang IS NOT DISTINCT FROM h.lang AND b.source IS NOT DISTINCT FROM h.source
"""

#: Sizes, targets and copies of the rows of a relation named docs (doc_id, text, source).
MIX_SQL = """
z AS (SELECT *, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM docs),
zc AS (SELECT *, greatest(length(bin(size)) - 5, 0) AS d, ('0x' || substr(digest, 1, 2))::INT AS bucket FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d * 32 + (size >> d), bucket, size, digest) AS rank FROM zc),
t0 AS (SELECT s, any_value(source) AS src, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 AS place FROM z GROUP BY s),
t1 AS (SELECT *, CASE place WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM t0),
t2 AS (SELECT *, sum(most) OVER o AS most_upto, sum(weight) OVER () - sum(weight) OVER o AS weight_after FROM t1 WINDOW o AS (ORDER BY most::DOUBLE / weight, src NULLS LAST)),
t3 AS (SELECT *, most_upto * weight + most * weight_after <= total * weight AS is_full FROM t2),
t4 AS (SELECT *, total - coalesce(sum(most) FILTER (is_full) OVER (), 0)::DOUBLE AS remains, (coalesce(sum(weight) FILTER (NOT is_full) OVER (), 0))::DOUBLE AS open_weight FROM t3),
t5 AS (SELECT s, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE least(most::DOUBLE, weight * remains / open_weight) END AS target,
              ('0x' || substr(md5('mix-1' || s), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS off FROM t4),
t6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected FROM t5),
mixed AS (SELECT k.*, source_size, target, least(floor(expected * rank + off) - floor(expected * (rank - 1) + off), 2)::BIGINT AS copies FROM k JOIN t6 USING (s))
"""

ORACLES["op4_source_mix"] = f"""
WITH docs AS (SELECT doc_id, text, source FROM documents), {MIX_SQL}
SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed
"""

ORACLES["op6_chat_format"] = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;') AS er,
             replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;') AS et FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(er) + length(et) + 9)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
