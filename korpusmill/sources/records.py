"""Harvested XML and portal pages to records, as column expressions (native: XPath and regular expressions).

An XML response is one string. Names are matched with their prefix, as the protocol's responses write them. A null or empty response gives no
records; a record that isn't well-formed XML fails the query.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions import text as tx
from korpusmill.operators.classify import licence_class


def nodes(xml: Column, name: str, condition: str = "", prefix: str = "dc:") -> Column:
    """Texts of all elements of a name, trimmed, without blank ones."""
    path = f"//*[name()='{prefix}{name}']{condition}/text()"
    return F.filter(F.transform(F.xpath(xml, F.lit(path)), F.trim), lambda x: x != "")


def first(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def in_language(xml: Column, name: str, lang: str = "hrv") -> tuple[Column, Column]:
    """The text in the language, or else the first; and the first that differs from it."""
    every = nodes(xml, name)
    main = F.coalesce(F.get(nodes(xml, name, f"[starts-with(@*[name()='xml:lang'],'{lang}')]"), F.lit(0)), first(every))
    return main, first(F.filter(every, lambda x: x != main))


def responses_to_records(responses: DataFrame, column: str = "xml") -> DataFrame:
    """record: one row per <record> of the responses."""
    return responses.select(F.explode(F.regexp_extract_all(column, F.lit("(?s)(<record\\b.*?</record>)"), 1)).alias("record"))


def resumption(xml: Column) -> Column:
    """struct(token, error): where the next page begins (null at the end), and the error's code (null if none)."""
    blank = lambda path: F.nullif(F.trim(F.xpath_string(xml, F.lit(path))), F.lit(""))
    return F.struct(blank("//*[name()='resumptionToken']").alias("token"), blank("//*[name()='error']/@code").alias("error"))


def sets(responses: DataFrame, column: str = "xml") -> DataFrame:
    """spec, name of each set of ListSets responses, once each."""
    one = responses.select(F.explode(F.regexp_extract_all(column, F.lit("(?s)(<set\\b.*?</set>)"), 1)).alias("x"))
    text = lambda n: F.trim(F.xpath_string("x", F.lit(f"//*[name()='{n}']")))
    return one.groupBy(text("setSpec").alias("spec")).agg(F.max(text("setName")).alias("name"))


def dublin_core(records: DataFrame) -> DataFrame:
    """Articles from Dublin Core records (record); deleted ones and those without an id or metadata go."""
    r = F.col("record")
    title, title_alt = in_language(r, "title")
    abstract, abstract_alt = in_language(r, "description")
    subjects = F.concat(nodes(r, "subject", "[starts-with(@*[name()='xml:lang'],'hrv')]"), nodes(r, "subject"))
    unique = F.filter(subjects, lambda x, i: ~F.exists(F.slice(subjects, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    source, ids, rights = nodes(r, "source"), nodes(r, "identifier"), nodes(r, "rights")
    starts = lambda p: F.filter(source, lambda s: s.rlike(f"(?i)^{p}"))
    dois = F.filter(F.transform(F.concat(ids, nodes(r, "relation")), tx.doi), lambda d: d.isNotNull())
    kinds = F.filter(nodes(r, "type"), lambda t: t.startswith("info:eu-repo/semantics/") & ~F.contains(t, F.lit("Version")))
    url, date = first(F.filter(ids, lambda i: i.startswith("http"))), first(nodes(r, "date"))
    rights_text = F.array_join(rights, "\n")
    out = records.select(
        F.trim(F.xpath_string(r, F.lit("//*[name()='identifier']"))).alias("oai_id"),
        F.trim(F.xpath_string(r, F.lit("//*[name()='datestamp']"))).alias("datestamp"),
        F.lower(F.xpath_string(r, F.lit("//*[name()='header']/@status"))).alias("_status"),
        F.xpath_boolean(r, F.lit("//*[name()='oai_dc:dc']")).alias("_has"),
        title.alias("title"), title_alt.alias("title_alt"), nodes(r, "creator").alias("authors"), abstract.alias("abstract"), abstract_alt.alias("abstract_alt"),
        F.array_join(unique, "; ").alias("keywords"), first(F.filter(source, lambda s: ~s.rlike("(?i)^(ISSN|CODEN|Volume|Issue)"))).alias("journal"),
        F.array_join(starts("ISSN"), "; ").alias("issn"), F.regexp_replace(first(starts("Volume\\b")), "(?i)^Volume\\s*", "").alias("volume"), F.regexp_replace(first(starts("Issue\\b")), "(?i)^Issue\\s*", "").alias("issue"),
        F.array_join(nodes(r, "language"), "; ").alias("language"), F.substring_index(first(kinds), "/", -1).alias("kind"), first(nodes(r, "publisher")).alias("publisher"),
        date.alias("date"), tx.any_year(date).alias("year"), first(dois).alias("doi"), url.alias("url"), rights_text.alias("rights"), licence_class(rights_text).alias("licence"),
    )
    return out.where((F.col("oai_id") != "") & (F.col("_status") != "deleted") & F.col("_has")).drop("_status", "_has")


def full_text_links(records: DataFrame) -> DataFrame:
    """oai_id, pdf_url, kind from resource records: the first file that is marked as the full text."""
    r = F.col("record")
    mark = "translate(@objectType,'FULTEX','fultex')='fulltext'"
    return records.select(F.trim(F.xpath_string(r, F.lit("//*[name()='identifier']"))).alias("oai_id"), first(nodes(r, "file", f"[{mark}]", "oaire:")).alias("pdf_url"), first(nodes(r, "resourceType", prefix="oaire:")).alias("kind"))


def with_links(articles: DataFrame, links: DataFrame) -> DataFrame:
    """articles with pdf_url, and a kind that the second pass may have replaced; articles of one pass only stay."""
    new = links.select("oai_id", "pdf_url", F.col("kind").alias("_kind"))
    return articles.join(new, "oai_id", "left").withColumn("kind", F.coalesce(F.nullif("_kind", F.lit("")), "kind")).drop("_kind")


# ---- portal pages ----


def result_count(text: Column) -> Column:
    """The number of results that a result page states; -1 if it states none."""
    n = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), "(\\d[\\d.\\s]*)\\s*rezultat", 1), "[.\\s]", "")
    return F.coalesce(F.nullif(n, F.lit("")).cast("long"), F.lit(-1))


def labelled(text: Column, labels: list[str], banner: str | None = None) -> Column:
    """Map from label to what stands between its colon and the next known label (1200 characters at most); blank ones go. What follows the
    banner, a sentence that every page ends with, isn't looked at."""
    flat = tx.squeeze(F.coalesce(text, F.lit("")))
    if banner:
        flat = F.substring_index(flat, banner, 1)
    stop = "|".join(re.escape(x) + "\\s*:" for x in labels)
    value = lambda x: F.regexp_extract(flat, f"{re.escape(x)}\\s*:\\s*(.{{0,1200}}?)(?={stop}|$)", 1)
    found = F.array(*[F.struct(F.lit(x).alias("k"), F.regexp_replace(value(x), "^[ .;]+|[ .;]+$", "").alias("v")) for x in labels])
    return F.map_from_entries(F.filter(found, lambda e: e["v"] != ""))


def split_title(title: Column) -> Column:
    """struct(mark, date, middle, kind) of a title whose parts stand between dashes."""
    p = F.split(F.coalesce(title, F.lit("")), " - ")
    n = F.size(p)
    second = F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit("")))
    dated = second.rlike("^\\d{1,2}\\.\\s*\\d{1,2}\\.\\s*\\d{4}\\.?$")
    start = F.when(dated, 3).otherwise(2)
    middle = F.when(n > start, F.array_join(F.slice(p, start, F.greatest(n - start, F.lit(0))), " - ")).otherwise("")
    return F.struct(F.trim(p[0]).alias("mark"), F.when(dated, tx.iso_date(second)).otherwise("").alias("date"), middle.alias("middle"), F.when(n >= start, F.trim(F.element_at(p, -1))).otherwise("").alias("kind"))


def notes_id(value: Column) -> Column:
    """The 32 hexadecimal digits of a document id, from the id itself, a query parameter or a path; null if there is none."""
    return F.upper(F.nullif(F.regexp_extract(value, "(?i)(?<![0-9a-f])([0-9a-f]{32})(?![0-9a-f])", 1), F.lit("")))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place, href, label of each link of a page (page_id, html)."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("(?is)(<a\\b[^>]*\\bhref\\s*=\\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), 1)
    one = pages.select("page_id", F.posexplode(tags).alias("place", "a"))
    return one.select("page_id", "place", F.regexp_extract("a", "(?is)\\bhref\\s*=\\s*[\"']([^\"']*)", 1).alias("href"), F.replace(tx.html_text(F.col("a")), F.lit("\n"), F.lit(" ")).alias("label"))


def read_ids(text: str) -> list[str]:
    """Ids in order, once each, from lines (# begins a comment) or JSON: strings, objects with id or doc_id, or an object that holds such a list."""
    try:
        found = json.loads(text)
    except ValueError:
        found = [x for line in text.splitlines() for x in re.split(r"[\s,;]+", line.split("#")[0])]
    if isinstance(found, dict):
        found = next((found[k] for k in ("id", "odluke") if isinstance(found.get(k), list)), [found])
    one = lambda x: x.get("id", x.get("doc_id")) if isinstance(x, dict) else x
    names = [str(one(x)).strip() for x in (found if isinstance(found, list) else [found]) if one(x) is not None]
    return [x for x in dict.fromkeys(names) if x]


def refused(urls: DataFrame, rules: DataFrame, permission: str = "") -> DataFrame:
    """The rows of urls (url) that may not be fetched: their host is among the rules (host, path: the paths that it does allow) and their path isn't, and there is no
    token of a permission. A host without rules is free."""
    if permission.strip():
        return urls.limit(0)
    host, path = tx.host_and_path(F.col("url"))
    asked = urls.withColumn("_host", host).withColumn("_path", path)
    allowed = rules.select(F.lower("host").alias("_host"), F.col("path").alias("_path"))
    return asked.join(allowed.select("_host").distinct(), "_host", "left_semi").join(allowed, ["_host", "_path"], "left_anti").drop("_host", "_path")


def gate(urls: DataFrame, rules: DataFrame, permission: str = "") -> DataFrame:
    """urls, if all of them may be fetched; otherwise PermissionError names the first."""
    first = refused(urls, rules, permission).agg(F.min("url").alias("u")).first()["u"]
    if first is not None:
        raise PermissionError(f"{first}: its host forbids the path and no permission was given")
    return urls


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by order; rows without a key all stay."""
    rest = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(key, "r.*").select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))
