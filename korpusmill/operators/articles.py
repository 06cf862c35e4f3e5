"""The table of journal articles: what may be fetched, shared and passed on to the corpus, and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.text import citation
from korpusmill.operators.classify import redistribution

# Status of a text that was read well, class of texts that may be shared, and the source and kind of corpus records of articles.
OK = "ok"
FREE = "slobodna"
SOURCE, KIND = "hrcak", "doktrina"


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def waiting_for_text(articles: DataFrame, set_spec: str, personal: bool = False, again: bool = False, most: int | None = None) -> DataFrame:
    """Articles of a set whose text is still to be fetched: with an address, not tried yet (or, again, without text), and free to share unless the
    use is personal; newest first. The backlog is the whole set's, whichever run recorded an article."""
    untried = ~F.col("has_text") if again else F.col("status").isNull()
    found = articles.where((F.col("set_spec") == set_spec) & ~blank("pdf_url") & untried & (F.lit(personal) | F.col("redistributable"))).orderBy(F.desc("year"), "rid")
    return found if most is None or most < 0 else found.limit(most)


def bodies(articles: DataFrame) -> DataFrame:
    """rid, text, n_bytes of the articles whose text was read well; others' texts aren't kept."""
    return articles.where(F.col("status") == OK).select("rid", "text", F.octet_length("text").alias("n_bytes"))


def save(old: DataFrame, new: DataFrame, key: str = "oai_id") -> DataFrame:
    """Articles after an upsert: a record that came again replaces all columns."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def outcome(articles: DataFrame, only_free: bool = True) -> DataFrame:
    """The articles with licence (its text, else its code), class and outcome: transferred, no_text, no_licence or not_free; the first that applies counts."""
    licence = F.coalesce(F.nullif(F.trim("licence"), F.lit("")), F.nullif(F.trim("licence_code"), F.lit("")))
    df = articles.withColumn("licence", licence).withColumn("class", redistribution(F.col("licence")))
    what = F.when(blank("text"), "no_text").when(F.col("licence").isNull(), "no_licence")
    if only_free:
        what = what.when(F.coalesce(F.col("class") != FREE, F.lit(True)), "not_free")
    return df.withColumn("outcome", what.otherwise("transferred"))


def outcome_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("outcome").agg(F.count("*").alias("articles"))


def corpus_records(marked: DataFrame) -> DataFrame:
    """Corpus records of the transferred articles. Authors that aren't a JSON list stay as they are."""
    authors = F.coalesce(F.array_join(F.from_json("authors", "array<string>"), "; "), "authors", F.lit(""))
    number = F.coalesce(F.regexp_extract("oai_id", "([0-9]+)$", 1), F.lit(""))
    bare = lambda c: F.nullif(F.trim(F.regexp_replace(F.trim(c), "[.]+$", "")), F.lit(""))
    return marked.where("outcome = 'transferred'").select(
        F.concat(F.lit(f"{SOURCE}:"), F.when(number != "", number).otherwise(F.col("oai_id"))).alias("id"), F.lit(SOURCE).alias("source"), F.lit(KIND).alias("kind"),
        F.coalesce("url", "oai_id").alias("url"), "title", authors.alias("authors"), "journal", citation(bare("volume"), bare("issue"), F.col("year").cast("string")).alias("citation"), "licence", "class", "year", "text",
    )


def checked(records: DataFrame) -> DataFrame:
    """The records; one without a licence or an address stops the job."""
    fault = F.when(blank("licence"), "a record without a licence").when(blank("url"), "a record without an address")
    return records.withColumn("licence", F.when(fault.isNull(), F.col("licence")).otherwise(F.raise_error(fault)))


def free_to_share(records: DataFrame) -> DataFrame:
    return records.where(F.col("class") == FREE).orderBy("journal", "year", "id")


def legal_journals(journals: DataFrame, pattern: str) -> DataFrame:
    """Journals (set_spec, name) whose name has the pattern, in order of the number in their set."""
    return journals.where(F.col("name").rlike(f"(?iu){pattern}")).withColumn("number", F.regexp_extract("set_spec", "([0-9]+)$", 1).try_cast("int")).orderBy("number", "set_spec")


def set_sizes(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """set_spec, articles, with_text, bytes of each set."""
    return articles.join(texts.select("rid", "n_bytes"), "rid", "left").groupBy("set_spec").agg(F.count("*").alias("articles"), F.count_if("has_text").alias("with_text"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"))


def status_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.coalesce("status", F.lit("(not tried)")).alias("status")).agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "status")


def class_counts(records: DataFrame, most: int = 15) -> DataFrame:
    """by, value, articles: how many of each class, and of the journals that have most."""
    count = lambda c, by: records.groupBy(F.coalesce(c, F.lit("?")).alias("value")).agg(F.count("*").alias("articles")).select(F.lit(by).alias("by"), "value", "articles")
    return count("class", "class").unionByName(count("journal", "journal").orderBy(F.desc("articles"), "value").limit(most))


def largest_sets(articles: DataFrame, most: int = 15) -> DataFrame:
    return articles.groupBy("set_spec").agg(F.min("journal").alias("journal"), F.count("*").alias("articles"), F.count_if("has_text").alias("with_text")).orderBy(F.desc("articles"), "set_spec").limit(most)
