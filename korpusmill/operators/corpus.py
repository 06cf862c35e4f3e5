"""The corpus store: upsert policy, change detection, statistics, strata and reproducible sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALT = "uzorak"


def fingerprint(text: Column, abstract: Column | None = None) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.sha2(body if abstract is None else F.concat(body, F.coalesce(F.concat(F.lit("\n"), abstract), F.lit(""))), 256)


def sampling_key(key: Column, salt: str = SALT) -> Column:
    """A reproducible 63-bit number from the id."""
    return F.shiftrightunsigned(F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(salt)), 256), 1, 16), 16, -10).cast("bigint"), 1)


def upsert(old: DataFrame, new: DataFrame, key: str, fixed: list[str], replaced: list[str], filled: list[str]) -> DataFrame:
    """The next version of a table: fixed columns never change, replaced ones take the new value even if null, filled ones only if it isn't null."""
    n, o = new.withColumn("_n", F.lit(True)).alias("n"), old.withColumn("_o", F.lit(True)).alias("o")
    met = o.join(n, key, "full_outer")
    is_new, is_old = F.col("_o").isNull(), F.col("_n").isNull()
    pick = [F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fixed]
    pick += [F.when(is_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in replaced]
    pick += [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in filled]
    return met.select(key, *pick, is_new.alias("is_new"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, in the given descending order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def strata(docs: DataFrame, keys: list[Column]) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count("*").alias("n"))


def stratum_sample(docs: DataFrame, strata_keys: list[str], id_col: str, n: int, after: int = -1) -> DataFrame:
    """The first n rows of each stratum by sampling key, above ``after``; a larger n keeps the smaller sample."""
    keyed = docs.withColumn("sample_key", sampling_key(F.col(id_col))).where(F.col("sample_key") > after)
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy(*strata_keys).orderBy("sample_key", id_col)).cast("bigint")).where(F.col("place") <= n)


def not_in(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known, key, "left_anti")


def in_order(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of the asked ids (place, key), in the order in which they were first asked."""
    first = asked.groupBy(key).agg(F.min("place").alias("place"))
    return first.join(rows, key).orderBy("place")


def quota_sample(spark: SparkSession, topics: list[tuple[DataFrame, int]], total: int) -> DataFrame:
    """place, doc_id, topic: of each topic's ranked documents (doc_id, score), the best that no earlier topic took, up to its quota and the
    total. Four times the quota are looked at, so the candidates on the driver are bounded by the quotas, not by the corpus."""
    taken: dict[object, int] = {}
    for number, (scored, quota) in enumerate(topics):
        left = quota
        for row in scored.orderBy("score", "doc_id").limit(4 * quota).collect():
            if left and len(taken) < total and row["doc_id"] not in taken:
                taken[row["doc_id"]] = number
                left -= 1
    return spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(taken.items())], "place int, doc_id long, topic int")


def representativeness(population: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """Each stratum's size, share, share of the sample, and deficit (share that the sample lacks)."""
    size = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = size(population, "n").join(size(sample, "sampled"), keys, "left").fillna(0, ["sampled"])
    totals = both.agg(F.sum("n").alias("_n"), F.sum("sampled").alias("_s"))
    out = both.crossJoin(F.broadcast(totals))  # one row
    share, got = F.col("n") / F.col("_n"), F.coalesce(F.try_divide("sampled", "_s"), F.lit(0.0))
    return out.select(*keys, "n", "sampled", F.round(share, 9).alias("share"), F.round(got, 9).alias("sample_share"), F.round(F.greatest(share - got, F.lit(0.0)), 9).alias("deficit"))


def total_variation(strata_shares: DataFrame) -> DataFrame:
    """One row, tvd: half the sum of the differences between the shares of representativeness()."""
    return strata_shares.agg(F.round(F.sum(F.abs(F.col("share") - F.col("sample_share"))) / 2, 6).alias("tvd"))


def stratified_split(rows: DataFrame, stratum: str, id_col: str, test_share: float = 0.25) -> DataFrame:
    """rows with is_test: the first quarter of each stratum by sampling key; strata of one row are put together."""
    per = Window.partitionBy(stratum)
    merged = rows.withColumn("_stratum", F.when(F.count("*").over(per) > 1, F.col(stratum)))
    own = Window.partitionBy("_stratum")
    place = F.row_number().over(own.orderBy(sampling_key(F.col(id_col)), id_col))
    return merged.withColumn("is_test", place <= F.ceil(F.count("*").over(own) * test_share)).drop("_stratum")


def add_names(codes: DataFrame, names: DataFrame) -> DataFrame:
    """A code table (id, name) with the names that it lacks, numbered on from its greatest id in order of name. Null isn't a name."""
    new = names.where("name is not null").select("name").distinct().join(codes, "name", "left_anti")
    last = codes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = new.agg(F.sort_array(F.collect_list("name")).alias("all")).select(F.posexplode("all").alias("at", "name"))  # new names of a code table only
    return codes.select("id", "name").unionByName(numbered.crossJoin(last).select((F.col("at") + 1 + F.col("last")).cast(codes.schema["id"].dataType).alias("id"), "name"))


def public_view(meta: DataFrame, bodies: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Each record with its bodies by kind (text, meta, abstract) as columns, and with names in place of its codes (column <name>_id by table <name>)."""
    wide = bodies.groupBy("id").agg(*[F.max(F.when(F.col("kind") == k, F.col("body"))).alias(k) for k in ("text", "meta", "abstract")])
    out = meta.join(wide, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    for name, table in codes.items():
        out = out.join(table.select(F.col("id").alias(f"{name}_id"), F.col("name").alias(name)), f"{name}_id", "left").drop(f"{name}_id")
    return out
