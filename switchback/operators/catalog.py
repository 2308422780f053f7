"""Catalog search and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from switchback.functions.text import contains_ci

# fixed values: difficulties in ascending order; anything else counts as the last
DIFFICULTIES = ("easy", "moderate")


def difficulty_rank(c: Column) -> Column:
    return F.when(F.lower(c) == "easy", 0).when(F.lower(c) == "moderate", 1).otherwise(2)


def any_feature(features: Column, wanted: list[str] | str | None) -> Column:
    """Whether any wanted word is inside any feature; no wish: all rows."""
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.exists(features, lambda x: F.array_contains(F.array(*[F.contains(F.lower(x), F.lit(w.lower())) for w in wanted]), True)), F.lit(False))


def search_trails(trails: DataFrame, park: str | None = None, ceiling: str | None = None, features=None, limit: int = 8, position: str = "id") -> DataFrame:
    """The first ``limit`` trails in catalog order of a park, up to a difficulty, with any of the features."""
    most = {"easy": 0, "moderate": 1}.get((ceiling or "").lower(), 2)
    found = trails.where(difficulty_rank(F.col("difficulty")) <= most).where(any_feature(F.col("features"), features))
    if park:
        found = found.where(contains_ci(F.col("park"), F.lit(park)))
    return found.orderBy(position).limit(limit).select("id", "name", "park", "distance_mi", "elevation_ft", "difficulty", "features")


def park_match(parks: DataFrame, asked: str, key: str = "park", position: str = "pos") -> DataFrame:
    """The first park, in file order, whose name holds the question, lies in it, or holds its first word."""
    k, a = F.lower(F.col(key)), asked.strip().lower()
    first = a.split()[0] if a else ""
    hit = F.contains(k, F.lit(a)) | F.contains(F.lit(a), k) | F.contains(k, F.lit(first))
    return parks.where(~F.startswith(F.col(key), F.lit("_")) & hit).orderBy(position).limit(1)


def latest(rows: DataFrame, by: str, date: str, k: int = 4, tie: str = "id") -> DataFrame:
    """The k latest rows per key with their rank; ties in input order."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(date), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def resolve(rows: DataFrame, asked: str, position: str = "id") -> DataFrame:
    """The first row, in input order, whose id is ``asked`` or whose name holds it."""
    return rows.where((F.col("id") == asked) | contains_ci(F.col("name"), F.lit(asked))).orderBy(position).limit(1)


def concatenated(reviews: DataFrame, by: str = "product", text: str = "text", position: str = "id", runs: int = 0) -> DataFrame:
    """All texts per key in input order, joined by line ends.

    The rows are range-partitioned by key and position, so a key with very many rows lies in several partitions (``runs`` in all,
    as many as a shuffle has if 0); each joins its own texts, and a key's text is put together from these few long parts.
    """
    runs = runs or int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = reviews.where(F.col(text).isNotNull()).select(by, position, text).repartitionByRange(runs, by, position).withColumn("_run", F.spark_partition_id())
    parts = spread.groupBy(by, "_run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(position, text))), lambda x: x[text]), "\n").alias("part"), F.count("*").alias("n"))
    return parts.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", "part"))), lambda x: x["part"]), "\n").alias("text"), F.sum("n").alias("reviews"))


def _run_of(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def co_mentions(reviews: DataFrame, by: str = "product", text: str = "text") -> DataFrame:
    """How often the reviews of one product name another, by the words' runs, without a nested-loop join.

    Every run of as many words as some product name has is looked up by an equi-join.
    """
    names = reviews.select(F.col(by).alias("other")).where("other is not null").distinct().withColumn("key", F.lower("other")).withColumn("size", F.size(F.split("key", " ")))
    sizes = sorted(r.size for r in names.select("size").distinct().collect())
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    rows = reviews.where(F.col(text).isNotNull() & F.col(by).isNotNull()).select(by, "id", words.alias("w"))
    runs = F.array().cast("array<string>")
    for n in sizes:
        run = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), _run_of(n))
        runs = F.array_union(runs, run)
    said = rows.select(by, "id", F.explode(runs).alias("key"))
    return said.join(names, "key").where(F.col(by) != F.col("other")).groupBy(by, "other").agg(F.count_distinct("id").alias("mentions"))


def random_baseline(items: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``k`` rows that depend on the seed alone."""
    return items.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string"))), "id").limit(k)
