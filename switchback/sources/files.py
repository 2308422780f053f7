"""Text, Markdown and JSON files as DataFrames, and the sinks beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from switchback.functions.text import front_matter_field, without_front_matter

TRAIL = "id string, name string, park string, distance_mi double, elevation_ft int, difficulty string, features array<string>, description string"
REVIEW = "id string, product string, rating int, reviewer string, text string"
REPORT = "id string, trail_id string, date date, text string"
INQUIRY = "id string, channel string, received timestamp, category string, doc string, text string"
FACTS = "trail_name string, park string, date_hiked string, distance_mi double, elevation_gain_ft double, wildlife array<string>, conditions array<string>, hazards array<string>"


def whole_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """``(name, text)``, a row a file; the name orders them."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def trip_reports(spark: SparkSession, path: str) -> DataFrame:
    """Front matter fields and body of Markdown files."""
    raw = whole_texts(spark, path)
    fields = [front_matter_field(F.col("text"), f).alias(f) for f in ("id", "author", "date", "park")]
    return raw.select("name", *fields, without_front_matter(F.col("text")).alias("body"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_json(spark: SparkSession, path: str, value_ddl: str) -> DataFrame:
    """``(key, value)`` of an object whose keys are ids; keys that begin with ``_`` are comments.

    Values go through variants, since a comment of another type would spoil a map of structs.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = spark.sql("select e.key, e.pos, to_json(e.value) as value from {raw}, lateral variant_explode(v) as e", raw=raw)
    return rows.where(~F.startswith("key", F.lit("_"))).select("key", "pos", F.from_json("value", value_ddl).alias("value"))


def with_snippet(rows: DataFrame, snippets: DataFrame, missing: str = "(none on file for this message)") -> DataFrame:
    """Left join by file name; ``snippet`` has a fallback."""
    s = snippets.select(F.col("name").alias("doc"), F.col("text").alias("snippet"))
    return rows.join(s, "doc", "left").withColumn("snippet", F.coalesce("snippet", F.lit(missing)))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
