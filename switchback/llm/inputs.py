"""The texts that the problems' operators read, as (tab, rec_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from switchback.sources.tables import table

KEYS = {"documents": "doc_id", "hard": "id", "inquiries": "id", "condition_reports": "id"}


def texts_of(spark: SparkSession, sf_dir: str, *tabs: str) -> DataFrame:
    """Rows (tab, rec_id, text) of the tables, ids as strings."""
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(KEYS[t]).cast("string").alias("rec_id"), "text") for t in tabs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
