"""Parquet tables of a data folder, one folder or file a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet``; filters and column choices reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
