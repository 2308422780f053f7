"""Anomalies: thresholds on distances, and alerts from anomalies close in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def flagged(rows: DataFrame, by: str, sigma: float = 1.0, col: str = "distance", baseline=None) -> DataFrame:
    """Rows strictly over mean + sigma x population deviation of their group, with the statistics.

    ``baseline``: a condition; only rows that meet it (say, before a date) set the statistics.
    """
    base = rows if baseline is None else rows.where(baseline)
    stats = base.groupBy(by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd"))
    return rows.join(stats, by).withColumn("threshold", F.col("mean") + sigma * F.col("sd")).where(F.col(col) > F.col("threshold"))


def gap_clusters(rows: DataFrame, by: str, date: str = "date", days: int = 14) -> DataFrame:
    """``cluster`` numbers from 1: a row joins the one before it if at most ``days`` lie between; rows without key or date have none.

    Clusters depend on the dates alone, so the window runs over the different dates of a key - as many as the calendar has days,
    however many rows fall on them - and the rows look theirs up.
    """
    w = Window.partitionBy(by).orderBy(date)
    new = F.coalesce((F.datediff(F.col(date), F.lag(date).over(w)) > days).cast("int"), F.lit(1))
    dates = rows.select(by, date).where(F.col(by).isNotNull() & F.col(date).isNotNull()).distinct()
    numbered = dates.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).drop("_new")
    return rows.join(numbered, [by, date], "left")


def alerts(clustered: DataFrame, by: str, date: str = "date", least: int = 2) -> DataFrame:
    """A row per cluster; ``alert`` from ``least`` rows on, else a lone outlier."""
    return clustered.groupBy(by, "cluster").agg(F.count("*").alias("size"), F.min(date).alias("first"), F.max(date).alias("last")).withColumn("alert", F.col("size") >= least)


def report(flagged_rows: DataFrame, digits: int = 4) -> DataFrame:
    """``(id, line)``: fixed-width lines of flagged rows ``(id, distance, threshold)``, as a console report prints them."""
    number = lambda c: F.lpad(F.format_string(f"%.{digits}f", F.col(c).cast("double")), digits + 6, " ")
    return flagged_rows.select("id", F.concat(F.rpad(F.col("id").cast("string"), 20, " "), number("distance"), number("threshold"), F.lit("  over by"), F.lpad(F.format_string(f"%.{digits}f", (F.col("distance") - F.col("threshold")).cast("double")), digits + 6, " ")).alias("line"))
