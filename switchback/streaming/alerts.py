"""Alerts on a stream of reports: anomalies of a key that lie close in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_alerts(events: DataFrame, baseline: DataFrame, by: str, ts: str = "ts", value: str = "value", gap: str = "14 days", late: str = "1 day", sigma: float = 1.0, least: int = 2) -> DataFrame:
    """Sessions of flagged events: ``(by, start, end, size, alert)``, emitted once the watermark has passed.

    ``baseline(by, mean, sd)`` is a static table, refreshed in batch.  The state is one session per key and
    open gap.  A time without zone is read in the session's zone, for watermarks need an instant.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    flagged = timed.join(baseline, by).where(F.col(value) > F.col("mean") + sigma * F.col("sd"))
    out = flagged.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("size"))
    # a session's end is its last event plus the gap
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "size", (F.col("size") >= least).alias("alert"))


def replayed(alerts: DataFrame, folder: str) -> DataFrame:
    """All sessions of a stream that has an end, those included that no later event would close.

    Runs the plan once over what is there; in complete mode each batch puts out every session, and the last one is kept.  An endless stream
    is written in append mode instead, where a session appears when the watermark has passed it.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    query = alerts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = alerts.sparkSession
    return spark.read.schema(alerts.schema).parquet(f"{folder}/out")


def baseline_of(events: DataFrame, by: str, value: str = "value") -> DataFrame:
    return events.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
