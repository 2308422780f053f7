from datetime import datetime, timedelta

from pyspark.sql import functions as F

from switchback.streaming.alerts import replayed, stream_alerts


def test_sessions_of_flagged_events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    days = [0, 1, 2, 40, 41, 90, 200]
    rows = [(1, start + timedelta(days=x), 10.0) for x in days] + [(1, start + timedelta(days=5), 0.5), (2, start + timedelta(days=300), 10.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0)], "user_id long, mean double, sd double")
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    out = stream_alerts(stream, base, "user_id", gap="14 days")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").select(F.date_format("start", "yyyy-MM-dd").alias("d"), "size", "alert").collect()
    # the last sessions stay open until the watermark passes them
    assert [(r.d, r.size, r.alert) for r in got][:3] == [("2024-01-01", 3, True), ("2024-02-10", 2, True), ("2024-03-31", 1, False)]
    # a replay of a stream that has an end puts out every session
    every = replayed(stream_alerts(stream, base, "user_id", gap="14 days"), str(tmp_path / "whole")).orderBy("user_id", "start").select("user_id", "size").collect()
    assert [tuple(r) for r in every] == [(1, 3), (1, 2), (1, 1), (1, 1), (2, 1)]
