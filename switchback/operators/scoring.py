"""Scores of predictions against labels, routing and ordering of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def labelled(rows: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Inner join with reference labels; rows without a label raise an error when they are computed."""
    joined = rows.join(labels, key, "left")
    return joined.withColumn("label", F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col(key).cast("string")))).otherwise(F.col("label")))


def accuracy(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Correct and all rows of ``(predicted, label)``, by set or over all."""
    cols = [F.count_if(F.col("predicted") == F.col("label")).alias("correct"), F.count("*").alias("rows")]
    return (rows.groupBy(by) if by else rows.groupBy()).agg(*cols)


def class_recall(rows: DataFrame, name: str) -> DataFrame:
    """Caught, actual and false alarms of one class."""
    p, a = F.col("predicted") == name, F.col("label") == name
    return rows.agg(F.count_if(p & a).alias("caught"), F.count_if(a).alias("actual"), F.count_if(p & ~a).alias("false_alarms"))


def disagreements(one: DataFrame, two: DataFrame, key: str = "id") -> DataFrame:
    """Rows on which two predictors differ."""
    other = two.select(key, F.col("predicted").alias("other"))
    return one.join(other, key).where(~F.col("predicted").eqNullSafe(F.col("other")))


def routed(rows: DataFrame, routing: dict[str, str], default: str | None = None) -> DataFrame:
    """``queue`` of each category; an unknown one gets ``default`` or, without it, raises an error."""
    table = F.create_map(*[F.lit(x) for pair in routing.items() for x in pair])
    hit = F.try_element_at(table, F.col("category"))
    miss = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("no queue for "), F.coalesce("category", F.lit("null"))))
    return rows.withColumn("queue", F.coalesce(hit, miss))


def union_of(sets: dict[str, DataFrame]) -> DataFrame:
    """Rows of several sets with their set's name as ``set``; columns go by name."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [rows.withColumn("set", F.lit(name)) for name, rows in sets.items()])


def priority_ranks(rows: DataFrame, position: str, urgent: str = "emergency") -> DataFrame:
    """``rows`` with ``rank`` from 1, urgent rows first, otherwise in input order.

    The rows are sorted in ranges, written down with their place in the range, and the ranges' sizes - one number a partition - give
    the offsets; no task sees all rows.
    """
    from pyspark.sql import Window

    from switchback.plans.lineage import written

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_late", ~F.coalesce(F.col("category") == urgent, F.lit(False)))
    placed = keyed.repartitionByRange(n, "_late", position).sortWithinPartitions("_late", position).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_n", "_before", "_late")


def by_priority(rows: DataFrame, position: str, urgent: str = "emergency") -> DataFrame:
    """Urgent rows first, otherwise in input order."""
    return rows.orderBy(~F.coalesce(F.col("category") == urgent, F.lit(False)), position)
