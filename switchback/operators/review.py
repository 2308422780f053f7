"""Review queue: policy lanes, gate, escalation, decisions, audit log and outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from switchback.functions.text import edit_distance

DRAFT, HUMAN = "draft-for-approval", "human-only"
# fixed values: lanes of the known categories; all others are for humans only
POLICY = {
    "trail-condition": DRAFT,
    "permit": DRAFT,
    "complaint": DRAFT,
    "general": DRAFT,
    "lost-and-found": DRAFT,
    "emergency": HUMAN,
}
#: Names under which a classifier may hand over a category of the policy.
ALIASES = {"conditions": "trail-condition"}


def with_lane(rows: DataFrame, policy: dict[str, str] = POLICY, aliases: dict[str, str] | None = None) -> DataFrame:
    """``lane`` by category; null and unknown categories fail closed."""
    lanes = F.create_map(*[F.lit(x) for p in policy.items() for x in p])
    name = F.col("category")
    if aliases:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in aliases.items() for x in p]), name), name)
    return rows.withColumn("lane", F.coalesce(F.try_element_at(lanes, name), F.lit(HUMAN)))


def gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(may be drafted, humans only) as two frames: what is not drafted never reaches a model."""
    return rows.where(F.col("lane") == DRAFT), rows.where(F.col("lane") != DRAFT)


def escalated(draft) -> F.Column:
    return F.startswith(F.upper(draft), F.lit("ESCALATE"))


def decided(drafts: DataFrame, decisions: DataFrame, reviewer: str) -> DataFrame:
    """Audit rows: each draft with its decision (missing: skipped), final text and edit distance."""
    rows = drafts.join(decisions.select("id", "decision", "edited"), "id", "left")
    known = F.when(F.col("decision").isin("approved", "edited", "rejected", "skipped"), F.col("decision")).otherwise("skipped")
    decision = F.when(F.col("lane") != DRAFT, "human-only").when(escalated(F.col("draft")), "escalated").otherwise(known)
    rows = rows.withColumn("decision", decision).withColumn("final", F.when(decision == "approved", F.col("draft")).when(decision == "edited", F.col("edited")))
    return rows.select("id", "category", "lane", "decision", F.lit(reviewer).alias("reviewer"), "draft", "final", edit_distance(F.coalesce("draft", F.lit("")), F.col("final")).alias("edit_distance"))


def decision_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("decision").agg(F.count("*").alias("rows"))


def append_audit(audit: DataFrame, path: str) -> None:
    """Append rows whose (id, decision) is not in the log yet, so that a repeated run adds nothing."""
    spark = audit.sparkSession
    try:
        seen = spark.read.schema(audit.schema).json(path).select("id", "decision")
        audit = audit.join(seen, ["id", "decision"], "left_anti")
    except Exception as e:  # the first run has no log
        if "PATH_NOT_FOUND" not in str(e):
            raise
    audit.write.mode("append").json(path)


def outbox(audit: DataFrame) -> DataFrame:
    """File name and content of each message that may be sent."""
    return audit.where(F.col("decision").isin("approved", "edited")).select(F.concat("id", F.lit(".txt")).alias("file"), F.concat("final", F.lit("\n")).alias("content"))


def write_outbox(audit: DataFrame, folder: str) -> int:
    """Write one file a message from the driver, streaming; the same name is written again with the same content."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for r in outbox(audit).toLocalIterator():
        (Path(folder) / Path(r.file).name).write_text(r.content, encoding="utf-8")
        n += 1
    return n
