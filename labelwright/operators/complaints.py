"""Complaint register: ownership, snapshots, status histories, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions.literals import map_of
from labelwright.operators.ranking import numbered

# Where a status may go.
TRANSITIONS = {"SUBMITTED": ["UNDER_REVIEW", "REJECTED"], "UNDER_REVIEW": ["RESOLVED", "REJECTED"]}
STATUSES = ["SUBMITTED", "UNDER_REVIEW", "RESOLVED", "REJECTED"]


def allowed(before: Column, after: Column) -> Column:
    pairs = {f"{a}>{b}": True for a, targets in TRANSITIONS.items() for b in targets}
    return F.coalesce(map_of(pairs)[F.concat(before, F.lit(">"), after)], F.lit(False))


def owned(complaints: DataFrame, products: DataFrame) -> DataFrame:
    """Complaints whose product exists and belongs to the complainant, marked accepted."""
    mine = products.select("product_id", "user_id").distinct().withColumn("accepted", F.lit(True))
    return complaints.join(mine, ["product_id", "user_id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def latest(items: Column) -> Column:
    """Last element of an array; null for an empty or missing one."""
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def snapshots(complaints: DataFrame, products: DataFrame) -> DataFrame:
    """Product columns frozen with the complaint."""
    frozen = products.select(
        "product_id",
        "user_id",
        F.struct(
            "category", "mrp", "batch_lot_number", "compliance_status", "analysis_status",
            latest(F.col("images")).alias("image_url"),
        ).alias("snapshot"),
    )
    return complaints.join(frozen, ["product_id", "user_id"])


def transitions(events: DataFrame) -> DataFrame:
    """Each change with the status before it, its legality and the hours spent there.

    One complaint's history is a handful of rows, so its window is small.
    """
    order = W.partitionBy("complaint_id").orderBy("changed_at", "seq")
    before = F.lag("status").over(order)
    since = F.lag("changed_at").over(order)
    return (
        events.withColumn("from_status", before)
        .withColumn("hours", (F.unix_timestamp("changed_at") - F.unix_timestamp(since)) / 3600.0)
        .select(
            "complaint_id", "seq", "from_status", F.col("status").alias("to_status"), "hours",
            F.when(F.col("from_status").isNull(), F.col("status") == "SUBMITTED").otherwise(allowed(F.col("from_status"), F.col("status"))).alias("legal"),
        )
    )


def current(events: DataFrame) -> DataFrame:
    """Latest status per complaint; ``max`` over a struct combines before the shuffle."""
    last = F.max(F.struct("changed_at", "seq", "status"))
    done = F.max(F.when(F.col("status").isin("RESOLVED", "REJECTED"), F.col("changed_at")))
    return events.groupBy("complaint_id").agg(last.alias("l"), done.alias("resolved_at"), F.count("*").alias("changes")).select(
        "complaint_id", F.col("l.status").alias("status"), F.col("l.changed_at").alias("changed_at"), "resolved_at", "changes"
    )


def with_numbers(complaints: DataFrame, last_used: int = 0) -> DataFrame:
    """``CMP-<year>-<six digits>`` without gaps, in order of submission, after ``last_used``."""
    rows = numbered(complaints, ["submitted_at", "complaint_id"], "sequence", last_used)
    text = F.concat(
        F.lit("CMP-"), F.date_format("submitted_at", "yyyy"), F.lit("-"),
        F.when(F.length(F.col("sequence").cast("string")) < 6, F.lpad(F.col("sequence").cast("string"), 6, "0")).otherwise(F.col("sequence").cast("string")),
    )
    return rows.withColumn("complaint_number", text)
