"""Dashboard aggregates. Each works for every tenant at once, keyed by ``user_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions.literals import map_of
from labelwright.functions.rounding import half_up, half_up_int

# Stored status and the name it has on the dashboard.
STATUS_LABELS = {"COMPLIANT": "PASS", "NON_COMPLIANT": "FAIL", "REVIEW": "REVIEW", "PENDING": "PENDING"}

GRID_DEGREES = 0.05


def status_count(status: str) -> Column:
    return F.count_if(F.col("compliance_status") == status)


def summary(df: DataFrame, keys=("user_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        status_count("COMPLIANT").alias("pass"),
        status_count("NON_COMPLIANT").alias("fail"),
        status_count("REVIEW").alias("review"),
        status_count("PENDING").alias("pending"),
    )


def grand_summary(df: DataFrame) -> DataFrame:
    """One row in every case, all zeros for an empty input."""
    return summary(df, keys=())


def distribution(df: DataFrame) -> DataFrame:
    """Count per tenant and status label; the four known labels are always there.

    The known labels come out of the one aggregation as columns, so nothing is
    joined; labels outside the list follow from their own grouped counts.
    """
    counted = df.groupBy("user_id", "compliance_status").agg(F.count("*").alias("n"))
    known = list(STATUS_LABELS)
    filled = counted.groupBy("user_id").agg(
        *[F.sum(F.when(F.col("compliance_status") == s, F.col("n")).otherwise(0)).alias(s) for s in known]
    )
    zero_filled = filled.unpivot(["user_id"], known, "compliance_status", "n")
    others = counted.filter(~F.col("compliance_status").isin(known) | F.col("compliance_status").isNull())
    label = F.coalesce(
        map_of(STATUS_LABELS)[F.col("compliance_status")],
        F.col("compliance_status"),
    )
    return zero_filled.unionByName(others).select("user_id", label.alias("status"), F.col("n").cast("bigint"))


def by_category(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("user_id", "category")
        .agg(
            F.count("*").alias("total"),
            status_count("COMPLIANT").alias("pass"),
            status_count("NON_COMPLIANT").alias("fail"),
            status_count("REVIEW").alias("review"),
        )
        .orderBy("user_id", F.desc("total"), "category")
    )


def daily_trend(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("user_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count("*").alias("total"),
            status_count("COMPLIANT").alias("pass"),
            status_count("NON_COMPLIANT").alias("fail"),
            status_count("REVIEW").alias("review"),
        )
        .orderBy("user_id", "day")
    )


def trend_share(trend: DataFrame) -> DataFrame:
    """Bar height (share of the tenant's highest day) and share of its total, in percent.

    The peaks come from a second small aggregate rather than a window, so a tenant
    with very many days is never sorted in one task.
    """
    peaks = trend.groupBy("user_id").agg(F.max("total").alias("peak"), F.sum("total").alias("grand"))
    return trend.join(peaks, "user_id").select(
        "user_id",
        "day",
        "total",
        half_up(F.col("total") * 100.0 / F.col("peak"), 2).alias("bar_pct"),
        half_up(F.col("total") * 100.0 / F.col("grand"), 4).alias("total_pct"),
    )


def area_summary(df: DataFrame, start=None, end=None) -> DataFrame:
    """Totals in the date range next to the located count over all time, in one scan."""
    inside = F.lit(True)
    if start:
        inside = inside & (F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end:
        inside = inside & (F.col("created_at") <= F.lit(end).cast("timestamp"))

    def count(status=None):
        return F.count_if(inside if status is None else inside & (F.col("compliance_status") == status))

    return df.groupBy("user_id").agg(
        count().alias("total"),
        count("COMPLIANT").alias("compliant"),
        count("NON_COMPLIANT").alias("non_compliant"),
        count("REVIEW").alias("review"),
        count("PENDING").alias("pending"),
        F.count("latitude").alias("all_time_located"),
    )


def area_category(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("user_id", "category")
        .agg(
            F.count("*").alias("total"),
            status_count("NON_COMPLIANT").alias("non_compliant"),
            status_count("REVIEW").alias("review"),
        )
        .orderBy("user_id", F.desc("non_compliant"), F.desc("review"), "category")
    )


def attention_areas(df: DataFrame, cell: float = GRID_DEGREES, top: int = 10) -> DataFrame:
    """The tenant's grid cells with most non-compliant or open inspections (top-k report)."""
    grid = (
        df.select("user_id", "compliance_status", F.col("latitude").cast("double"), F.col("longitude").cast("double"))
        .filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .filter(~F.isnan("latitude") & ~F.isnan("longitude"))
        .withColumn("cell_lat", half_up_int(F.col("latitude") / cell))
        .withColumn("cell_lng", half_up_int(F.col("longitude") / cell))
        .groupBy("user_id", "cell_lat", "cell_lng")
        .agg(
            F.count("*").alias("n"),
            status_count("COMPLIANT").alias("compliant"),
            status_count("NON_COMPLIANT").alias("non_compliant"),
            status_count("REVIEW").alias("review"),
            half_up(F.avg("latitude"), 6).alias("center_lat"),
            half_up(F.avg("longitude"), 6).alias("center_lng"),
        )
        .withColumn("score", F.col("non_compliant") + F.col("review"))
        .withColumn("pending", F.col("n") - F.col("compliant") - F.col("score"))
        .filter((F.col("n") >= 2) & (F.col("score") >= 1))
    )
    order = W.partitionBy("user_id").orderBy(F.desc("score"), F.desc("n"), "cell_lat", "cell_lng")
    return grid.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)
