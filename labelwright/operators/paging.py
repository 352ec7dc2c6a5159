"""Pages of a listing, for one tenant or for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamp_page(page=None, limit=None, default=20, most=100) -> tuple[int, int]:
    """Page at least 1, size between 1 and ``most``; missing or zero means the default."""

    def number(text, fallback):
        try:
            return int(text) or fallback
        except (TypeError, ValueError):
            return fallback

    return max(1, number(page, 1)), min(most, max(1, number(limit, default)))


def page_of_each(df: DataFrame, tenant: str, order: list[Column], page: int, limit: int) -> DataFrame:
    """The given page of every tenant.

    ``row_number() <= k`` lets Spark keep only k rows per tenant and task before the
    shuffle, so a very large tenant does not travel to one task.
    """
    last = page * limit
    rank = F.row_number().over(W.partitionBy(tenant).orderBy(*order))
    return df.withColumn("position", rank).filter(F.col("position") <= last).filter(F.col("position") > last - limit)


def one_page(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_meta(df: DataFrame, tenant: str, page: int, limit: int) -> DataFrame:
    totals = df.groupBy(tenant).agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / F.lit(limit)).cast("bigint")
    return totals.select(
        tenant,
        F.lit(page).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("page_size"),
        "total",
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_previous"),
    )
