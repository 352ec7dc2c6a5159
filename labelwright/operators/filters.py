"""Row filters of the read paths: tenant scope, search, status aliases, date windows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The older status words and what they are stored as.
STATUS_ALIASES = {"PASS": "COMPLIANT", "FAIL": "NON_COMPLIANT"}


def for_tenant(df: DataFrame, user_id) -> DataFrame:
    return df.filter(F.col("user_id") == F.lit(user_id))


def text_search(df: DataFrame, term: str | None, columns: Iterable[str]) -> DataFrame:
    """Case-insensitive literal substring over several columns; a blank term keeps every row."""
    if not term:
        return df
    needle = F.lower(F.lit(term))
    return df.filter(reduce(or_, [F.lower(F.col(c)).contains(needle) for c in columns]))


def stored_status(word: str) -> str:
    return STATUS_ALIASES.get(word, word)


def list_filter(df: DataFrame, status=None, analysis_status=None, category=None) -> DataFrame:
    for column, wanted in (
        ("compliance_status", stored_status(status) if status else None),
        ("analysis_status", analysis_status),
        ("category", category),
    ):
        if wanted:
            df = df.filter(F.col(column) == wanted)
    return df


def since_days(df: DataFrame, as_of: str, days: int | str | None, ts: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of``; ``None`` and ``"all"`` keep every row."""
    if days in (None, "all"):
        return df
    count = int(days)
    if count <= 0:
        raise ValueError("days must be a positive number or 'all'")
    return df.filter(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(count)))


def located(lat: Column | None = None) -> Column:
    return (F.col("latitude") if lat is None else lat).isNotNull()


def map_filter(df: DataFrame, status=None, category=None, start=None, end=None, maker=None) -> DataFrame:
    """Located inspections, both ends of the date range included at their midnight."""
    out = df.filter(located())
    if status:
        out = out.filter(F.col("compliance_status") == status)
    if category:
        out = out.filter(F.col("category") == category)
    if start:
        out = out.filter(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.filter(F.col("created_at") <= F.lit(end).cast("timestamp"))
    if maker and maker.strip():
        out = text_search(out, maker.strip(), ["brand_name", "manufacturer_name"])
    return out
