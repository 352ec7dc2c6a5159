"""Rounding and quantile conventions that differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int = 0) -> Column:
    """Round with exact halves going up, also below zero (-2.5 becomes -2)."""
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_up_int(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Share in percent; an empty whole gives zero."""
    return F.when(whole > 0, half_up(part * 100.0 / whole, places)).otherwise(F.lit(0.0))
