"""Small predicates shared by the compliance operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_value(value: Column) -> Column:
    """Null, the empty string and the word UNKNOWN all mean that nothing was read."""
    return F.coalesce((value != "") & (value != "UNKNOWN"), F.lit(False))


def known(value: Column) -> Column:
    """A null context value reads as UNKNOWN."""
    return F.when(value.isNull() | (value == ""), F.lit("UNKNOWN")).otherwise(value)


def listed(names: Column, name: Column) -> Column:
    return F.coalesce(F.array_contains(names, name), F.lit(False))


def plain_number(value: Column) -> Column:
    """A number as people write it: no point where nothing follows it."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
