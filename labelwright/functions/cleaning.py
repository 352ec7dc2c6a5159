"""Cleaning of free text and day values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_name(text: Column) -> Column:
    """Up to 64 word characters, slashes or dashes; anything else is dropped."""
    cut = F.substring(F.trim(text), 1, 64)
    return F.when(cut.rlike(r"^[\w/-]{1,64}$"), cut)


def summary(text: Column, limit: int = 300) -> Column:
    """Control characters become spaces, then the length is capped; empty gives null."""
    clean = F.substring(F.regexp_replace(F.trim(text), "[\\x00-\\x1f\\x7f]", " "), 1, limit)
    return F.when(clean != "", clean)


def iso_day(text: Column, as_of: Column) -> Column:
    """``yyyy-MM-dd`` of a date or timestamp text; unreadable or missing text gives the as-of day."""
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    parsed = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd")
    return F.coalesce(plain, parsed, F.date_format(as_of, "yyyy-MM-dd"))
