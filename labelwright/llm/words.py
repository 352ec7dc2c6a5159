"""Words as all operators here count them: runs of anything but space and the ASCII controls 9 to 13."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; of a null text, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_RUN), "")


def byte_words(text: str | None) -> list[bytes]:
    """The same inside a Python task, lower-cased A to Z: ``bytes`` methods know ASCII only."""
    return (text or "").encode("utf-8", "replace").lower().split()
