"""Stable buckets from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_bucket(hex_digest: Column, modulus: int) -> Column:
    """First eight hex digits as a number, modulo."""
    return (F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint") % modulus).cast("int")


def polynomial(text: Column) -> Column:
    """31-polynomial over the characters with 32-bit wrap-around, as a non-negative number."""
    span = 1 << 32
    folded = F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("bigint"),
        lambda h, c: F.when(c == "", h).otherwise(F.pmod(h * 31 + F.ascii(c), F.lit(span))),
    )
    return F.abs(F.when(folded >= span // 2, folded - span).otherwise(folded))


def three_way(bucket: Column, cuts, names) -> Column:
    return F.when(bucket < cuts[0], F.lit(names[0])).when(bucket < cuts[1], F.lit(names[1])).otherwise(F.lit(names[2]))
