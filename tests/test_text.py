"""Readers of single tokens: golden cases."""

import pytest
from pyspark.sql import functions as F

from labelwright.functions import quantity
from labelwright.functions import text as T
from labelwright.functions.hashing import hex_bucket
from labelwright.functions.rounding import half_up
from labelwright.operators import splits


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, day",
    [
        ("Mfg Date: 15/08/2025", "2025-08-15"),
        ("Use By: 01/2027", "2027-01-01"),
        ("Best Before: 31.12.2026", "2026-12-31"),
        ("1 JAN 2026", "2026-01-01"),
        ("15-Mar-26", "2026-03-15"),
        ("31.02.2024 then 1.3.24", "2024-03-01"),
        ("Rs.5.00 (INCL.OF ALL TAXES)", None),
        ("call 1800-10-22", None),
        ("lot 33-01-2025", None),
        ("MRP 12/2025, bb: 11/2025", "2025-11-01"),
        ("best 11/2025", None),
        ("no date here", None),
        ("", None),
        ("x" * 50000 + ". 08/2026", "2026-08-01"),
        ("2. 08/2026", None),
    ],
)
def test_extract_date(spark, text, day):
    assert one(spark, text, T.extract_date) == day


@pytest.mark.parametrize(
    "text, expected",
    [
        ("08/2026", ("2026-08-01", "MONTH")),
        ("12/08/2026", ("2026-08-12", "DAY")),
        ("31/02/2026", ("2026-02-31", "DAY")),
        ("12/08/1985", None),
        ("08/26", None),
    ],
)
def test_classify_date(spark, text, expected):
    got = one(spark, text, T.classify_date)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "text, value",
    [("Rs. 250.00", 250.0), ("₹1,299", 1299.0), ("129/-", 129.0), ("07/25", None), ("0.61/ml", None), ("250", None)],
)
def test_price(spark, text, value):
    assert one(spark, text, T.classify_price) == value


@pytest.mark.parametrize(
    "code, ok",
    [("ABC123", True), ("33-01-2025", True), ("24", False), ("42g", False), ("INDICATES", False), ("9876543210", False), ("A1", True), ("", False)],
)
def test_batch(spark, code, ok):
    assert one(spark, code, T.plausible_batch) is ok


def test_contacts(spark):
    assert one(spark, "write to a.b@c.in or 1800-123-4567", T.email) == "a.b@c.in"
    assert one(spark, "write to a.b@c.in or 1800-123-4567", T.phone) == "1800-123-4567"
    assert one(spark, "Mumbai 560001", T.phone) is None


@pytest.mark.parametrize(
    "value, unit, package, status, basis, amount",
    [
        (0.75, "kg", "SINGLE", "APPLICABLE", "gram", 750.0),
        (1250.0, "g", None, "APPLICABLE", "kilogram", 1.25),
        (0.9, "L", "SINGLE", "APPLICABLE", "millilitre", 900.0),
        (1.0, "kg", "SINGLE", "REVIEW", None, None),
        (12.0, "pcs", "SINGLE", "APPLICABLE", "unit", 12.0),
        (500.0, "g", "GROUP", "REVIEW", None, None),
        (5.0, "xyz", "SINGLE", "REVIEW", None, None),
        (None, "g", "SINGLE", "REVIEW", None, None),
    ],
)
def test_unit_price_basis(spark, value, unit, package, status, basis, amount):
    row = (
        spark.createDataFrame([(value, unit, package)], "v double, u string, p string")
        .select(quantity.price_basis(F.col("v"), F.col("u"), F.col("p")).alias("b"))
        .first()["b"]
    )
    assert (row["status"], row["basis_unit"], row["basis_quantity"]) == (status, basis, amount)


@pytest.mark.parametrize(
    "text, kind, base, reason",
    [
        ("500 g", "MASS", 500.0, None),
        ("0.5kg", "MASS", 500.0, None),
        ("1.5 L", "VOLUME", 1500.0, None),
        ("10 pcs", "NUMBER", 10.0, None),
        ("10 sq. cm", "AREA", 10.0, None),
        ("abc kg", "UNKNOWN", None, "UNKNOWN_UNIT"),
        ("-5 g", "MASS", -5.0, "ZERO_OR_NEGATIVE_VALUE"),
        ("5 furlong", "UNKNOWN", None, "UNKNOWN_UNIT"),
    ],
)
def test_quantity_text(spark, text, kind, base, reason):
    q = one(spark, text, quantity.normalize_text)
    assert (q["kind"], q["base_value"]) == (kind, base)
    assert one(spark, text, lambda v: quantity.invalid_reason(quantity.normalize_text(v))) == reason


def test_rounding_halves_go_up(spark):
    assert [one(spark, v, half_up, "double") for v in (-2.5, 2.5, -0.5, 1.4)] == [-2.0, 3.0, 0.0, 1.0]


def test_md5_split_of_known_products(spark):
    got = [one(spark, f"product_00{i}", splits.md5_split) for i in (1, 2, 3)]
    assert got == ["train", "test", "validation"]
    assert one(spark, "product_001", lambda v: hex_bucket(F.md5(v), 10)) == 0
