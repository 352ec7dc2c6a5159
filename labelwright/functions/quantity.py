"""Net quantity: units, validity and the expected unit-sale-price basis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.functions.literals import map_of
from labelwright.functions.rounding import half_up

# ---- Fixed values: spelling -> canonical unit -------------------------------------------
UNIT_SPELLINGS = {
    "g": ["g", "gm", "gms", "gram", "grams"],
    "kg": ["kg", "kgs", "kilogram", "kilograms"],
    "mg": ["mg", "mgs", "milligram", "milligrams"],
    "L": ["l", "liter", "liters", "litre", "litres"],
    "mL": ["ml", "mls", "milliliter", "milliliters", "millilitre", "millilitres"],
    "cL": ["cl", "centiliter", "centilitre"],
    "m": ["m", "meter", "meters", "metre", "metres"],
    "cm": ["cm", "centimeter", "centimeters", "centimetre", "centimetres"],
    "mm": ["mm", "millimeter", "millimeters", "millimetre", "millimetres"],
    "cm2": ["cm2", "sq cm", "square cm", "sq. cm"],
    "m2": ["m2", "sq m", "square m", "sq. m"],
    "unit": ["pc", "pcs", "piece", "pieces", "u", "unit", "units", "n", "no", "nos", "number", "numbers"],
}
# canonical unit -> kind, factor to the kind's base unit, base unit
UNIT_KINDS = {
    "g": ("MASS", 1.0, "g"),
    "kg": ("MASS", 1000.0, "g"),
    "mg": ("MASS", 0.001, "g"),
    "mL": ("VOLUME", 1.0, "mL"),
    "L": ("VOLUME", 1000.0, "mL"),
    "cL": ("VOLUME", 10.0, "mL"),
    "cm": ("LENGTH", 1.0, "cm"),
    "m": ("LENGTH", 100.0, "cm"),
    "mm": ("LENGTH", 0.1, "cm"),
    "cm2": ("AREA", 1.0, "cm2"),
    "m2": ("AREA", 10000.0, "cm2"),
    "unit": ("NUMBER", 1.0, "unit"),
}
# unit-sale-price units -> kind, factor to kg / L / m
PRICE_UNITS = {
    "mass": {
        "g": 0.001, "gm": 0.001, "gram": 0.001, "gramme": 0.001, "gms": 0.001, "grams": 0.001, "kg": 1.0, "kgs": 1.0, "kilogram": 1.0,
        "kilograms": 1.0, "mg": 0.000001, "milligram": 0.000001, "milligrams": 0.000001,
    },
    "volume": {
        "ml": 0.001, "millilitre": 0.001, "milliliter": 0.001, "millilitres": 0.001, "l": 1.0, "litre": 1.0, "liter": 1.0, "litres": 1.0,
        "liters": 1.0,
    },
    "length": {
        "cm": 0.01, "centimetre": 0.01, "centimeter": 0.01, "centimetres": 0.01, "m": 1.0, "metre": 1.0, "meter": 1.0, "metres": 1.0,
        "mm": 0.001, "millimetre": 0.001, "millimeter": 0.001, "millimetres": 0.001,
    },
    "count": {
        "unit": 1.0, "units": 1.0, "piece": 1.0, "pieces": 1.0, "pcs": 1.0, "no": 1.0, "nos": 1.0, "number": 1.0, "each": 1.0,
        "count": 1.0,
    },
}
# kind -> small basis, factor, large basis
PRICE_BASES = {
    "mass": ("gram", 1000.0, "kilogram"),
    "volume": ("millilitre", 1000.0, "litre"),
    "length": ("centimetre", 100.0, "metre"),
}
BUNDLE_PACKAGES = ["COMBINATION", "GROUP", "MULTI_PIECE"]
QUANTITY_PATTERN = r"^(-?\d+(?:\.\d+)?)\s*([a-zA-Z.2]+(?:[ \.]?[a-zA-Z]+)?)$"
# -----------------------------------------------------------------------------------------


def _spellings():
    for unit, spelled in UNIT_SPELLINGS.items():
        for word in spelled:
            yield word, unit


def canonical_unit(raw: Column) -> Column:
    key = F.lower(F.trim(raw))
    return F.coalesce(map_of(_spellings())[key], key)


def normalize(value: Column, unit: Column) -> Column:
    """struct(value, unit, kind, base_value, base_unit); unreadable parts give kind UNKNOWN."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (F.length(F.trim(unit)) > 0)
    name = F.when(ok, canonical_unit(unit))
    factor = map_of((u, k[1]) for u, k in UNIT_KINDS.items())[name]
    return F.struct(
        F.when(ok, value).alias("value"),
        name.alias("unit"),
        F.coalesce(map_of((u, k[0]) for u, k in UNIT_KINDS.items())[name], F.lit("UNKNOWN")).alias("kind"),
        (value * factor).alias("base_value"),
        map_of((u, k[2]) for u, k in UNIT_KINDS.items())[name].alias("base_unit"),
    )


def normalize_text(text: Column) -> Column:
    """The same for one string such as ``500 g`` or ``0.5kg``."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, QUANTITY_PATTERN, 1)
    return normalize(number.try_cast("double"), F.regexp_extract(trimmed, QUANTITY_PATTERN, 2))


def invalid_reason(q: Column) -> Column:
    """Null for a valid quantity, else the first reason that applies."""
    return (
        F.when(q["kind"] == "UNKNOWN", F.lit("UNKNOWN_UNIT"))
        .when(q["value"].isNull() | F.isnan(q["value"]), F.lit("INVALID_VALUE"))
        .when(F.abs(q["value"]) == float("inf"), F.lit("NON_FINITE_VALUE"))
        .when(q["value"] <= 0, F.lit("ZERO_OR_NEGATIVE_VALUE"))
    )


def price_basis(value: Column, unit: Column, package_type: Column) -> Column:
    """struct(status, kind, basis_unit, basis_quantity, reason_code) of the expected basis."""
    units = [(w, kind, f) for kind, factors in PRICE_UNITS.items() for w, f in factors.items()]
    key = F.lower(F.trim(unit))
    kind = map_of((w, k) for w, k, _ in units)[key]
    base = value * map_of((w, f) for w, _, f in units)[key]
    bad_value = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value <= 0)
    code = (
        F.when(bad_value, F.lit("QUANTITY_MISSING_OR_INVALID"))
        .when(kind.isNull(), F.lit("UNIT_NOT_RECOGNIZED"))
        .when(F.coalesce(package_type, F.lit("")).isin(BUNDLE_PACKAGES), F.lit("BUNDLE_PACKAGE"))
        .when((kind != "count") & (base == 1), F.lit("UNIT_BOUNDARY"))
    )
    small = map_of((k, b[0]) for k, b in PRICE_BASES.items())[kind]
    large = map_of((k, b[2]) for k, b in PRICE_BASES.items())[kind]
    factor = map_of((k, b[1]) for k, b in PRICE_BASES.items())[kind]
    amount = F.when(kind == "count", value).when(base < 1, base * factor).otherwise(base)
    rounded = F.when(F.abs(amount) >= 1000, F.floor(amount + 0.5).cast("double")).otherwise(half_up(amount, 6))
    return F.struct(
        F.when(code.isNull(), F.lit("APPLICABLE")).otherwise(F.lit("REVIEW")).alias("status"),
        F.when(code.isNull(), kind).alias("kind"),
        F.when(code.isNull(), F.when(kind == "count", F.lit("unit")).when(base < 1, small).otherwise(large)).alias("basis_unit"),
        F.when(code.isNull(), rounded).alias("basis_quantity"),
        code.alias("reason_code"),
    )
