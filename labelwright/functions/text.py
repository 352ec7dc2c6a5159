"""Readers for single text tokens: money, quantity, dates, contacts, codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.functions.literals import map_of


def hits(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + pattern)


def hits_any(text: Column, several: Iterable[str], ignore_case: bool = True) -> Column:
    """One alternation instead of a chain of tests."""
    return hits(text, "|".join(f"(?:{p})" for p in several), ignore_case)


def group(text: Column, pattern: str, index: int, ignore_case: bool = True) -> Column:
    return F.regexp_extract(text, ("(?i)" if ignore_case else "") + pattern, index)


def groups(text: Column, pattern: str, count: int, ignore_case: bool = True) -> Column:
    """The one group that took part in the match, or the empty string."""
    return F.concat(*[group(text, pattern, i + 1, ignore_case) for i in range(count)])


def after(text: Column, label: str) -> Column:
    """Trimmed text behind the first match of a label; empty when there is none."""
    return F.trim(F.regexp_extract(text, f"(?is)^.*?(?:{label})(.*)$", 1))


def strip_periods(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\.+$", ""))


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def shape_of(text: Column, skip: str | None = None) -> Column:
    """First concept whose shape the text has, or null."""
    out = None
    for concept, pattern, fold in P.SHAPES:
        if concept != skip:
            test = hits(text, pattern, fold)
            out = F.when(test, F.lit(concept)) if out is None else out.when(test, F.lit(concept))
    return out


# ---- price ------------------------------------------------------------------------------
def labelled_price(text: Column) -> Column:
    """Amount next to a price label, as text; null when there is none or its shape is refused."""
    amount = groups(text, P.MONEY, 3)
    return F.when((amount != "") & ~hits(amount, P.REJECT_PRICE) & (number(amount) > 0), amount)


def classify_price(text: Column) -> Column:
    """Value of a token that carries its own money sign; null otherwise."""
    value = number(groups(F.trim(text), P.AMOUNT, 3))
    return F.when(value > 0, value)


# ---- quantity ----------------------------------------------------------------------------
def labelled_quantity(text: Column) -> Column:
    """``value unit`` next to a quantity label, or null."""
    value, unit = group(text, P.NET_QTY_VALUE, 1), group(text, P.NET_QTY_VALUE, 2)
    short = map_of({"litre": "l", "liter": "l"})
    name = F.coalesce(short[F.lower(unit)], F.lower(unit))
    good = (value != "") & ~hits(value, P.REJECT_NUMBER) & (number(value) >= 0)
    return F.when(good, F.concat(value, F.lit(" "), name))


def classify_quantity(text: Column) -> Column:
    """struct(value, unit, kind, multiplier); null unless the unit is known and the value positive."""
    units = [(w, kind, f) for kind, factors in P.QUANTITY_TOKEN_UNITS.items() for w, f in factors.items()]
    trimmed = F.trim(text)
    value = group(trimmed, P.QUANTITY_TOKEN, 1, False).try_cast("double")
    unit = F.lower(group(trimmed, P.QUANTITY_TOKEN, 2, False))
    kind = map_of((w, k) for w, k, _ in units)[unit]
    name = F.when((unit == "l"), F.lit("L")).otherwise(unit)
    return F.when(
        kind.isNotNull() & (value > 0),
        F.struct(
            value.alias("value"),
            name.alias("unit"),
            kind.alias("kind"),
            map_of((w, f) for w, _, f in units)[unit].alias("multiplier"),
        ),
    )


# ---- batch -------------------------------------------------------------------------------
def plausible_batch(code: Column) -> Column:
    value = F.trim(F.coalesce(code, F.lit("")))
    digits = F.length(F.regexp_replace(value, r"[^\d]", ""))
    return (
        F.length(value).between(2, 20)
        & ~hits(value, P.BATCH_PROSE)
        & ~hits(value, P.BATCH_QUANTITY)
        & ~hits(value, P.BATCH_PHONE)
        & (digits > 0)
        & (value.rlike("[A-Za-z]") | (digits >= 4))
    )


def labelled_batch(text: Column, whole: Column) -> Column:
    """The code, the word REVIEW for a reference to another place, or null."""
    code = strip_periods(group(text, P.BATCH_VALUE, 1))
    elsewhere = hits(text, P.SEE_ELSEWHERE) | hits(whole, P.SEE_ELSEWHERE)
    return F.when(group(text, P.BATCH_VALUE, 1) != "", F.when(elsewhere, F.lit("REVIEW")).when(plausible_batch(code), code))


# ---- contacts ----------------------------------------------------------------------------
def email(text: Column) -> Column:
    found = group(text, P.EMAIL, 0, False)
    return F.when(found != "", found)


def phone(text: Column) -> Column:
    """First phone-like run of digits; a plain six-digit postal code is none."""
    found = group(text, P.PHONE, 0, False)
    return F.when((found != "") & ~found.rlike(r"^\d{6}$"), found)


# ---- dates -------------------------------------------------------------------------------
def _month(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), map_of(P.MONTHS)[F.lower(F.substring(text, 1, 3))].cast("int"))


def _year(text: Column) -> Column:
    return F.when(F.length(text) == 2, F.concat(F.lit("20"), text)).otherwise(text).cast("int")


def _iso(year: Column, month: Column, day: Column) -> Column:
    """Calendar-valid date between 1900 and 2100 as text, or null."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    fine = year.between(1900, 2100) & month.isNotNull() & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    return F.when(fine, text)


def extract_date(raw: Column) -> Column:
    """First usable date of a text as ``yyyy-MM-dd``: full dates first, then month and year.

    Candidates are tried in text order. One that follows a money word, or that is glued
    to a run of digits before it, is passed over.
    """
    text = F.trim(raw)

    def first_valid(pattern: str, parts: int, build) -> Column:
        # Each piece runs from the end of the previous match to the end of this one; \\G keeps
        # the search linear in the text when nothing more follows.
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(\G.*?{pattern})"), F.lit(1))

        def step(acc: Column, piece: Column) -> Column:
            found = [F.regexp_extract(piece, pattern + "$", i) for i in range(parts + 1)]
            lead = F.substr(piece, F.lit(1), F.length(piece) - F.length(found[0]))
            before = F.concat(acc["seen"], lead)
            glued = before.rlike(P.DIGITS_BEFORE) & before.rlike(r"\d")
            usable = ~hits(before, P.MONEY_BEFORE) & ~glued
            return F.struct(
                F.concat(acc["seen"], piece).alias("seen"),
                F.coalesce(acc["iso"], F.when(usable, build(*found[1:]))).alias("iso"),
            )

        start = F.struct(F.lit("").alias("seen"), F.lit(None).cast("string").alias("iso"))
        return F.aggregate(pieces, start, step)["iso"]

    full = first_valid(P.DAY_MONTH_YEAR, 3, lambda d, m, y: _iso(_year(y), _month(m), d.try_cast("int")))
    short = first_valid(P.MONTH_YEAR, 2, lambda m, y: _iso(_year(y), _month(m), F.lit(1)))
    return F.when(text.rlike(P.MONTH_YEAR), F.coalesce(full, short))


def classify_date(raw: Column) -> Column:
    """struct(iso, granularity) of the first date-shaped part, 1990 to 2100; no calendar check."""
    text = F.trim(raw)
    g = lambda pattern, i: F.regexp_extract(text, pattern, i)
    day_match, month_match = g(P.DAY_MONTH_YEAR, 0) != "", g(P.MONTH_YEAR_4, 0) != ""
    year1 = F.when(day_match, _year(g(P.DAY_MONTH_YEAR, 3)))
    month1, day1 = _month(g(P.DAY_MONTH_YEAR, 2)), g(P.DAY_MONTH_YEAR, 1).try_cast("int")
    year2 = F.when(month_match, g(P.MONTH_YEAR_4, 2).try_cast("int"))
    month2 = _month(g(P.MONTH_YEAR_4, 1))
    as_text = lambda y, m, d: F.format_string("%d-%02d-%02d", y, m, d)
    return F.when(
        day_match & year1.between(1990, 2100) & month1.between(1, 12) & day1.between(1, 31),
        F.struct(as_text(year1, month1, day1).alias("iso"), F.lit("DAY").alias("granularity")),
    ).when(
        month_match & year2.between(1990, 2100) & month2.between(1, 12),
        F.struct(as_text(year2, month2, F.lit(1)).alias("iso"), F.lit("MONTH").alias("granularity")),
    )
