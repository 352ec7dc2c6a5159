"""The dated rule book: fixed values and the selection of what is in force on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.literals import structs_of

# ---- Fixed values ----------------------------------------------------------------------
# rule id, rule number, clause, first day, last day, replaced rules
RULES = [
    ("LMPC-RULE-3", "3", "3", None, None, []),
    ("LMPC-RULE-4", "4", "4", None, None, []),
    ("LMPC-RULE-6", "6", "6", None, None, []),
    ("LMPC-RULE-7", "7", "7", None, None, []),
    ("LMPC-RULE-8", "8", "8", None, None, []),
    ("LMPC-RULE-9", "9", "9", None, None, []),
    ("LMPC-RULE-11", "11", "11", None, None, []),
    ("LMPC-RULE-12", "12", "12", None, None, []),
    ("LMPC-SCHEDULE-1", "First Schedule", "First Schedule", None, None, []),
    ("LMPC-RULE6-10A-2026", "6", "6(10A)", "2026-07-01", "2027-06-30", []),
    ("LMPC-RULE6-10A-2027", "6", "6(10A)", "2027-07-01", None, ["LMPC-RULE6-10A-2026"]),
]

# rule number, clause key, rule id, automation level, evaluator, needed context fields, import statuses
CLAUSES = [
    ("6", "manufacturerName", "LMPC-RULE6-manufacturerName", "OCR", "presence", [], []),
    ("6", "manufacturerAddress", "LMPC-RULE6-manufacturerAddress", "MANUAL_REVIEW", "presence", [], []),
    ("6", "countryOfOrigin", "LMPC-RULE6-countryOfOrigin", "OCR", "presence", [], ["IMPORTED"]),
    ("6", "commonGenericName", "LMPC-RULE6-commonGenericName", "OCR", "presence", [], []),
    ("6", "netQuantity", "LMPC-RULE6-netQuantity", "OCR", "quantity", [], []),
    ("6", "dateOfManufacture", "LMPC-RULE6-dateOfManufacture", "OCR", "presence", [], []),
    ("6", "dateOfPacking", "LMPC-RULE6-dateOfPacking", "OCR", "presence", [], []),
    ("6", "expiryOrUseByDate", "LMPC-RULE6-bestBeforeUseBy", "OCR_CONTEXT", "expiry", ["domain", "commodityType"], []),
    ("6", "mrp", "LMPC-RULE6-mrp", "OCR", "price", [], []),
    ("6", "consumerCareDetails", "LMPC-RULE6-consumerCare", "OCR", "contact", [], []),
    ("6", "dimensions", "LMPC-RULE6-dimensions", "MANUAL_REVIEW", "dimensions", ["dimensionsApplicable"], []),
    ("6", "unitSalePrice", "LMPC-RULE6-unitSalePrice", "OCR_CONTEXT", "unit_price", ["unitSalePriceApplicable"], []),
    ("7", "numeralLetterHeight", "LMPC-RULE7-numeralLetterHeight", "VISUAL_CALIBRATED", "measurement", [], []),
    ("7", "smallPackage", "LMPC-RULE7-smallPackage", "MANUAL_REVIEW", "measurement", ["packageDimensions"], []),
    ("7", "letterHeight", "LMPC-RULE7-letterHeight", "VISUAL_CALIBRATED", "measurement", [], []),
    ("7", "letterWidthRatio", "LMPC-RULE7-letterWidthRatio", "VISUAL_CALIBRATED", "measurement", [], []),
    ("7", "quantityTypeDependentSize", "LMPC-RULE7-quantityTypeDependentSize", "VISUAL_CALIBRATED", "measurement", [], []),
    ("7", "medicalDeviceOverride", "LMPC-RULE7-medicalDeviceOverride", "MANUAL_REVIEW", "medical", ["domain"], []),
    ("8", "pdpLocation", "LMPC-RULE8-pdpLocation", "VISUAL", "panel", [], []),
    ("8", "declarationPlacement", "LMPC-RULE8-declarationPlacement", "VISUAL", "review", [], []),
    ("8", "surroundingSpace", "LMPC-RULE8-surroundingSpace", "VISUAL_CALIBRATED", "generic", [], []),
    ("8", "presentedDeclarations", "LMPC-RULE8-presentedDeclarations", "OCR_CONTEXT", "generic", [], []),
    ("8", "wrapperVisibility", "LMPC-RULE8-wrapperVisibility", "VISUAL", "generic", [], []),
    ("9", "legibility", "LMPC-RULE9-legibility", "OCR_CONTEXT", "generic", [], []),
    ("9", "prominence", "LMPC-RULE9-prominence", "VISUAL", "generic", [], []),
    ("9", "contrastingPresentation", "LMPC-RULE9-contrastingPresentation", "VISUAL", "generic", [], []),
    ("9", "languageFramework", "LMPC-RULE9-languageFramework", "OCR_CONTEXT", "generic", ["domain", "commodityType"], []),
    ("9", "readabilityThroughWrapper", "LMPC-RULE9-readabilityThroughWrapper", "VISUAL", "review", [], []),
    ("9", "prohibitionPreventNormalReading", "LMPC-RULE9-prohibitionPreventNormalReading", "VISUAL", "review", [], []),
    ("9", "priceQuantityPresentation", "LMPC-RULE9-priceQuantityPresentation", "OCR_CONTEXT", "review", [], []),
    ("11", "netQuantityExpression", "LMPC-RULE11-netQuantityExpression", "OCR", "quantity_expression", [], []),
    ("11", "maximumPermissibleError", "LMPC-SCHEDULE1-mpe", "MANUAL_REVIEW", "permissible_error", [], []),
]
# ----------------------------------------------------------------------------------------

_RULE_FIELDS = {
    "rule_id": "string", "rule_number": "string", "clause": "string",
    "effective_from": "date", "effective_to": "date", "supersedes": "array<string>",
}
_CLAUSE_FIELDS = {
    "rule_number": "string", "clause_key": "string", "rule_id": "string", "automation_level": "string",
    "evaluator": "string", "context_fields": "array<string>", "import_statuses": "array<string>",
}


def rule_array(rules=RULES) -> Column:
    """The rule dimension as one constant array column: no join and nothing to broadcast."""
    return structs_of(_RULE_FIELDS, rules)


def in_force(rule: Column, day: Column) -> Column:
    """Both ends inclusive; an open end never excludes."""
    return (rule["effective_from"].isNull() | (day >= rule["effective_from"])) & (
        rule["effective_to"].isNull() | (day <= rule["effective_to"])
    )


def active_rules(day: Column, rules: Column | None = None) -> Column:
    """Rules in force on ``day`` without those a co-active rule replaces."""
    table = rule_array() if rules is None else rules
    active = F.filter(table, lambda r: in_force(r, day))
    replaced = F.flatten(F.transform(active, lambda r: r["supersedes"]))
    return F.filter(active, lambda r: ~F.array_contains(replaced, r["rule_id"]))


def rules_as_of(days: DataFrame, day: str = "day") -> DataFrame:
    """One row per distinct day and rule, in rule order (binary order of number and clause)."""
    return (
        days.select(F.col(day).cast("date").alias("day"))
        .distinct()
        .select("day", F.explode(active_rules(F.col("day"))).alias("r"))
        .select("day", "r.rule_id", "r.rule_number", "r.clause", "r.effective_from", "r.effective_to")
    )


def rules_delta(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Rules that come into or fall out of force between two days of the same row."""
    ids = lambda day: F.transform(active_rules(F.col(day)), lambda r: r["rule_id"])
    change = F.array(
        F.struct(F.lit("ADDED").alias("change"), F.array_except(ids(after), ids(before)).alias("rules")),
        F.struct(F.lit("REMOVED").alias("change"), F.array_except(ids(before), ids(after)).alias("rules")),
    )
    return (
        pairs.select(before, after)
        .distinct()
        .select(before, after, F.explode(change).alias("c"))
        .select(before, after, "c.change", F.explode("c.rules").alias("rule_id"))
    )


def clause_array(rule_numbers=None) -> Column:
    """Clause dimension as a constant array; all clauses are open-ended today."""
    rows = [row[:6] + (row[6] or None,) for row in CLAUSES if rule_numbers is None or row[0] in rule_numbers]
    return structs_of(_CLAUSE_FIELDS, rows)


def with_clauses(products: DataFrame, rule_numbers=None) -> DataFrame:
    """One row per product and clause: a narrow generate step instead of a cross join."""
    return products.withColumn("c", F.explode(clause_array(rule_numbers)))
