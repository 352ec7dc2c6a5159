"""Row validation: one error per broken column, rows split into good and quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values --------------------------------------------------------------------------
CHECK_STATUSES = ["PASS", "FAIL", "REVIEW", "NOT_APPLICABLE", "PENDING"]
COMPLIANCE_STATUSES = ["PENDING", "COMPLIANT", "NON_COMPLIANT", "REVIEW"]
ANALYSIS_STATUSES = ["PENDING", "PROCESSING", "COMPLETED", "FAILED"]
CATEGORIES = [
    "food", "beverage", "cosmetic", "personal_care", "household", "electronics", "pharmaceutical", "agricultural", "other", "unknown",
]
COMPLAINT_REASONS = [
    "Missing mandatory declaration",
    "Incorrect MRP declaration",
    "Expired product on sale",
    "Incorrect net quantity",
    "Missing manufacturer information",
    "Missing country of origin",
    "Missing batch/lot number",
    "Missing date of manufacture/expiry",
    "Non-compliant labelling",
    "Misleading consumer information",
    "Other compliance concern",
]
LOCATION_SOURCES = ["GPS", "MANUAL"]
DETECTION_STATUSES = ["DETECTED", "REVIEW", "UNKNOWN"]
MAX_REASON, MAX_DESCRIPTION, MAX_ADDITIONAL_INFO = 200, 5000, 2000
PRIORITIES = ["LOW", "MEDIUM", "HIGH"]
# column, kind of rule, argument
PRODUCT_RULES = [
    ("user_id", "required", None),
    ("product_name", "required", None),
    ("mrp", "required", None),
    ("mrp", "min", 0),
    ("net_value", "required", None),
    ("net_value", "min", 0),
    ("net_unit", "required", None),
    ("compliance_status", "enum", COMPLIANCE_STATUSES),
    ("analysis_status", "enum", ANALYSIS_STATUSES),
    ("category", "enum", CATEGORIES),
    ("category_confidence", "min", 0),
    ("category_confidence", "max", 1),
    ("latitude", "min", -90),
    ("latitude", "max", 90),
    ("longitude", "min", -180),
    ("longitude", "max", 180),
    ("location_accuracy", "min", 0),
    ("location_source", "enum", LOCATION_SOURCES),
    ("category_detection_status", "enum", DETECTION_STATUSES),
]
# ---------------------------------------------------------------------------------------------


def broken(column: str, kind: str, argument) -> Column:
    value = F.col(column)
    if kind == "required":
        return value.isNull() | (F.trim(value.cast("string")) == "")
    test = {
        "min": lambda: value < argument,
        "max": lambda: value > argument,
        "enum": lambda: ~value.isin(argument),
        "maxlength": lambda: F.length(value) > argument,
        "minlength": lambda: F.length(value) < argument,
    }[kind]()
    return F.coalesce(test, F.lit(False))


def errors(rules) -> Column:
    """Map from column to its first broken rule."""
    first: dict[str, Column] = {}
    for column, kind, argument in rules:
        case = broken(column, kind, argument)
        first[column] = first[column].when(case, F.lit(kind)) if column in first else F.when(case, F.lit(kind))
    pairs = F.create_map(*[x for column, found in first.items() for x in (F.lit(column), found)])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def validate(df: DataFrame, rules) -> DataFrame:
    return df.withColumn("errors", errors(rules))


def good(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)


def error_text() -> Column:
    entries = F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.array_join(F.array_sort(entries), ",")


def location(df: DataFrame) -> DataFrame:
    """Coordinates as numbers, the first error, and an accuracy only where it makes sense."""
    lat, lng = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    acc = F.col("accuracy").try_cast("double")
    inside = lambda v, limit: F.coalesce(v.between(-limit, limit), F.lit(False))
    error = (
        F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), F.lit("coordinates required"))
        .when(~inside(lat, 90), F.lit("latitude out of range"))
        .when(~inside(lng, 180), F.lit("longitude out of range"))
        .when(~F.coalesce(F.col("source").isin(LOCATION_SOURCES), F.lit(False)), F.lit("unknown source"))
    )
    keep = lambda v: F.when(F.col("error").isNull(), v)
    return df.withColumn("error", error).select(
        "product_id", "error", keep(lat).alias("latitude"), keep(lng).alias("longitude"), keep(F.when(acc >= 0, acc)).alias("accuracy")
    )


def complaints(df: DataFrame) -> DataFrame:
    """First error in the order the checks are made, and the priority that applies."""
    filled = lambda name: F.coalesce(F.length(F.col(name)) > 0, F.lit(False))
    error = (
        F.when(F.col("product_id").isNull() | ~filled("reason") | ~filled("description"), F.lit("required fields missing"))
        .when(~F.col("reason").isin(COMPLAINT_REASONS), F.lit("unknown reason"))
        .when(F.length("description") < 20, F.lit("description too short"))
        .when(F.length(F.trim("reason")) > MAX_REASON, F.lit("reason too long"))
        .when(F.length(F.trim("description")) > MAX_DESCRIPTION, F.lit("description too long"))
        .when(F.length(F.trim("additional_info")) > MAX_ADDITIONAL_INFO, F.lit("additional information too long"))
    )
    priority = F.when(F.col("priority").isin(PRIORITIES), F.col("priority")).otherwise(F.lit("MEDIUM"))
    return df.withColumn("error", error).withColumn("priority", priority)


def detections(df: DataFrame, policy: str = "fail") -> DataFrame:
    """Detection contract. Under ``fail`` one bad row refuses its whole batch; under
    ``quarantine`` only the row itself."""
    text, confidence = F.col("text"), F.col("confidence")
    point_ok = lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    error = (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("text"))
        .when(confidence.isNull() | F.isnan(confidence) | (F.abs(confidence) == float("inf")), F.lit("confidence"))
        .when((F.size("bbox") != 4) | ~F.coalesce(F.forall("bbox", point_ok), F.lit(False)), F.lit("bbox"))
    )
    checked = df.withColumn("error", error)
    if policy == "quarantine":
        return checked.withColumn("accepted", F.col("error").isNull())
    bad = checked.filter(F.col("error").isNotNull()).select("batch_id").distinct().withColumn("bad_batch", F.lit(True))
    return checked.join(bad, "batch_id", "left").withColumn("accepted", F.col("bad_batch").isNull()).drop("bad_batch")


def check_is_valid() -> Column:
    """A check needs a rule id and one of the known statuses."""
    return F.coalesce((F.col("rule_id") != "") & F.col("status").isin(CHECK_STATUSES), F.lit(False))
