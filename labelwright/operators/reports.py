"""Per-product reports over check rows and product columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.evidence import plain_number


def report_summary(checks: DataFrame) -> DataFrame:
    """Counts and the lists of failed and open clauses; a product has at most one row per clause."""
    c = checks.filter(F.col("status") != "NOT_APPLICABLE")
    picked = lambda s: F.array_join(
        F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("clause_key")))), ","
    )
    return c.groupBy("product_id").agg(
        F.count("*").alias("total_checks"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "REVIEW").alias("review"),
        picked("FAIL").alias("violations"),
        picked("REVIEW").alias("reviews"),
    )


def or_not_detected(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), F.lit("Not detected")).otherwise(text)


def report_rows(products: DataFrame) -> DataFrame:
    """Display strings of the report's product section."""
    c = F.col
    price = F.when(c("mrp").isNotNull() & (c("mrp") != 0), F.concat(F.lit("₹"), plain_number(c("mrp"))))
    amount = F.when(
        c("net_value").isNotNull() & (c("net_value") != 0),
        F.concat(plain_number(c("net_value")), F.lit(" "), F.coalesce("net_unit", F.lit(""))),
    )
    category = F.when(F.coalesce("category", F.lit("")) == "", F.lit("Unknown")).otherwise(c("category"))
    na = lambda name: F.when(c(name).isNull() | (c(name) == ""), F.lit("N/A")).otherwise(c(name))
    return products.select(
        "product_id",
        or_not_detected(c("common_generic_name")).alias("product_name"),
        or_not_detected(c("brand_name")).alias("brand_name"),
        or_not_detected(c("manufacturer_name")).alias("manufacturer_name"),
        category.alias("category"),
        or_not_detected(c("country_of_origin")).alias("country_of_origin"),
        or_not_detected(price).alias("mrp"),
        or_not_detected(amount).alias("net_quantity"),
        or_not_detected(F.date_format("date_of_manufacture", "yyyy-MM-dd")).alias("date_of_manufacture"),
        or_not_detected(F.date_format("date_of_packing", "yyyy-MM-dd")).alias("date_of_packing"),
        or_not_detected(F.date_format("expiry_date", "yyyy-MM-dd")).alias("expiry_date"),
        or_not_detected(c("batch_lot_number")).alias("batch_lot_number"),
        F.concat(F.lit("Phone: "), na("care_phone"), F.lit(", Email: "), na("care_email")).alias("consumer_care"),
    )


def context_projection(checks: DataFrame, evidence_limit: int = 3) -> DataFrame:
    """Checks worth showing: nothing that does not apply, the first three evidence items of each."""
    return checks.filter(F.col("status") != "NOT_APPLICABLE").select(
        "product_id", "rule_number", "clause_key", "status", "reason_code",
        F.slice("evidence", 1, evidence_limit).alias("evidence"),
    )
