"""Complaints, validation, projections and small text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import cleaning
from labelwright.operators import complaints as ops
from labelwright.operators import paging, validation
from labelwright.plans.catalog import query
from labelwright.sources.standins import define, spark_view


def _view(spark, sf, name):
    return spark_view(spark, sf, name)


def _required(c):
    return f"({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')"


_ERRORS = {
    "analysis_status": "CASE WHEN analysis_status NOT IN ('PENDING','PROCESSING','COMPLETED','FAILED') THEN 'enum' END",
    "category": "CASE WHEN category NOT IN (" + ", ".join(f"'{c}'" for c in validation.CATEGORIES) + ") THEN 'enum' END",
    "category_confidence": "CASE WHEN category_confidence < 0 THEN 'min' WHEN category_confidence > 1 THEN 'max' END",
    "compliance_status": "CASE WHEN compliance_status NOT IN ('PENDING','COMPLIANT','NON_COMPLIANT','REVIEW') THEN 'enum' END",
    "category_detection_status": "CASE WHEN category_detection_status NOT IN ('DETECTED','REVIEW','UNKNOWN') THEN 'enum' END",
    "latitude": "CASE WHEN latitude < -90 THEN 'min' WHEN latitude > 90 THEN 'max' END",
    "location_accuracy": "CASE WHEN location_accuracy < 0 THEN 'min' END",
    "location_source": "CASE WHEN location_source NOT IN ('GPS','MANUAL') THEN 'enum' END",
    "longitude": "CASE WHEN longitude < -180 THEN 'min' WHEN longitude > 180 THEN 'max' END",
    "mrp": f"CASE WHEN {_required('mrp')} THEN 'required' WHEN mrp < 0 THEN 'min' END",
    "net_unit": f"CASE WHEN {_required('net_unit')} THEN 'required' END",
    "net_value": f"CASE WHEN {_required('net_value')} THEN 'required' WHEN net_value < 0 THEN 'min' END",
    "product_name": f"CASE WHEN {_required('product_name')} THEN 'required' END",
    "user_id": f"CASE WHEN {_required('user_id')} THEN 'required' END",
}


@query("validate_products", "SELECT product_id, concat_ws(',', " + ", ".join(f"'{c}:' || {e}" for c, e in _ERRORS.items()) + ") AS errors FROM @raw_products")
def validate_products(spark, sf):
    rows = validation.validate(_view(spark, sf, "raw_products"), validation.PRODUCT_RULES)
    return rows.select("product_id", validation.error_text().alias("errors"))


@query("validate_location", """
SELECT product_id, error, CASE WHEN error IS NULL THEN lat END AS latitude, CASE WHEN error IS NULL THEN lng END AS longitude, CASE WHEN error IS NULL AND acc >= 0 THEN acc END AS accuracy FROM (
 SELECT *, CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'coordinates required' WHEN lat IS NULL OR NOT lat BETWEEN -90 AND 90 THEN 'latitude out of range'
  WHEN lng IS NULL OR NOT lng BETWEEN -180 AND 180 THEN 'longitude out of range' WHEN source IS NULL OR source NOT IN ('GPS', 'MANUAL') THEN 'unknown source' END AS error
 FROM (SELECT *, try_cast(latitude AS DOUBLE) AS lat, try_cast(longitude AS DOUBLE) AS lng, try_cast(accuracy AS DOUBLE) AS acc FROM @raw_locations))""")
def validate_location(spark, sf):
    return validation.location(_view(spark, sf, "raw_locations"))


@query("validate_complaints", f"""
SELECT complaint_id, CASE WHEN priority IN ('LOW','MEDIUM','HIGH') THEN priority ELSE 'MEDIUM' END AS priority,
 CASE WHEN reason IS NULL THEN 'required fields missing' WHEN reason NOT IN ({', '.join(f"'{r}'" for r in validation.COMPLAINT_REASONS)}) THEN 'unknown reason'
 WHEN length(description) < 20 THEN 'description too short' WHEN length(trim(reason)) > 200 THEN 'reason too long' WHEN length(trim(description)) > 5000 THEN 'description too long'
 WHEN length(trim(additional_info)) > 2000 THEN 'additional information too long' END AS error FROM @complaints""")
def validate_complaints(spark, sf):
    return validation.complaints(_view(spark, sf, "complaints")).select("complaint_id", "priority", "error")


@query("validate_detections", """
WITH e AS (SELECT *, CASE WHEN text = '' THEN 'text' WHEN confidence IS NULL THEN 'confidence' WHEN points <> 4 OR coord IS NULL THEN 'bbox' END AS error FROM @raw_detections)
SELECT batch_id, det_id, error, NOT bool_or(error IS NOT NULL) OVER (PARTITION BY batch_id) AS accepted FROM e""")
def validate_detections(spark, sf):
    rows = _view(spark, sf, "raw_detections").withColumn("bbox", F.array_repeat(F.array("coord", F.lit(1.0)), F.col("points")))
    return validation.detections(rows).select("batch_id", "det_id", "error", "accepted")


@query("complaint_ownership", """
SELECT c.complaint_id, c.user_id, c.product_id, p.product_id IS NOT NULL AS accepted FROM @complaints c
LEFT JOIN @inspections p ON p.product_id = c.product_id AND p.user_id = c.user_id""")
def complaint_ownership(spark, sf):
    rows = ops.owned(_view(spark, sf, "complaints"), _view(spark, sf, "inspections"))
    return rows.select("complaint_id", "user_id", "product_id", "accepted")


def _with_images(spark, sf):
    listed = F.when(F.col("image_list") != "", F.split("image_list", "\\|")).otherwise(F.array().cast("array<string>"))
    return _view(spark, sf, "inspection_images").withColumn("images", listed)


_LAST = "CASE WHEN image_list = '' THEN NULL ELSE split_part(image_list, '|', -1) END"


@query("complaint_snapshot", f"""
SELECT c.complaint_id, p.category, p.mrp, p.batch_lot_number, p.compliance_status, p.analysis_status, {_LAST} AS image_url FROM @complaints c
JOIN @inspection_images p ON p.product_id = c.product_id AND p.user_id = c.user_id""")
def complaint_snapshot(spark, sf):
    return ops.snapshots(_view(spark, sf, "complaints"), _with_images(spark, sf)).select("complaint_id", "snapshot.*")


@query("latest_image", f"SELECT product_id, {_LAST} AS image_url FROM @inspection_images")
def latest_image(spark, sf):
    return _with_images(spark, sf).select("product_id", ops.latest(F.col("images")).alias("image_url"))


@query("project_slim", """SELECT product_id, user_id, category, 'scan-' || product_id AS ocr_engine, CASE WHEN image_list = '' THEN 0 ELSE length(image_list) - length(replace(image_list, '|', '')) + 1 END::INT AS image_count
FROM @inspection_images""")
def project_slim(spark, sf):
    """Listing without the heavy nested fields: only the light part of the struct survives."""
    heavy = _with_images(spark, sf).withColumn(
        "ocr", F.struct(F.concat(F.lit("scan-"), F.col("product_id").cast("string")).alias("engine"), F.col("images").alias("results"), F.col("image_list").alias("text"))
    )
    slim = heavy.withColumn("ocr", F.col("ocr").dropFields("results", "text"))
    return slim.select("product_id", "user_id", "category", F.col("ocr.engine").alias("ocr_engine"), F.size("images").alias("image_count"))


_STEPS = "('SUBMITTED>UNDER_REVIEW', 'SUBMITTED>REJECTED', 'UNDER_REVIEW>RESOLVED', 'UNDER_REVIEW>REJECTED')"


@query("complaint_transitions", f"""
WITH l AS (SELECT *, lag(status) OVER w AS from_status, lag(changed_at) OVER w AS since FROM @complaint_events WINDOW w AS (PARTITION BY complaint_id ORDER BY changed_at, seq))
SELECT complaint_id, seq, from_status, status AS to_status, epoch(changed_at - since) / 3600.0 AS hours,
 CASE WHEN from_status IS NULL THEN status = 'SUBMITTED' ELSE from_status || '>' || status IN {_STEPS} END AS legal FROM l""")
def complaint_transitions(spark, sf):
    return ops.transitions(_view(spark, sf, "complaint_events"))


_CURRENT = """SELECT complaint_id, arg_max(status, (changed_at, seq)) AS status, strftime(max(changed_at), '%Y-%m-%d') AS changed_on,
 strftime(max(changed_at) FILTER (WHERE status IN ('RESOLVED', 'REJECTED')), '%Y-%m-%d') AS resolved_on, count(*) AS changes FROM @complaint_events GROUP BY 1"""


@query("complaint_current", _CURRENT)
def complaint_current(spark, sf):
    rows = ops.current(_view(spark, sf, "complaint_events"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("complaint_id", "status", day("changed_at").alias("changed_on"), day("resolved_at").alias("resolved_on"), "changes")


@query("complaint_numbers", """
SELECT complaint_id, 'CMP-' || strftime(submitted_at, '%Y') || '-' || CASE WHEN n < 1000000 THEN lpad(n::VARCHAR, 6, '0') ELSE n::VARCHAR END AS complaint_number
FROM (SELECT *, 41 + row_number() OVER (ORDER BY submitted_at, complaint_id) AS n FROM @complaints)""")
def complaint_numbers(spark, sf):
    rows = ops.with_numbers(_view(spark, sf, "complaints").select("complaint_id", "submitted_at"), last_used=41)
    return rows.select("complaint_id", "complaint_number")


@query("complaints_page", """
SELECT user_id, position, complaint_id, status FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, complaint_id) AS INT) AS position
 FROM @complaints WHERE status = 'UNDER_REVIEW') WHERE position BETWEEN 51 AND 100""")
def complaints_page(spark, sf):
    page, limit = paging.clamp_page("2", "500", most=50)
    wanted = "UNDER_REVIEW"
    rows = _view(spark, sf, "complaints")
    if wanted in ops.STATUSES:
        rows = rows.filter(F.col("status") == wanted)
    rows = paging.page_of_each(rows, "user_id", [F.desc("submitted_at"), F.col("complaint_id")], page, limit)
    return rows.select("user_id", "position", "complaint_id", "status")


define("nutrition_scans", "SELECT p_partkey AS scan_id, p_partkey % 20 AS user_id, date '2024-01-01' + cast(p_partkey % 90 AS int) AS scanned_on, p_name AS label FROM @part")


@query("scans_page", """
SELECT user_id, position, scan_id, label FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY scanned_on DESC, scan_id) AS INT) AS position FROM @nutrition_scans)
WHERE position <= 20""")
def scans_page(spark, sf):
    page, limit = paging.clamp_page(None, None, most=50)
    rows = paging.page_of_each(_view(spark, sf, "nutrition_scans"), "user_id", [F.desc("scanned_on"), F.col("scan_id")], page, limit)
    return rows.select("user_id", "position", "scan_id", "label")


@query("sanitize_text", """
SELECT conv_id, turn, CASE WHEN regexp_matches(left(trim(role || '/' || conv_id), 64), '^[a-zA-Z0-9_/-]{1,64}$') THEN left(trim(role || '/' || conv_id), 64) END AS page,
 nullif(left(regexp_replace(trim(text), '[\\x00-\\x1f\\x7f]', ' ', 'g'), 300), '') AS summary FROM @conversations""")
def sanitize_text(spark, sf):
    rows = _view(spark, sf, "conversations")
    name = F.concat(F.col("role"), F.lit("/"), F.col("conv_id").cast("string"))
    return rows.select("conv_id", "turn", cleaning.page_name(name).alias("page"), cleaning.summary(F.col("text")).alias("summary"))


define("raw_days", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2026-07-01' WHEN 1 THEN 'yesterday' WHEN 2 THEN NULL WHEN 3 THEN '2026-07-01 23:15:00' ELSE '2027-02-28' END AS raw, cast(ts AS timestamp) AS ts FROM @events""")


@query("normalize_day", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2026-07-01' WHEN 3 THEN '2026-07-01' WHEN 4 THEN '2027-02-28' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM @raw_days")
def normalize_day(spark, sf):
    return _view(spark, sf, "raw_days").select("event_id", cleaning.iso_day(F.col("raw"), F.col("ts")).alias("day"))


define("stage_runs", """
SELECT l_orderkey AS run_id, CASE l_linenumber WHEN 1 THEN 'ocr' WHEN 2 THEN 'extraction' WHEN 3 THEN 'evidence' WHEN 4 THEN 'category' WHEN 5 THEN 'rules' ELSE 'save' END AS stage,
 cast(l_quantity AS double) AS duration_ms FROM @lineitem""")


@query("stage_timings", """
SELECT stage, count(*) AS runs, sum(duration_ms) AS total_ms, floor(avg(duration_ms) * 1e4 + 0.5) / 1e4 AS avg_ms, max(duration_ms) AS max_ms,
 floor(sum(duration_ms) * 100 / (SELECT sum(duration_ms) FROM @stage_runs) * 100 + 0.5) / 100 AS share_pct FROM (SELECT stage, duration_ms FROM @stage_runs UNION ALL
 SELECT 'TOTAL', sum(duration_ms) FROM @stage_runs GROUP BY run_id) GROUP BY 1""")
def stage_timings(spark, sf):
    """Time per stage and for whole runs, with the share of all time."""
    from labelwright.operators.audit import stage_timings as op

    return op(_view(spark, sf, "stage_runs"))
