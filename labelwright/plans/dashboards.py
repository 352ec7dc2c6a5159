"""Dashboard, listing and map queries over every tenant's inspections."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.operators import dashboards as ops
from labelwright.operators import filters, paging
from labelwright.plans.catalog import query
from labelwright.sources.standins import spark_view

AS_OF = "2001-08-01"
_COUNTS = """count(*) AS total, count(*) FILTER (WHERE compliance_status = 'COMPLIANT') AS pass,
 count(*) FILTER (WHERE compliance_status = 'NON_COMPLIANT') AS fail,
 count(*) FILTER (WHERE compliance_status = 'REVIEW') AS review"""


def _inspections(spark, sf):
    return spark_view(spark, sf, "inspections")


@query("analytics_category", f"SELECT user_id, category, {_COUNTS} FROM @inspections GROUP BY 1, 2")
def analytics_category(spark, sf):
    return ops.by_category(_inspections(spark, sf))


@query("analytics_summary", f"""SELECT user_id, {_COUNTS},
 count(*) FILTER (WHERE compliance_status = 'PENDING') AS pending FROM @inspections GROUP BY 1""")
def analytics_summary(spark, sf):
    return ops.summary(_inspections(spark, sf))


@query("analytics_distribution", """
SELECT u.user_id, l.label AS status, count(i.product_id) AS n
FROM (SELECT DISTINCT user_id FROM @inspections) u
CROSS JOIN (VALUES ('COMPLIANT','PASS'),('NON_COMPLIANT','FAIL'),('REVIEW','REVIEW'),('PENDING','PENDING')) l(stored, label)
LEFT JOIN @inspections i ON i.user_id = u.user_id AND i.compliance_status = l.stored
GROUP BY 1, 2""")
def analytics_distribution(spark, sf):
    return ops.distribution(_inspections(spark, sf))


@query("analytics_trend", f"""SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, {_COUNTS}
 FROM @inspections GROUP BY 1, 2""")
def analytics_trend(spark, sf):
    return ops.daily_trend(_inspections(spark, sf))


@query("analytics_last_n_days", f"""SELECT user_id, category, {_COUNTS} FROM @inspections
 WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY 1, 2""")
def analytics_last_n_days(spark, sf):
    return ops.by_category(filters.since_days(_inspections(spark, sf), AS_OF, 90))


@query("trend_share", """
WITH t AS (SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total FROM @inspections GROUP BY 1, 2)
SELECT user_id, day, total, floor(total * 100.0::DOUBLE / max(total) OVER (PARTITION BY user_id) * 100 + 0.5) / 100 AS bar_pct,
 floor(total * 100.0::DOUBLE / sum(total) OVER (PARTITION BY user_id) * 10000 + 0.5) / 10000 AS total_pct FROM t""")
def trend_share(spark, sf):
    return ops.trend_share(ops.daily_trend(_inspections(spark, sf)))


@query("search_products", """
SELECT user_id, product_id, product_name, brand_name, manufacturer_name, batch_lot_number FROM @inspections_named
WHERE product_name ILIKE '%mach%' OR brand_name ILIKE '%mach%' OR manufacturer_name ILIKE '%mach%'
 OR batch_lot_number ILIKE '%mach%'""")
def search_products(spark, sf):
    columns = ["product_name", "brand_name", "manufacturer_name", "batch_lot_number"]
    found = filters.text_search(spark_view(spark, sf, "inspections_named"), "MaCh", columns)
    return found.select("user_id", "product_id", *columns)


@query("filter_status_alias", """
SELECT user_id, product_id, compliance_status, category FROM @inspections
WHERE compliance_status = 'NON_COMPLIANT' AND analysis_status = 'COMPLETED' AND category = 'beverage'""")
def filter_status_alias(spark, sf):
    rows = filters.list_filter(_inspections(spark, sf), "FAIL", "COMPLETED", "beverage")
    return rows.select("user_id", "product_id", "compliance_status", "category")


_MAP = """latitude IS NOT NULL AND compliance_status = 'REVIEW' AND created_at >= TIMESTAMP '1996-01-01'
 AND created_at <= TIMESTAMP '1999-12-31' AND (brand_name ILIKE '%furn%' OR manufacturer_name ILIKE '%furn%')"""


@query("map_filter", f"SELECT user_id, product_id, category, compliance_status FROM @inspections_named WHERE {_MAP}")
def map_filter(spark, sf):
    rows = filters.map_filter(
        spark_view(spark, sf, "inspections_named"), "REVIEW", None, "1996-01-01", "1999-12-31", " furn "
    )
    return rows.select("user_id", "product_id", "category", "compliance_status")


@query("map_markers", """
SELECT user_id, product_id, compliance_status, category, latitude, longitude, day FROM (
 SELECT user_id, product_id, compliance_status, category, latitude, longitude, strftime(created_at, '%Y-%m-%d') AS day,
  row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, product_id) AS position
 FROM @inspections WHERE latitude IS NOT NULL) WHERE position <= 500""")
def map_markers(spark, sf):
    rows = filters.map_filter(_inspections(spark, sf))
    page = paging.page_of_each(rows, "user_id", [F.desc("created_at"), F.col("product_id")], 1, 500)
    return page.select(
        "user_id", "product_id", "compliance_status", "category", "latitude", "longitude",
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
    )


@query("attention_areas", """
WITH g AS (SELECT user_id, CAST(floor(latitude / 0.05::DOUBLE + 0.5) AS BIGINT) AS cell_lat,
  CAST(floor(longitude / 0.05::DOUBLE + 0.5) AS BIGINT) AS cell_lng, count(*) AS n,
  count(*) FILTER (WHERE compliance_status = 'COMPLIANT') AS compliant,
  count(*) FILTER (WHERE compliance_status = 'NON_COMPLIANT') AS non_compliant,
  count(*) FILTER (WHERE compliance_status = 'REVIEW') AS review,
  count(*) FILTER (WHERE compliance_status = 'PENDING') AS pending,
  floor(avg(latitude) * 1e6 + 0.5) / 1e6 AS center_lat, floor(avg(longitude) * 1e6 + 0.5) / 1e6 AS center_lng
 FROM @inspections WHERE latitude IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, non_compliant + review AS score FROM g WHERE n >= 2 AND non_compliant + review >= 1),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, n DESC, cell_lat, cell_lng) AS INT)
  AS position FROM r)
SELECT * FROM o WHERE position <= 10""")
def attention_areas(spark, sf):
    return ops.attention_areas(_inspections(spark, sf))


@query("area_summary", """
SELECT user_id, count(*) FILTER (WHERE d) AS total,
 count(*) FILTER (WHERE d AND compliance_status = 'COMPLIANT') AS compliant,
 count(*) FILTER (WHERE d AND compliance_status = 'NON_COMPLIANT') AS non_compliant,
 count(*) FILTER (WHERE d AND compliance_status = 'REVIEW') AS review,
 count(*) FILTER (WHERE d AND compliance_status = 'PENDING') AS pending,
 count(latitude) AS all_time_located
FROM (SELECT *, created_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31' AS d FROM @inspections) GROUP BY 1""")
def area_summary(spark, sf):
    return ops.area_summary(_inspections(spark, sf), "1997-01-01", "1998-12-31")


@query("area_category", """
SELECT user_id, category, count(*) AS total, count(*) FILTER (WHERE compliance_status = 'NON_COMPLIANT') AS non_compliant,
 count(*) FILTER (WHERE compliance_status = 'REVIEW') AS review FROM @inspections GROUP BY 1, 2""")
def area_category(spark, sf):
    return ops.area_category(_inspections(spark, sf))


@query("products_page", """
SELECT user_id, position, product_id, compliance_status, mrp FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, product_id) AS INT) AS position
 FROM @inspections) WHERE position BETWEEN 21 AND 40""")
def products_page(spark, sf):
    page, limit = paging.clamp_page("2", "20")
    rows = paging.page_of_each(
        _inspections(spark, sf), "user_id", [F.desc("created_at"), F.col("product_id")], page, limit
    )
    return rows.select("user_id", "position", "product_id", "compliance_status", "mrp")


@query("page_meta", """
SELECT user_id, 2::BIGINT AS page, 20::BIGINT AS page_size, count(*) AS total,
 CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 2 < CAST(ceil(count(*) / 20.0) AS BIGINT) AS has_next,
 true AS has_previous FROM @inspections GROUP BY user_id""")
def page_meta(spark, sf):
    return paging.page_meta(_inspections(spark, sf), "user_id", 2, 20)


@query("histograms", """
SELECT 'category' AS facet, category AS bucket, count(*) AS n FROM @inspections GROUP BY 1, 2
UNION ALL SELECT 'compliance_status', compliance_status, count(*) FROM @inspections GROUP BY 1, 2
UNION ALL SELECT 'analysis_status', analysis_status, count(*) FROM @inspections GROUP BY 1, 2""")
def histograms(spark, sf):
    facets = ["category", "compliance_status", "analysis_status"]
    return (
        _inspections(spark, sf)
        .groupBy(*facets)
        .agg(F.count("*").alias("n"))
        .unpivot(["n"], facets, "facet", "bucket")
        .groupBy("facet", "bucket")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )
