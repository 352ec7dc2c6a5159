"""Text-box queries: reading labels of every image."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import geometry as G
from labelwright.functions import patterns as P
from labelwright.functions import text as T
from labelwright.functions.rounding import half_up
from labelwright.operators import boxes as ops
from labelwright.plans.catalog import query
from labelwright.sources.standins import define, spark_view


def _view(name):
    return lambda spark, sf: spark_view(spark, sf, name)


detections = _view("detections")

define("label_values", """
SELECT 'p' || cast(p_partkey AS string) AS image_id, f.field, f.value, f.evidence, f.x0, f.y0, f.x1, f.y1 FROM (
 SELECT p_partkey, 'mrp' AS field, printf('%.2f', p_retailprice) AS value, 'MRP' AS evidence, cast(NULL AS double) AS x0,
  cast(NULL AS double) AS y0, cast(NULL AS double) AS x1, cast(NULL AS double) AS y1 FROM @part
 UNION ALL SELECT p_partkey, 'netQuantity', cast(p_size AS string), 'net q', cast(NULL AS double), cast(NULL AS double), cast(NULL AS double), cast(NULL AS double) FROM @part
 UNION ALL SELECT p_partkey, 'manufacturerName', p_brand, 'no such text', cast(NULL AS double), cast(NULL AS double), cast(NULL AS double), cast(NULL AS double) FROM @part
 UNION ALL SELECT p_partkey, 'batchLotNumber', 'B' || cast(p_partkey AS string), '', cast(5 AS double), cast(80 AS double),
  cast(105 AS double), cast(95 AS double) FROM @part) f""")
define("panels", """
SELECT 'p' || cast(p_partkey AS string) AS image_id, cast(0 AS double) AS x0, cast(0 AS double) AS y0, cast(80 + p_partkey % 90 AS double) AS x1,
 cast(60 + p_partkey % 9 * 20 AS double) AS y1, cast(p_partkey % 100 AS double) / 100 AS confidence FROM @part""")
define("calibrations", """
SELECT 'p' || cast(p_partkey AS string) AS image_id, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'NONE' ELSE 'reference' END AS method,
 CASE WHEN p_partkey % 8 = 3 THEN cast(0 AS double) ELSE cast(p_size AS double) END AS known_size,
 CASE WHEN p_partkey % 11 = 4 THEN 'furlong' ELSE 'mm' END AS known_unit, cast(100 AS double) AS pixel_size,
 cast(p_partkey % 4 AS double) AS uncertainty, cast(1 AS double) AS calibration_confidence, p_partkey % 10 = 7 AS rotated,
 CASE WHEN p_partkey % 2 = 0 THEN 'card' ELSE 'coin' END AS calibration_source FROM @part""")

_GEO = "(x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(8, least(abs(y1 - y0), abs(x1 - x0))) AS font"
_D = f"d AS (SELECT *, {_GEO} FROM @detections)"
_DIST = "sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)"


@query("line_reconstruct", """
WITH o AS (SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 AS h FROM @detections),
 l AS (SELECT *, lag(cy) OVER w AS pcy, lag(h) OVER w AS ph FROM o WINDOW w AS (PARTITION BY image_id ORDER BY cy, det_id)),
 n AS (SELECT *, sum(CASE WHEN abs(cy - pcy) < (h + ph) / 2 * 0.5 THEN 0 ELSE 1 END)
   OVER (PARTITION BY image_id ORDER BY cy, det_id ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM l)
SELECT image_id, line_no, string_agg(text, ' ' ORDER BY x0, cy, det_id) AS text, floor(avg(confidence) * 1e6 + 0.5) / 1e6 AS confidence,
 max(h) AS height, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM n GROUP BY 1, 2""")
def line_reconstruct(spark, sf):
    return ops.reconstruct_lines(detections(spark, sf))


@query("prominent_text", f"""
WITH {_D}, h AS (SELECT *, abs(y1 - y0) AS h FROM d),
 r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY font) AS rf, row_number() OVER (PARTITION BY image_id ORDER BY h) AS rh,
  count(*) OVER (PARTITION BY image_id) AS n FROM h),
 m AS (SELECT image_id, max(font) FILTER (WHERE rf = (n - 1) // 2 + 1) AS font_median, max(h) FILTER (WHERE rh = n // 2 + 1) AS height_median
  FROM r GROUP BY 1)
SELECT h.image_id, det_id, font, font_median, height_median, font > font_median * 1.2 AS larger, font > font_median * 1.5 AS much_larger,
 h > height_median * 1.5 AS prominent FROM h JOIN m USING (image_id)""")
def prominent_text(spark, sf):
    return ops.prominence(detections(spark, sf))


@query("nearby_nodes", f"""
WITH {_D}, a AS (SELECT * FROM d WHERE regexp_matches(upper(text), '{"|".join(P.LEGAL_KEYWORDS)}')),
 p AS (SELECT a.image_id, a.det_id, b.text, {_DIST} AS dist, b.det_id AS other FROM a JOIN d b ON a.image_id = b.image_id AND a.det_id <> b.det_id
  WHERE {_DIST} > 0 AND {_DIST} < a.font * 6)
SELECT image_id, det_id, string_agg(text, '|' ORDER BY dist, other) AS nearby, count(*) AS n FROM p GROUP BY 1, 2""")
def nearby_nodes(spark, sf):
    d = detections(spark, sf)
    anchors = d.filter(F.upper("text").rlike("|".join(P.LEGAL_KEYWORDS)))
    return ops.nearby_text(anchors, d).withColumn("nearby", F.array_join("nearby", "|"))


# DuckDB side of the readers
def _sq(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def _match(text, pattern):
    return f"regexp_matches({text}, {_sq('(?i)' + pattern)})"


def _groups(text, pattern, n):
    return "(" + " || ".join(f"regexp_extract({text}, {_sq('(?i)' + pattern)}, {i + 1})" for i in range(n)) + ")"


def _tail(text, label):
    return f"trim(regexp_extract({text}, {_sq('(?is)^.*?(?:' + label + ')(.*)$')}, 1))"


def _num(text):
    return f"try_cast(replace({text}, ',', '') AS DOUBLE)"


def _duck_price(t):
    g = _groups(t, P.MONEY, 3)
    return f"CASE WHEN {g} <> '' AND NOT {_match(g, P.REJECT_PRICE)} AND {_num(g)} > 0 THEN {g} END"


def _duck_quantity(t):
    v, u = (f"regexp_extract({t}, {_sq('(?i)' + P.NET_QTY_VALUE)}, {i})" for i in (1, 2))
    return (
        f"CASE WHEN {v} <> '' AND NOT {_match(v, P.REJECT_NUMBER)} AND {_num(v)} >= 0 THEN {v} || ' ' || "
        f"CASE WHEN lower({u}) IN ('litre', 'liter') THEN 'l' ELSE lower({u}) END END"
    )


def _duck_plausible(c):
    digits = f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
    return (
        f"(length({c}) BETWEEN 2 AND 20 AND NOT {_match(c, P.BATCH_PROSE)} AND NOT {_match(c, P.BATCH_QUANTITY)} AND NOT {_match(c, P.BATCH_PHONE)}"
        f" AND {digits} > 0 AND (regexp_matches({c}, '[A-Za-z]') OR {digits} >= 4))"
    )


def _duck_batch(t, whole):
    raw = f"regexp_extract({t}, {_sq('(?i)' + P.BATCH_VALUE)}, 1)"
    code = f"trim(regexp_replace({raw}, '\\.+$', ''))"
    return (
        f"CASE WHEN {raw} <> '' THEN CASE WHEN {_match(t, P.SEE_ELSEWHERE)} OR {_match(whole, P.SEE_ELSEWHERE)} THEN 'REVIEW' "
        f"WHEN {_duck_plausible(code)} THEN {code} END END"
    )


def _duck_contact(t, whole):
    em = lambda x: f"nullif(regexp_extract({x}, {_sq(P.EMAIL)}), '')"
    ph = lambda x: f"nullif(regexp_extract({x}, {_sq(P.PHONE)}), '')"
    return f"nullif(concat_ws(' ', coalesce({em(t)}, {em(whole)}), coalesce({ph(t)}, {ph(whole)})), '')"


_FIELD_READERS = {
    "mrp": lambda t, w: _duck_price(t),
    "netQuantity": lambda t, w: _duck_quantity(t),
    "batchLotNumber": _duck_batch,
    "consumerCareDetails": _duck_contact,
}


def _labelled_sql(fields):
    reader = lambda t, w: "CASE field " + " ".join(f"WHEN '{f}' THEN {_FIELD_READERS[f](t, w)}" for f in fields) + " END"
    anchors = " UNION ALL ".join(
        f"SELECT *, '{f}' AS field, {_tail('text', ops.FIELDS[f])} AS rest FROM d WHERE {_match('text', ops.FIELDS[f])}" for f in fields
    )
    return f"""WITH {_D}, a0 AS ({anchors}), a AS (SELECT *, {reader('rest', 'text')} AS own FROM a0),
 n0 AS (SELECT a.image_id, a.field, a.det_id AS anchor, a.font, a.confidence AS ac, {_DIST} AS dist, b.det_id AS first, b.text, b.confidence AS bc,
   b.cx, b.cy FROM a JOIN d b ON a.image_id = b.image_id AND a.det_id <> b.det_id WHERE own IS NULL AND {_DIST} > 0 AND {_DIST} < a.font * 6),
 n AS (SELECT *, {reader('text', 'text')} AS direct FROM n0),
 m0 AS (SELECT a.*, {_DIST} AS hop, b.det_id AS second, a.text || ' ' || b.text AS joined, b.confidence AS cc FROM n a JOIN d b
   ON a.image_id = b.image_id AND b.det_id <> a.anchor AND b.det_id <> a.first WHERE direct IS NULL AND {_DIST} > 0 AND {_DIST} < a.font * 8),
 m AS (SELECT *, {reader('joined', 'joined')} AS val FROM m0),
 c AS (SELECT image_id, field, 0.0::DOUBLE AS dist, det_id AS anchor, -1 AS first, 0.0::DOUBLE AS hop, NULL::BIGINT AS second, own AS value,
   confidence AS conf FROM a WHERE own IS NOT NULL
  UNION ALL SELECT image_id, field, dist, anchor, first, 0.0, NULL, direct, (ac + bc) / 2 FROM n WHERE direct IS NOT NULL
  UNION ALL SELECT image_id, field, dist, anchor, first, hop, second, val, (ac + bc + cc) / 3 FROM m WHERE val IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY image_id, field ORDER BY dist, anchor, first, hop, second) AS rn FROM c)
 SELECT image_id, field, value, anchor AS anchor_det, floor(dist * 1e6 + 0.5) / 1e6 AS dist, floor(conf * 1e6 + 0.5) / 1e6 AS confidence,
  CASE WHEN dist = 0 THEN 'EXPLICIT_LABEL' ELSE 'SPATIAL_ASSOCIATION' END AS source_type FROM r WHERE rn = 1"""


_SQL_FIELDS = tuple(_FIELD_READERS)


@query("label_value_join", _labelled_sql(_SQL_FIELDS))
def label_value_join(spark, sf):
    return ops.labelled_values(detections(spark, sf), _SQL_FIELDS)


@query("label_dates")
def label_dates(spark, sf):
    """Dates next to their labels; their readers need look-behind, so no SQL twin."""
    return ops.labelled_values(detections(spark, sf), tuple(P.DATE_LABELS))


_SPLIT_UNIT = r"net\s+qua[a-z]+\s+[0-9]+\s*(?:g|kg|ml|l)\b"


@query("token_rejoin", f"""
WITH {_D}, p AS (SELECT a.image_id, a.det_id, b.det_id AS other, {_DIST} AS dist, a.text || ' ' || b.text AS f, b.text || ' ' || a.text AS r
  FROM d a JOIN d b ON a.image_id = b.image_id AND a.det_id <> b.det_id WHERE {_DIST} > 0 AND {_DIST} < a.font * 6 AND {_match('a.text', 'net')}),
 h AS (SELECT *, CASE WHEN {_match('f', _SPLIT_UNIT)} THEN f WHEN {_match('r', _SPLIT_UNIT)} THEN r END AS j FROM p)
SELECT image_id, det_id, arg_min(other, (dist, other)) AS other_det, arg_min(j, (dist, other)) AS text FROM h WHERE j IS NOT NULL GROUP BY 1, 2""")
def token_rejoin(spark, sf):
    d = detections(spark, sf)
    return ops.rejoin_tokens(d.filter(T.hits(F.col("text"), "net")), d, _SPLIT_UNIT)


define("region_boxes", """
SELECT image_id, det_id, CASE WHEN det_id % 3 = 0 THEN text || '!' WHEN det_id % 3 = 1 THEN text || ' x' ELSE 'other' END AS text, confidence,
 x0 + 2 AS x0, y0 + 1 AS y0, x1 + 2 AS x1, y1 + 1 AS y1 FROM @detections WHERE det_id % 3 <> 2 OR det_id % 2 = 0""")
_LET = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


@query("fuse_detections", f"""
WITH f AS (SELECT * FROM @detections), r AS (SELECT * FROM @region_boxes)
SELECT image_id, det_id, text, 'roi' AS source FROM r UNION ALL
SELECT image_id, det_id, text, 'full' FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.image_id = f.image_id
 AND (f.x0 + f.x1) / 2 BETWEEN r.x0 - 5 AND r.x1 + 5 AND (f.y0 + f.y1) / 2 BETWEEN r.y0 - 5 AND r.y1 + 5
 AND {_LET('f.text')} <> '' AND {_LET('r.text')} <> '' AND (contains({_LET('f.text')}, {_LET('r.text')}) OR contains({_LET('r.text')}, {_LET('f.text')})))""")
def fuse_detections(spark, sf):
    out = ops.fuse(detections(spark, sf), spark_view(spark, sf, "region_boxes"))
    return out.select("image_id", "det_id", "text", "source")


define("image_views", """
SELECT 'p' || cast(p_partkey AS string) AS image_id, CASE p_partkey % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'declaration' END AS view FROM @part""")
define("image_regions", """
SELECT 'p' || cast(l_partkey AS string) AS image_id, l_orderkey * 10 + l_linenumber AS region_id,
 CASE l_linenumber % 3 WHEN 0 THEN 'principal_display_panel' WHEN 1 THEN 'declaration_panel' ELSE 'barcode' END AS class_name FROM @lineitem""")


@query("roi_select", """
WITH c AS (SELECT v.image_id, v.view, r.class_name, r.region_id FROM @image_views v JOIN @image_regions r USING (image_id)
 WHERE r.class_name = CASE WHEN v.view = 'front' THEN 'principal_display_panel' ELSE 'declaration_panel' END)
SELECT * FROM c UNION ALL SELECT image_id, view, 'full_image', NULL FROM @image_views WHERE image_id NOT IN (SELECT image_id FROM c)""")
def roi_select(spark, sf):
    return ops.select_regions(spark_view(spark, sf, "image_regions"), spark_view(spark, sf, "image_views"))


_FIRST = """(SELECT arg_min({{'x0': d.x0, 'y0': d.y0, 'x1': d.x1, 'y1': d.y1, 'id': d.det_id, 't': d.text}}, d.det_id) FROM @label_boxes d
 WHERE d.image_id = v.image_id AND {0} <> '' AND contains(lower(d.text), lower({0})))"""


@query("panel_overlap", f"""
WITH l AS (SELECT v.*, CASE WHEN x0 IS NULL THEN {_FIRST.format('v.evidence')} END AS e, CASE WHEN x0 IS NULL THEN {_FIRST.format('v.value')} END AS h FROM @label_values v),
 b AS (SELECT image_id, field, coalesce(x0, e.x0, h.x0) AS x0, coalesce(y0, e.y0, h.y0) AS y0, coalesce(x1, e.x1, h.x1) AS x1, coalesce(y1, e.y1, h.y1) AS y1 FROM l),
 o AS (SELECT b.*, greatest(0, least(b.x1, p.x1) - greatest(b.x0, p.x0)) * greatest(0, least(b.y1, p.y1) - greatest(b.y0, p.y0))
   / ((b.x1 - b.x0) * (b.y1 - b.y0)) AS ratio FROM b JOIN @panels p ON p.image_id = b.image_id)
SELECT image_id, field, floor(CASE WHEN x0 IS NULL THEN NULL ELSE ratio END * 1e6 + 0.5) / 1e6 AS overlap, CASE WHEN x0 IS NULL THEN 'UNKNOWN' WHEN ratio > 0.9 THEN 'INSIDE'
 WHEN ratio > 0.1 THEN 'PARTIAL' ELSE 'OUTSIDE' END AS relation FROM o""")
def panel_overlap(spark, sf):
    return ops.panel_relation(
        spark_view(spark, sf, "label_values"), spark_view(spark, sf, "panels"), spark_view(spark, sf, "label_boxes")
    )


@query("evidence_trace", f"""
SELECT image_id, field, h.id AS det_id, h.t AS text FROM (SELECT v.image_id, v.field, {_FIRST.format('v.value')} AS h FROM @label_values v) WHERE h IS NOT NULL""")
def evidence_trace(spark, sf):
    hit = ops.first_box_with(spark_view(spark, sf, "label_values"), spark_view(spark, sf, "label_boxes"), F.col("value"))
    return hit.select("image_id", "field", "hit.det_id", "hit.text")


@query("measurements", f"""
WITH m AS (SELECT * FROM (SELECT v.image_id, v.field, {_FIRST.format('v.value')} AS h FROM @label_values v) WHERE h IS NOT NULL),
 s AS (SELECT m.image_id, field, h.x1 - h.x0 AS pixel_width, h.y1 - h.y0 AS pixel_height, c.*, CASE WHEN rotated THEN 'UNCERTAIN'
  WHEN method IS NULL OR method = 'NONE' THEN 'UNCALIBRATED' WHEN NOT (known_size > 0 AND known_unit = 'mm') THEN 'UNCERTAIN'
  WHEN uncertainty / known_size >= 0.5 THEN 'UNCERTAIN' ELSE 'CALIBRATED' END AS status FROM m JOIN @calibrations c ON c.image_id = m.image_id),
 k AS (SELECT *, CASE WHEN status = 'CALIBRATED' THEN known_size / pixel_size END AS scale FROM s)
SELECT image_id, field, pixel_width, pixel_height, floor(pixel_height * scale * 1e6 + 0.5) / 1e6 AS physical_height,
 floor(pixel_width * scale * 1e6 + 0.5) / 1e6 AS physical_width,
 CASE WHEN scale IS NOT NULL THEN floor(pixel_height * scale * uncertainty / known_size * 1e6 + 0.5) / 1e6 END AS uncertainty,
 CASE WHEN scale IS NULL THEN 'NONE' ELSE known_unit END AS unit, status,
 CASE WHEN method IS NULL OR method = 'NONE' THEN 'UNKNOWN' WHEN calibration_source = 'card' THEN 'TRUSTED' ELSE 'UNTRUSTED' END AS calibration_trust FROM k""")
def measurements(spark, sf):
    v = lambda n: spark_view(spark, sf, n)
    return ops.measurements(v("label_values"), v("label_boxes"), v("calibrations"), trusted=["card"])


@query("bbox_union", """SELECT image_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
 floor(coalesce(avg(confidence), 1.0) * 1e6 + 0.5) / 1e6 AS confidence FROM @detections GROUP BY 1""")
def bbox_union(spark, sf):
    d = detections(spark, sf)
    points = d.select("image_id", "confidence", G.enclosing(G.quad(G.box())).alias("b"))
    return ops.union_boxes(points.select("image_id", "confidence", "b.*"))


_SIZE = "s AS (SELECT image_id, ceil(max(x1) * 1.1::DOUBLE) AS img_w, ceil(max(y1) * 1.1::DOUBLE) AS img_h FROM @detections GROUP BY 1)"


@query("region_flag", f"""WITH {_SIZE} SELECT d.image_id, d.det_id, img_h, y0 >= img_h * 0.65::DOUBLE AS declaration_region
 FROM @detections d JOIN s USING (image_id)""")
def region_flag(spark, sf):
    return ops.region_flags(detections(spark, sf))


@query("weak_candidates", f"""
WITH {_SIZE}, h AS (SELECT image_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(confidence) AS confidence, count(*) AS hits
  FROM @detections WHERE regexp_matches(upper(text), '{"|".join(P.LEGAL_KEYWORDS)}') GROUP BY 1),
 p AS (SELECT h.image_id, confidence, hits, img_w, img_h, greatest(0, least(x0 - img_w * 0.05::DOUBLE, img_w)) AS a, greatest(0, least(y0 - img_h * 0.05::DOUBLE, img_h)) AS b,
  greatest(0, least(x1 + img_w * 0.05::DOUBLE, img_w)) AS c, greatest(0, least(y1 + img_h * 0.05::DOUBLE, img_h)) AS d FROM h JOIN s USING (image_id))
SELECT image_id, floor((a + (c - a) / 2) / img_w * 1e6 + 0.5) / 1e6 AS cx, floor((b + (d - b) / 2) / img_h * 1e6 + 0.5) / 1e6 AS cy,
 floor((c - a) / img_w * 1e6 + 0.5) / 1e6 AS w, floor((d - b) / img_h * 1e6 + 0.5) / 1e6 AS h, floor(confidence * 1e6 + 0.5) / 1e6 AS confidence, hits
FROM p WHERE c > a AND d > b""")
def weak_candidates(spark, sf):
    return ops.weak_candidates(detections(spark, sf))


define("norm_boxes", """
SELECT doc_id AS box_id, cast(doc_id % 121 AS double) / 100 - 0.1 AS cx, cast(doc_id % 103 AS double) / 100 AS cy,
 cast(doc_id % 37 AS double) / 40 AS w, cast(doc_id % 23 AS double) / 20 AS h, cast(600 + n_chars % 400 AS double) AS img_w, cast(800 AS double) AS img_h,
 CASE doc_id % 3 WHEN 0 THEN 'VALIDATION' ELSE 'TRAINING' END AS role FROM @documents""")


@query("bbox_transform", """
WITH t AS (SELECT box_id, (cx + 0.1::DOUBLE) * 1.2::DOUBLE AS tx, (cy + -0.05::DOUBLE) * 0.9::DOUBLE AS ty, w * 1.2::DOUBLE AS tw, h * 0.9::DOUBLE AS th
  FROM @norm_boxes WHERE role = 'TRAINING'),
 e AS (SELECT *, greatest(0, tx - tw / 2) AS x0, greatest(0, ty - th / 2) AS y0, least(1, tx + tw / 2) AS x1, least(1, ty + th / 2) AS y1 FROM t),
 k AS (SELECT *, tx BETWEEN 0 AND 1 AND ty BETWEEN 0 AND 1 AND x1 > x0 AND y1 > y0 AS ok FROM e)
SELECT box_id, ok AS kept, CASE WHEN ok THEN floor((x0 + (x1 - x0) / 2) * 1e6 + 0.5) / 1e6 END AS cx, CASE WHEN ok THEN floor((y0 + (y1 - y0) / 2) * 1e6 + 0.5) / 1e6 END AS cy,
 CASE WHEN ok THEN floor((x1 - x0) * 1e6 + 0.5) / 1e6 END AS w, CASE WHEN ok THEN floor((y1 - y0) * 1e6 + 0.5) / 1e6 END AS h FROM k""")
def bbox_transform(spark, sf):
    b = spark_view(spark, sf, "norm_boxes").filter(F.col("role") == "TRAINING")
    c = F.col
    moved = b.select("box_id", G.transformed(c("cx"), c("cy"), c("w"), c("h"), (0.1, -0.05), (1.2, 0.9)).alias("n"))
    return moved.select(
        "box_id", c("n").isNotNull().alias("kept"), *[half_up(c(f"n.{x}"), 6).alias(x) for x in ("cx", "cy", "w", "h")]
    )


@query("bbox_reproject", """
WITH e AS (SELECT box_id, img_w, img_h, greatest(0, least(floor(cx * img_w - w * img_w / 2 + 0.5), img_w)) AS x0, greatest(0, least(floor(cx * img_w + w * img_w / 2 + 0.5), img_w)) AS x1,
  greatest(0, least(floor(cy * img_h - h * img_h / 2 + 0.5), img_h)) AS y0, greatest(0, least(floor(cy * img_h + h * img_h / 2 + 0.5), img_h)) AS y1 FROM @norm_boxes)
SELECT box_id, x0 AS crop_x0, y0 AS crop_y0, x1 - x0 AS crop_w, y1 - y0 AS crop_h, x0 + 10 AS point_x, y0 + 7 AS point_y FROM e WHERE x1 > x0 AND y1 > y0""")
def bbox_reproject(spark, sf):
    """Crop rectangles, and a quad read inside the crop moved back to image coordinates."""
    b = spark_view(spark, sf, "norm_boxes")
    c = F.col
    crop = G.crop_pixels(c("cx"), c("cy"), c("w"), c("h"), c("img_w"), c("img_h"))
    inside = F.array(F.array(F.lit(10.0), F.lit(7.0)), F.array(F.lit(20.0), F.lit(9.0)))
    rows = b.withColumn("c", crop).filter(c("c").isNotNull())
    moved = F.transform(inside, lambda p: F.array(p[0] + c("c.x0"), p[1] + c("c.y0")))
    return rows.withColumn("q", moved).select(
        "box_id", c("c.x0").alias("crop_x0"), c("c.y0").alias("crop_y0"), (c("c.x1") - c("c.x0")).alias("crop_w"),
        (c("c.y1") - c("c.y0")).alias("crop_h"), c("q")[0][0].alias("point_x"), c("q")[0][1].alias("point_y"),
    )
