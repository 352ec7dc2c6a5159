"""Token readers, implicit values and evidence merging over every box."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.functions import text as T
from labelwright.operators import boxes as B
from labelwright.operators import fields as ops
from labelwright.plans.catalog import query
from labelwright.plans.labels import _duck_plausible, _groups, _labelled_sql, _match, _num, _sq, _tail, detections
from labelwright.sources.standins import define, spark_view


@query("extract_mrp", f"""
SELECT * FROM (SELECT image_id, det_id, {_num(_groups('trim(text)', P.AMOUNT, 3))} AS value, {_match('text', P.TAX_INCLUSIVE)} AS inclusive
 FROM @detections) WHERE value > 0""")
def extract_mrp(spark, sf):
    d = detections(spark, sf).select(
        "image_id", "det_id", T.classify_price(F.col("text")).alias("value"), T.hits(F.col("text"), P.TAX_INCLUSIVE).alias("inclusive")
    )
    return d.filter(F.col("value").isNotNull())


@query("labelled_prices", f"""SELECT v.image_id, {_num('value')} AS value, 'INR' AS currency, t.image_id IS NOT NULL AS inclusive, source_type
 FROM ({_labelled_sql(('mrp',))}) v LEFT JOIN (SELECT DISTINCT image_id FROM @detections WHERE {_match('text', P.TAX_INCLUSIVE)}) t ON t.image_id = v.image_id""")
def labelled_prices(spark, sf):
    """Prices next to their labels; the wording on taxes may stand anywhere on the image."""
    return ops.labelled_prices(detections(spark, sf))


_QUNITS = "(VALUES " + ", ".join(
    f"('{w}', '{k}', {f!r}::DOUBLE)" for k, factors in P.QUANTITY_TOKEN_UNITS.items() for w, f in factors.items()
) + ") u(word, kind, multiplier)"
_TOKEN = f"""SELECT d.*, try_cast(regexp_extract(trim(text), {_sq(P.QUANTITY_TOKEN)}, 1) AS DOUBLE) AS qv,
 lower(regexp_extract(trim(text), {_sq(P.QUANTITY_TOKEN)}, 2)) AS qu FROM @detections d"""


@query("classify_quantity", f"""
SELECT image_id, det_id, qv AS value, CASE WHEN qu = 'l' THEN 'L' ELSE qu END AS unit, kind, multiplier FROM ({_TOKEN}) JOIN {_QUNITS} ON word = qu
WHERE qv > 0""")
def classify_quantity(spark, sf):
    d = detections(spark, sf).select("image_id", "det_id", T.classify_quantity(F.col("text")).alias("q"))
    return d.filter(F.col("q").isNotNull()).select("image_id", "det_id", "q.*")


def _shape_sql(text, skip=None):
    tests = " ".join(
        f"WHEN regexp_matches({text}, {_sq(('(?i)' if fold else '') + p)}) THEN '{name}'" for name, p, fold in P.SHAPES if name != skip
    )
    return f"CASE {tests} END"


@query("token_shape", f"""
SELECT image_id, det_id, {_shape_sql('text')} AS shape, {_match('trim(text)', P.REJECT_NUMBER)} AS rejected, {_match('trim(text)', P.REJECT_PRICE)} AS rejected_price
FROM @detections""")
def token_shape(spark, sf):
    t = F.col("text")
    return detections(spark, sf).select(
        "image_id", "det_id", T.shape_of(t).alias("shape"), T.hits(F.trim(t), P.REJECT_NUMBER).alias("rejected"),
        T.hits(F.trim(t), P.REJECT_PRICE).alias("rejected_price"),
    )


@query("batch_plausible", f"SELECT image_id, det_id, {_duck_plausible('trim(text)')} AS plausible FROM @detections")
def batch_plausible(spark, sf):
    return detections(spark, sf).select("image_id", "det_id", T.plausible_batch(F.col("text")).alias("plausible"))


@query("extract_contacts", f"""
SELECT * FROM (SELECT k AS doc_id, pos, nullif(regexp_extract(text, {_sq(P.EMAIL)}), '') AS email,
 nullif(regexp_extract(text, {_sq(P.PHONE)}), '') AS phone FROM @text_lines) WHERE email IS NOT NULL OR phone IS NOT NULL
UNION ALL SELECT * FROM (SELECT k + 1000000000, pos, nullif(regexp_extract(text, {_sq(P.EMAIL)}), '') AS email,
 nullif(regexp_extract(text, {_sq(P.PHONE)}), '') AS phone FROM @label_left) WHERE email IS NOT NULL OR phone IS NOT NULL""")
def extract_contacts(spark, sf):
    """Document lines and label rows (the latter with a key offset)."""
    lines = spark_view(spark, sf, "text_lines").select("k", "pos", "text")
    labels = spark_view(spark, sf, "label_left").select((F.col("k") + 1000000000).alias("k"), "pos", "text")
    found = lines.unionByName(labels).select(
        F.col("k").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), T.email(F.col("text")).alias("email"), T.phone(F.col("text")).alias("phone")
    )
    return found.filter(F.col("email").isNotNull() | F.col("phone").isNotNull())


@query("extract_date")
def extract_date(spark, sf):
    """Look-behind patterns have no DuckDB form; golden tests cover the reader."""
    d = detections(spark, sf).select("image_id", "det_id", T.extract_date(F.col("text")).alias("day"))
    return d.filter(F.col("day").isNotNull())


@query("classify_date")
def classify_date(spark, sf):
    d = detections(spark, sf).select("image_id", "det_id", T.classify_date(F.col("text")).alias("d"))
    return d.filter(F.col("d").isNotNull()).select("image_id", "det_id", "d.*")


_PERIODS = lambda t: f"trim(regexp_replace({t}, '\\.+$', ''))"
_COUNTRY = [
    f"CASE WHEN {_match('text', p)} AND regexp_matches({_PERIODS(f'CASE WHEN {_tail(chr(116) + chr(101) + chr(120) + chr(116), p)} = {chr(39)}{chr(39)} THEN trim(coalesce(following, {chr(39)}{chr(39)})) ELSE {_tail(chr(116) + chr(101) + chr(120) + chr(116), p)} END')}, '[A-Za-z]')"
    f" THEN {_PERIODS(f'CASE WHEN {_tail(chr(116) + chr(101) + chr(120) + chr(116), p)} = {chr(39)}{chr(39)} THEN trim(coalesce(following, {chr(39)}{chr(39)})) ELSE {_tail(chr(116) + chr(101) + chr(120) + chr(116), p)} END')} END"
    for p in P.COUNTRY_LABELS
]
define("plain_lines", """
SELECT 'p' || cast(k AS string) AS image_id, cast(2 * pos AS bigint) AS line_no, text FROM @label_left WHERE text IS NOT NULL
UNION ALL SELECT 'p' || cast(k AS string), cast(2 * pos + 1 AS bigint), text FROM @label_right WHERE text IS NOT NULL
UNION ALL SELECT 'd' || cast(k AS string), cast(pos AS bigint), text FROM @text_lines WHERE text <> ''""")


@query("extract_country", f"""
WITH l AS (SELECT *, lead(text) OVER (PARTITION BY image_id ORDER BY line_no) AS following FROM @plain_lines),
 v AS (SELECT image_id, line_no, coalesce({', '.join(_COUNTRY)}) AS country FROM l)
SELECT image_id, min(line_no) AS line_no, arg_min(country, line_no) AS country FROM v WHERE country IS NOT NULL GROUP BY 1""")
def extract_country(spark, sf):
    return ops.country_of_origin(spark_view(spark, sf, "plain_lines"))


@query("extract_manufacturer")
def extract_manufacturer(spark, sf):
    """A fold over boxes by distance; golden tests cover it."""
    return ops.manufacturers(detections(spark, sf))


@query("brand_product")
def brand_product(spark, sf):
    d = spark_view(spark, sf, "label_boxes")
    return ops.brand_and_product(d, ops.manufacturers(d))


_near = lambda words: f"coalesce(bool_or({' OR '.join(_match('b.text', w) for w in words)}), false)"
_FITTING = "CASE kind WHEN 'VOLUME' THEN qv < 100000 WHEN 'NUMBER' THEN qv BETWEEN 1 AND 10000 ELSE qv < 10000 END"
_IMPLICIT = f"""
WITH d AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(8, least(abs(y1 - y0), abs(x1 - x0))) AS font, abs(y1 - y0) AS h FROM @detections),
 s AS (SELECT image_id, ceil(max(y1) * 1.1::DOUBLE) AS img_h FROM d GROUP BY 1),
 hm AS (SELECT image_id, max(h) FILTER (WHERE r = n // 2 + 1) AS hmed FROM (SELECT image_id, h, row_number() OVER (PARTITION BY image_id ORDER BY h) AS r,
   count(*) OVER (PARTITION BY image_id) AS n FROM d) GROUP BY 1),
 t AS (SELECT image_id, det_id, text, cx, cy, font, {_match('text', P.AMOUNT)} AS amount, regexp_matches(trim(text), '{ops.BARE_NUMBER}') AS bare,
   {_groups('trim(text)', P.AMOUNT, 3)} AS amt, qv, qu, kind, y0 >= img_h * 0.65::DOUBLE AS region, h > hmed * 1.5 AS prominent
  FROM ({_TOKEN.replace('@detections d', 'd')}) LEFT JOIN {_QUNITS} ON word = qu AND qv > 0 JOIN s USING (image_id) JOIN hm USING (image_id)),
 a AS (SELECT * FROM t WHERE amount OR bare OR kind IS NOT NULL),
 n AS (SELECT a.image_id, a.det_id, {_near(P.NEAR_WORDS['price'])} AS near_price, {_near(P.NEAR_WORDS['quantity'])} AS near_quantity,
   {_near(P.NEAR_INCLUSIVE)} AS near_inclusive, {_near(P.NEAR_MONEY)} AS near_money, {_near(P.COMPETING_LABELS)} AS near_competitor FROM a LEFT JOIN d b ON a.image_id = b.image_id AND a.det_id <> b.det_id
   AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) > 0 AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) < a.font * 6 GROUP BY 1, 2),
 e AS (SELECT a.*, n.near_price, n.near_quantity, n.near_inclusive, n.near_money, NOT ({_match('text', ops.OWN_SIGN)} AND NOT bare) AND near_competitor AS competes,
   CASE WHEN amount THEN amt ELSE trim(text) END AS raw FROM a JOIN n USING (image_id, det_id)),
 p AS (SELECT *, CASE WHEN {_match('text', ops.CURRENCY)} OR regexp_matches(text, '[0-9]\\s*/\\s*-') THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END
   + CASE WHEN near_price THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN region THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN prominent THEN 0.1::DOUBLE ELSE 0 END AS c0 FROM e),
 o AS (SELECT image_id, det_id, 'mrp' AS field, raw AS value, CASE WHEN bare THEN least(c0, 0.55::DOUBLE) ELSE c0 END AS c, near_inclusive AS inclusive,
   concat_ws(',', CASE WHEN {_match('text', ops.CURRENCY)} THEN 'implicit_currency_symbol' WHEN regexp_matches(text, '[0-9]\\s*/\\s*-') THEN 'implicit_slash_notation' ELSE 'bare_number_near_price_label' END,
    CASE WHEN near_price THEN 'nearby_price_word' END, CASE WHEN region THEN 'declaration_region' END, CASE WHEN prominent THEN 'prominent_typography' END,
    CASE WHEN near_money THEN 'nearby_money_candidate' END, CASE WHEN bare THEN 'bare_number_capped_review' END) AS signals FROM p
   WHERE (amount OR (bare AND near_price)) AND {_num('raw')} > 0 AND CASE WHEN amount THEN {_shape_sql("replace(raw, ',', '')", 'dimension')} IS NULL
     ELSE {_shape_sql('text', 'dimension')} IS NULL AND NOT competes END
  UNION ALL SELECT image_id, det_id, 'netQuantity', printf('%.3f %s', qv, CASE WHEN qu = 'l' THEN 'L' ELSE qu END), 0.35::DOUBLE
   + CASE WHEN {_FITTING} THEN 0.15::DOUBLE ELSE 0 END
   + CASE WHEN near_quantity THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN region THEN 0.15::DOUBLE ELSE 0 END, NULL,
   concat_ws(',', 'recognized_metric_unit', CASE WHEN {_FITTING} THEN 'compatible_quantity_range' END, CASE WHEN near_quantity THEN 'nearby_net_quantity_word' END, CASE WHEN region THEN 'declaration_region' END) FROM e
   WHERE kind IS NOT NULL AND NOT ({' OR '.join(_match('text', x) for x in ops.NOT_A_QUANTITY)}) AND {_shape_sql('text')} IS NULL AND NOT competes)
SELECT image_id, det_id, field, value, greatest(0, least(1, floor(c * 100 + 0.5) / 100)) AS confidence,
 CASE WHEN c >= 0.8 THEN 'PASS' WHEN c >= 0.55 THEN 'REVIEW' ELSE 'UNKNOWN' END AS status, inclusive, signals FROM o"""


@query("implicit_score", _IMPLICIT)
def implicit_score(spark, sf):
    return ops.implicit_values(detections(spark, sf), ("mrp", "netQuantity")).drop("text")


@query("implicit_dates")
def implicit_dates(spark, sf):
    """Dates without a label; look-behind patterns have no DuckDB form."""
    return ops.implicit_values(detections(spark, sf), ("dates",)).drop("text")


define("rival_values", """
SELECT 'p' || cast(l_partkey AS string) AS image_id, CASE l_linenumber % 2 WHEN 0 THEN 'mrp' ELSE 'netQuantity' END AS field,
 l_orderkey * 10 + l_linenumber AS det_id, cast(l_quantity AS string) AS value, floor(40 + l_discount * 500 + l_tax * 100 + 0.5) / 100 AS confidence,
 CASE WHEN floor(40 + l_discount * 500 + l_tax * 100 + 0.5) / 100 >= 0.8 THEN 'PASS' WHEN floor(40 + l_discount * 500 + l_tax * 100 + 0.5) / 100 >= 0.55 THEN 'REVIEW' ELSE 'UNKNOWN' END AS status,
 l_orderkey % 4 = 0 AS money FROM @lineitem""")


@query("candidate_competition", """
WITH k AS (SELECT *, row_number() OVER w AS r, lead(confidence) OVER w AS nxt FROM @rival_values WHERE status <> 'UNKNOWN'
   WINDOW w AS (PARTITION BY image_id, field ORDER BY confidence DESC, det_id)),
 g AS (SELECT image_id, field, count(*) AS candidates, min(r) FILTER (WHERE money) AS mr FROM k GROUP BY 1, 2),
 j AS (SELECT t.*, candidates, m.det_id AS m_det, m.value AS m_value, m.confidence AS m_conf, coalesce(t.field = 'mrp' AND NOT t.money
   AND m.confidence >= t.confidence - 0.1, false) AS sw FROM k t JOIN g USING (image_id, field) LEFT JOIN k m ON m.image_id = t.image_id AND m.field = t.field AND m.r = g.mr WHERE t.r = 1)
SELECT image_id, field, CASE WHEN sw THEN m_det ELSE det_id END AS det_id, CASE WHEN sw THEN m_value ELSE value END AS value,
 CASE WHEN sw THEN m_conf ELSE confidence END AS confidence, CASE WHEN sw OR confidence - nxt < 0.15 THEN 'REVIEW' ELSE status END AS status, candidates FROM j""")
def candidate_competition(spark, sf):
    return ops.compete(spark_view(spark, sf, "rival_values"))


define("explicit_evidence", """
SELECT 'p' || cast(p_partkey AS string) AS image_id, CASE p_partkey % 3 WHEN 0 THEN 'mrp' WHEN 1 THEN 'netQuantity' ELSE 'batchLotNumber' END AS field,
 CASE WHEN p_partkey % 7 = 0 THEN 'REVIEW' ELSE cast(p_size AS string) END AS value, cast(50 + p_partkey % 50 AS double) / 100 AS confidence FROM @part""")
define("implicit_evidence", """
SELECT 'p' || cast(p_partkey AS string) AS image_id, CASE p_partkey % 2 WHEN 0 THEN 'mrp' ELSE 'netQuantity' END AS field,
 cast(p_size + 1 AS string) AS value, cast(50 + p_partkey % 47 AS double) / 100 AS confidence,
 CASE WHEN p_partkey % 4 < 2 THEN 'PASS' ELSE 'REVIEW' END AS status FROM @part""")
_MERGE = """SELECT coalesce(e.image_id, i.image_id) AS image_id, coalesce(e.field, i.field) AS field,
 CASE WHEN pick THEN i.value ELSE nullif(e.value, 'REVIEW') END AS value, CASE WHEN pick THEN i.confidence ELSE e.confidence END AS confidence,
 CASE WHEN pick THEN i.status WHEN e.value = 'REVIEW' OR e.confidence < 0.75 THEN 'REVIEW' ELSE 'PASS' END AS status,
 CASE WHEN pick THEN 'IMPLICIT' ELSE 'EXPLICIT' END AS source
FROM (SELECT e, i, e.image_id IS NULL OR (i.image_id IS NOT NULL AND (e.value = 'REVIEW' OR e.confidence < 0.75) AND i.status <> 'REVIEW' AND i.confidence > e.confidence) AS pick
 FROM @explicit_evidence e FULL JOIN @implicit_evidence i ON e.image_id = i.image_id AND e.field = i.field)"""


@query("evidence_merge", _MERGE)
def evidence_merge(spark, sf):
    return ops.merge_evidence(spark_view(spark, sf, "explicit_evidence"), spark_view(spark, sf, "implicit_evidence"))


@query("date_conflicts", """
SELECT product_id, CASE WHEN date_of_manufacture IS NULL THEN 'MISSING' WHEN expiry_date < date_of_manufacture THEN 'REVIEW' ELSE 'PASS' END AS manufacture_status,
 CASE WHEN date_of_packing IS NULL THEN 'MISSING' WHEN expiry_date <= date_of_packing THEN 'REVIEW' ELSE 'PASS' END AS packing_status,
 CASE WHEN expiry_date IS NULL THEN 'MISSING' WHEN coalesce(expiry_date < date_of_manufacture, false) OR coalesce(expiry_date <= date_of_packing, false) THEN 'REVIEW'
  ELSE 'PASS' END AS expiry_status FROM @product_facts""")
def date_conflicts(spark, sf):
    return ops.date_conflicts(spark_view(spark, sf, "product_facts"))


define("field_evidence", """
SELECT p_partkey AS product_id, 'mrp' AS field, CASE p_partkey % 3 WHEN 0 THEN 'PASS' ELSE 'REVIEW' END AS merged_status, cast(p_size AS string) AS merged_value,
 CASE WHEN p_partkey % 5 = 0 THEN 'REVIEW' WHEN p_partkey % 5 < 4 THEN cast(p_size + 2 AS string) END AS explicit_value, cast(p_partkey % 10 AS double) / 10 AS explicit_confidence FROM @part
UNION ALL SELECT p_partkey, 'batch', 'REVIEW', NULL, CASE WHEN p_partkey % 4 = 0 THEN 'REVIEW' WHEN p_partkey % 4 = 1 THEN NULL ELSE 'B' || cast(p_size AS string) END, cast(0.1 AS double) FROM @part""")
define("stored_products", "SELECT p_partkey AS product_id, 'old' AS mrp, CASE WHEN p_partkey % 2 = 0 THEN 'old' END AS batch FROM @part")


@query("evidence_apply", """
WITH n AS (SELECT product_id, field, CASE WHEN merged_status = 'PASS' AND merged_value IS NOT NULL THEN merged_value
  WHEN explicit_value <> 'REVIEW' AND (field <> 'mrp' OR explicit_confidence >= 0.8) THEN explicit_value END AS v FROM @field_evidence)
SELECT s.product_id, coalesce(a.v, s.mrp) AS mrp, coalesce(b.v, s.batch) AS batch FROM @stored_products s
LEFT JOIN n a ON a.product_id = s.product_id AND a.field = 'mrp' LEFT JOIN n b ON b.product_id = s.product_id AND b.field = 'batch'""")
def evidence_apply(spark, sf):
    return ops.apply_evidence(spark_view(spark, sf, "stored_products"), spark_view(spark, sf, "field_evidence"), ["mrp", "batch"])


_CONCEPTS = " UNION ALL ".join(
    f"SELECT image_id, det_id, '{name}' AS concept FROM @detections WHERE {' OR '.join(_match('text', p.replace('(?!of)', '').replace('(?!' + chr(92) + 's+date)', '')) for p in labels)}"
    if name not in ("NET_QUANTITY", "EXPIRY_USE_BY_BEST_BEFORE")
    else f"SELECT image_id, det_id, '{name}' FROM @detections WHERE {'%s'}"
    for name, labels in P.CONCEPT_LABELS.items()
)


@query("concept_hits", _CONCEPTS % (
    # the negative look-aheads spelled out for RE2
    " OR ".join(_match("text", p) for p in P.CONCEPT_LABELS["NET_QUANTITY"][:1]) + " OR " + _match("text", r"(?:quantity|weight|contents?)\s*[:\-.]?\s*(?:$|[^o]|o$|o[^f])"),
    " OR ".join(_match("text", p) for p in P.CONCEPT_LABELS["EXPIRY_USE_BY_BEST_BEFORE"] if "(?!" not in p)
    + " OR (" + _match("text", r"use\s+by") + " AND NOT " + _match("text", r"use\s+by\s+date") + ")",
))
def concept_hits(spark, sf):
    return ops.concept_hits(detections(spark, sf))
