"""Rule book, applicability, clause checks and their roll-up over every product."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import quantity
from labelwright.operators import compliance as ops
from labelwright.operators import reports, rulebook
from labelwright.plans.catalog import query
from labelwright.sources.standins import define, spark_view

# Example settings: the reference lists of verified thresholds and trusted calibrations are empty.
THRESHOLDS = {"LMPC-RULE7-numeralLetterHeight": 2.0, "LMPC-RULE7-letterHeight": 1.0}
TRUSTED = ["reference_card"]


def _facts(spark, sf):
    return spark_view(spark, sf, "product_facts")


_PLACE = "CASE WHEN product_id % {0} = 0 THEN 'OUTSIDE' WHEN product_id % {0} = 1 THEN 'PARTIAL' WHEN product_id % {0} <> 2 THEN 'INSIDE' END"
_INSIDE = "CASE WHEN product_id % {0} <> 3 THEN 'INSIDE' END"
# Stand-in for what vision found: field, value, confidence and place, as SQL of both engines.
_FUSED_FIELDS = [
    ("mrp", "CAST(mrp AS STRING)", "mrp_field_confidence", "mrp_relation"),
    ("netQuantity", "CAST(net_value AS STRING)", "0.95", "quantity_relation"),
    ("manufacturerName", "manufacturer_name", "CASE WHEN product_id % 19 = 0 THEN 0.7 ELSE 0.9 END", _PLACE.format(13)),
    ("manufacturerAddress", "manufacturer_address", "0.85", _INSIDE.format(91)),
    ("packerName", "CASE WHEN product_id % 5 = 2 THEN manufacturer_name END", "0.9", _INSIDE.format(83)),
    ("packerAddress", "CASE WHEN product_id % 5 = 2 THEN manufacturer_address END", "0.9", _INSIDE.format(79)),
    ("importerName", "CASE WHEN import_status = 'IMPORTED' THEN 'Imports Ltd' END", "CASE WHEN product_id % 43 = 0 THEN 0.6 ELSE 0.9 END", _PLACE.format(73)),
    ("importerAddress", "CASE WHEN import_status = 'IMPORTED' THEN 'REVIEW' END", "0.1", "'OUTSIDE'"),
    ("countryOfOrigin", "country_of_origin", "0.9", _PLACE.format(11)),
    ("commonGenericName", "common_generic_name", "CASE WHEN product_id % 23 <> 0 THEN 0.85 END", _PLACE.format(17)),
    ("monthYearOfManufacture", "CAST(date_of_manufacture AS STRING)", "0.8", _INSIDE.format(71)),
    ("dateOfPacking", "CAST(date_of_packing AS STRING)", "0.8", _PLACE.format(29)),
    ("bestBefore", "CASE WHEN product_id % 2 = 0 THEN CAST(expiry_date AS STRING) END", "0.9", _PLACE.format(67)),
    ("useBy", "CASE WHEN product_id % 2 = 1 THEN CAST(expiry_date AS STRING) END", "0.9", _PLACE.format(61)),
    ("consumerCarePhone", "care_phone", "0.95", _INSIDE.format(59)),
    ("consumerCareEmail", "care_email", "CASE WHEN product_id % 35 <> 0 THEN 0.95 END", _INSIDE.format(53)),
    ("unitSalePrice", "unit_sale_price", "0.9", _INSIDE.format(47)),
    ("dimensions", "dimensions", "0.9", _PLACE.format(41)),
    # not a mandatory declaration: its place does not matter
    ("batchNumber", "'B1'", "0.5", "'OUTSIDE'"),
]
# Stand-in for measured heights: clause, height, uncertainty and state; the last clause is never measured.
_HEIGHTS = [
    ("numeralLetterHeight", "physical_height + 0.75", "height_uncertainty / 2", "CASE WHEN product_id % 25 = 2 THEN 'UNCERTAIN' ELSE 'MEASURED' END"),
    ("smallPackage", "CASE WHEN product_id % 2 = 0 THEN physical_height END", "0.0", "'MEASURED'"),
    ("letterHeight", "physical_height", "height_uncertainty", "height_status"),
    ("letterWidthRatio", "physical_height / 4", "CASE WHEN product_id % 7 <> 0 THEN 0.1 END", "'MEASURED'"),
]
# Stand-in for inspection: each clause has evidence of its own.
_EXPLICIT = {
    "numeralLetterHeight": "size_evidence",
    "letterWidthRatio": "CASE WHEN product_id % 15 = 4 THEN '0.4' END",
    **{key: f"CASE WHEN product_id % 12 = {(5 + i) % 12} THEN 'confirmed {i}' END" for i, key in enumerate(ops.VISUAL_CLAUSES)},
}


def _with_panel(df):
    double = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    field = lambda name, value, conf, rel: F.struct(
        F.lit(name).alias("field"), F.expr(value).alias("value"), double(conf).alias("confidence"), F.expr(rel).alias("relation")
    )
    height = lambda i, target, value, band, state: F.struct(
        F.lit(target).alias("target"), double(f"product_id % 30 + {20 + i}").alias("pixel_height"), double(value).alias("physical_height"), double(band).alias("uncertainty"), F.expr(state).alias("status")
    )
    return df.withColumns({
        "panel_fields": F.array(*[field(*f) for f in _FUSED_FIELDS]),
        "measurements": F.array(*[height(i, *m) for i, m in enumerate(_HEIGHTS)]),
        "explicit": F.create_map(*[x for key, e in _EXPLICIT.items() for x in (F.lit(key), F.expr(e))]),
    })


# ---- SQL side: the dimensions as VALUES -----------------------------------------------------
def _q(value):
    return "NULL" if value is None else "'" + str(value) + "'"


_RULES = "(VALUES " + ", ".join(
    f"({_q(i)}, {_q(n)}, {_q(c)}, CAST({_q(f)} AS DATE), CAST({_q(t)} AS DATE), {_q(s[0] if s else None)})"
    for i, n, c, f, t, s in rulebook.RULES
) + ") r(rule_id, rule_number, clause, effective_from, effective_to, replaces)"
_CLAUSES = "(VALUES " + ", ".join(
    f"({_q(n)}, {_q(k)}, {_q(i)}, {_q(lv)}, {_q(e)}, {_q(','.join(cx))}, {bool(im)})"
    for n, k, i, lv, e, cx, im in rulebook.CLAUSES
) + ") c(rule_number, clause_key, rule_id, automation_level, evaluator, needs, imported_only)"

define("rule_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) + 10000 AS day FROM @orders")
_ACTIVE = f"""active AS (SELECT d.day, r.* FROM days d JOIN {_RULES}
  ON (r.effective_from IS NULL OR d.day >= r.effective_from) AND (r.effective_to IS NULL OR d.day <= r.effective_to)),
 inforce AS (SELECT a.* FROM active a LEFT JOIN (SELECT DISTINCT day, replaces FROM active WHERE replaces IS NOT NULL) b
  ON b.day = a.day AND b.replaces = a.rule_id WHERE b.day IS NULL)"""


@query("rules_as_of", f"""WITH days AS (SELECT * FROM @rule_days), {_ACTIVE}
SELECT day, rule_id, rule_number, clause, effective_from, effective_to FROM inforce""")
def rules_as_of(spark, sf):
    return rulebook.rules_as_of(spark_view(spark, sf, "rule_days"))


@query("rules_delta", f"""
WITH base AS (SELECT day AS day0, day + 400 AS day1 FROM @rule_days),
 days AS (SELECT day0 AS day FROM base UNION SELECT day1 FROM base), {_ACTIVE},
 x AS (SELECT b.day0, b.day1, i.rule_id FROM base b JOIN inforce i ON i.day = b.day0),
 y AS (SELECT b.day0, b.day1, i.rule_id FROM base b JOIN inforce i ON i.day = b.day1)
SELECT day0, day1, 'ADDED' AS change, rule_id FROM (SELECT * FROM y EXCEPT SELECT * FROM x)
UNION ALL SELECT day0, day1, 'REMOVED', rule_id FROM (SELECT * FROM x EXCEPT SELECT * FROM y)""")
def rules_delta(spark, sf):
    days = spark_view(spark, sf, "rule_days")
    return rulebook.rules_delta(days.select(F.col("day").alias("day0"), F.date_add("day", 400).alias("day1")), "day0", "day1")


@query("scope_status", """
SELECT product_id, CASE WHEN consumer_type IN ('INDUSTRIAL', 'INSTITUTIONAL') THEN 'NOT_APPLICABLE'
  WHEN consumer_type = 'RETAIL' THEN 'APPLICABLE' ELSE 'REVIEW' END AS status,
 CASE WHEN consumer_type IN ('INDUSTRIAL', 'INSTITUTIONAL', 'RETAIL') THEN ''
  ELSE concat_ws(',', CASE WHEN consumer_type IS NULL THEN 'consumerType' END,
    CASE WHEN net_value IS NULL AND net_unit = '' THEN 'packageQuantity' END) END AS missing
FROM @product_facts""")
def scope_status(spark, sf):
    return _facts(spark, sf).select(
        "product_id", ops.scope_status(F.col("consumer_type")).alias("status"), ops.missing_scope_context().alias("missing")
    )


_NEED = "((needs LIKE '%domain%' AND domain IS NULL) OR (needs LIKE '%commodityType%' AND commodity_type IS NULL)" \
    " OR (needs LIKE '%packageDimensions%' AND package_dimensions IS NULL)" \
    " OR (needs LIKE '%dimensionsApplicable%' AND dimensions_applicable IS NULL)" \
    " OR (needs LIKE '%unitSalePriceApplicable%' AND usp_applicable IS NULL))"
_FITS = f"""CASE WHEN consumer_type IN ('INDUSTRIAL', 'INSTITUTIONAL') THEN 'NOT_APPLICABLE:OUT_OF_SCOPE'
 WHEN consumer_type IS NULL OR consumer_type <> 'RETAIL' THEN 'REVIEW:SCOPE_UNRESOLVED'
 WHEN imported_only AND import_status IS NULL THEN 'REVIEW:IMPORT_STATUS_UNKNOWN'
 WHEN imported_only AND import_status <> 'IMPORTED' THEN 'NOT_APPLICABLE:IMPORT_STATUS_OUTSIDE'
 %s
 WHEN needs LIKE '%%unitSalePriceApplicable%%' AND usp_applicable IS NULL
   AND package_type IN ('COMBINATION', 'GROUP', 'MULTI_PIECE') THEN 'REVIEW:BUNDLE_UNIT_PRICE_OPEN'
 WHEN {_NEED.replace('%', '%%')} THEN 'REVIEW:CONTEXT_MISSING' %s ELSE 'APPLICABLE:APPLICABLE' END"""

# Example limits, one per kind, tried next to the real clauses.
_LIMITS = {
    "retail_only": dict(consumer_types=["RETAIL"], exempt_consumer_types=["OTHER"]),
    "single_packs": dict(package_types=["SINGLE"]),
    "food_only": dict(domains=["food", "household"]),
    "small_kg": dict(qty_min=1.0, qty_max=100.0, qty_unit="kg"),
}


def _limit_struct(limits):
    strings = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>") if v else F.lit(None).cast("array<string>")
    return F.struct(
        *[strings(limits.get(k)).alias(k) for k in ("consumer_types", "exempt_consumer_types", "package_types", "domains")],
        *[F.lit(limits.get(k)).cast("double").alias(k) for k in ("qty_min", "qty_max")],
        F.lit(limits.get("qty_unit")).cast("string").alias("qty_unit"),
    )


_LIMIT_CHECKS = (
    "WHEN probe = 'single_packs' AND package_type IS NULL THEN 'REVIEW:PACKAGE_UNKNOWN'"
    " WHEN probe = 'single_packs' AND package_type <> 'SINGLE' THEN 'NOT_APPLICABLE:PACKAGE_OUTSIDE'",
    "WHEN probe = 'food_only' AND domain IS NULL THEN 'REVIEW:DOMAIN_UNKNOWN'"
    " WHEN probe = 'food_only' AND domain NOT IN ('food', 'household') THEN 'NOT_APPLICABLE:DOMAIN_OUTSIDE'"
    " WHEN probe = 'small_kg' AND (net_value IS NULL OR net_unit = '') THEN 'REVIEW:QUANTITY_UNKNOWN'"
    " WHEN probe = 'small_kg' AND net_unit <> 'kg' THEN 'REVIEW:UNIT_NOT_COMPARABLE'"
    " WHEN probe = 'small_kg' AND net_value < 1 THEN 'NOT_APPLICABLE:QUANTITY_BELOW'"
    " WHEN probe = 'small_kg' AND net_value > 100 THEN 'NOT_APPLICABLE:QUANTITY_ABOVE'",
)


@query("clause_applicability", f"""
SELECT product_id, clause_key, probe, split_part(o, ':', 1) AS status, split_part(o, ':', 2) AS reason_code FROM (
 SELECT product_id, clause_key, probe, {_FITS % _LIMIT_CHECKS} AS o
 FROM @product_facts, {_CLAUSES}, (VALUES ('retail_only'), ('single_packs'), ('food_only'), ('small_kg')) l(probe))""")
def clause_applicability(spark, sf):
    rows = rulebook.with_clauses(ops.prepare(_facts(spark, sf)))
    fits = F.explode(
        F.array(*[
            F.struct(F.lit(name).alias("probe"), ops.applicability(F.col("c"), _limit_struct(limit)).alias("o"))
            for name, limit in _LIMITS.items()
        ])
    )
    return rows.select("product_id", "c.clause_key", fits.alias("f")).select(
        "product_id", "clause_key", "f.probe", "f.o.status", "f.o.reason_code"
    )


_UNITS = "(VALUES " + ", ".join(
    f"('{w}', '{u}', '{quantity.UNIT_KINDS[u][0]}', {quantity.UNIT_KINDS[u][1]}::DOUBLE, '{quantity.UNIT_KINDS[u][2]}')"
    for w, u in quantity._spellings()
) + ")"
_PRICE_UNITS = "(VALUES " + ", ".join(
    f"('{w}', '{k}', {f!r}::DOUBLE)" for k, factors in quantity.PRICE_UNITS.items() for w, f in factors.items()
) + ")"
_QTY = f"""SELECT f.*, CASE WHEN net_value IS NOT NULL AND trim(net_unit) <> '' THEN net_value END AS q_value,
  CASE WHEN net_value IS NOT NULL AND trim(net_unit) <> '' THEN coalesce(u.unit, lower(trim(net_unit))) END AS q_unit,
  CASE WHEN net_value IS NOT NULL AND trim(net_unit) <> '' THEN coalesce(u.kind, 'UNKNOWN') ELSE 'UNKNOWN' END AS q_kind,
  net_value * u.factor AS q_base, CASE WHEN net_value IS NOT NULL THEN u.base END AS q_base_unit,
  coalesce(v.kind, 'UNKNOWN') AS o_kind, observed_value * v.factor AS o_base,
  p.kind AS p_kind, net_value * p.factor AS p_base
 FROM @product_facts f LEFT JOIN {_UNITS} u(word, unit, kind, factor, base) ON u.word = lower(trim(f.net_unit))
  LEFT JOIN {_UNITS} v(word, unit, kind, factor, base) ON v.word = lower(trim(f.observed_unit))
  LEFT JOIN {_PRICE_UNITS} p(word, kind, factor) ON p.word = lower(trim(f.net_unit))"""
_INVALID = """CASE WHEN q_kind = 'UNKNOWN' THEN 'UNKNOWN_UNIT' WHEN q_value IS NULL THEN 'INVALID_VALUE'
 WHEN q_value <= 0 THEN 'ZERO_OR_NEGATIVE_VALUE' END"""
_BASIS = """CASE WHEN net_value IS NULL OR net_value <= 0 THEN 'QUANTITY_MISSING_OR_INVALID' WHEN p_kind IS NULL THEN 'UNIT_NOT_RECOGNIZED'
 WHEN package_type IN ('COMBINATION', 'GROUP', 'MULTI_PIECE') THEN 'BUNDLE_PACKAGE'
 WHEN p_kind <> 'count' AND p_base = 1 THEN 'UNIT_BOUNDARY' END"""


@query("quantity_normalize", f"""SELECT product_id, q_value AS value, q_unit AS unit, q_kind AS kind, q_base AS base_value,
 q_base_unit AS base_unit FROM ({_QTY})""")
def quantity_normalize(spark, sf):
    q = quantity.normalize(F.col("net_value"), F.col("net_unit"))
    return _facts(spark, sf).select("product_id", q.alias("q")).select("product_id", "q.*")


@query("quantity_validate", f"""SELECT product_id, text, CASE WHEN NOT regexp_matches(text, '^-?[0-9]+(\\.[0-9]+)?\\s*[a-zA-Z.2]+([ .]?[a-zA-Z]+)?$')
  THEN 'UNKNOWN_UNIT' ELSE {_INVALID} END AS reason
 FROM (SELECT *, trim(CASE WHEN net_value IS NULL THEN '' ELSE printf('%.2f', net_value) END || ' ' || net_unit) AS text FROM ({_QTY}))""")
def quantity_validate(spark, sf):
    number = F.when(F.col("net_value").isNull(), F.lit("")).otherwise(F.format_string("%.2f", F.col("net_value")))
    text = F.trim(F.concat(number, F.lit(" "), F.col("net_unit")))
    rows = _facts(spark, sf).select("product_id", text.alias("text"))
    return rows.select("product_id", "text", quantity.invalid_reason(quantity.normalize_text(F.col("text"))).alias("reason"))


@query("unit_sale_basis", f"""
SELECT product_id, CASE WHEN code IS NULL THEN 'APPLICABLE' ELSE 'REVIEW' END AS status,
 CASE WHEN code IS NULL THEN p_kind END AS kind, code AS reason_code,
 CASE WHEN code IS NULL THEN CASE p_kind WHEN 'count' THEN 'unit'
  WHEN 'mass' THEN CASE WHEN p_base < 1 THEN 'gram' ELSE 'kilogram' END
  WHEN 'volume' THEN CASE WHEN p_base < 1 THEN 'millilitre' ELSE 'litre' END
  ELSE CASE WHEN p_base < 1 THEN 'centimetre' ELSE 'metre' END END END AS basis_unit,
 CASE WHEN code IS NULL THEN CASE WHEN abs(amount) >= 1000 THEN floor(amount + 0.5) ELSE floor(amount * 1e6 + 0.5) / 1e6 END END AS basis_quantity
FROM (SELECT *, {_BASIS} AS code, CASE WHEN p_kind = 'count' THEN net_value WHEN p_base >= 1 THEN p_base
  WHEN p_kind = 'length' THEN p_base * 100 ELSE p_base * 1000 END AS amount FROM ({_QTY}))""")
def unit_sale_basis(spark, sf):
    basis = quantity.price_basis(F.col("net_value"), F.col("net_unit"), F.col("package_type"))
    return _facts(spark, sf).select("product_id", basis.alias("b")).select("product_id", "b.*")


# ---- clause checks, SQL side ------------------------------------------------------------------
_DECLARED = """CASE clause_key WHEN 'manufacturerName' THEN manufacturer_name WHEN 'manufacturerAddress' THEN manufacturer_address
 WHEN 'countryOfOrigin' THEN country_of_origin WHEN 'commonGenericName' THEN common_generic_name
 WHEN 'dateOfManufacture' THEN date_of_manufacture::VARCHAR WHEN 'dateOfPacking' THEN date_of_packing::VARCHAR
 WHEN 'expiryOrUseByDate' THEN expiry_date::VARCHAR WHEN 'dimensions' THEN dimensions WHEN 'unitSalePrice' THEN unit_sale_price
 """ + " ".join(f"WHEN '{k}' THEN {e}" for k, e in _EXPLICIT.items()) + " END"
_HAS = "coalesce(declared NOT IN ('', 'UNKNOWN'), false)"
_GONE = "list_contains(string_split(confirmed_absent, ','), %s)"
_KEYGONE = _GONE % "clause_key"
_PRESENCE = f"CASE WHEN {_KEYGONE} THEN 'FAIL:CONFIRMED_ABSENT' WHEN {_HAS} THEN 'PASS:PRESENT' ELSE 'REVIEW:NO_EVIDENCE' END"


def _needed(flag, open_code):
    return f"""CASE WHEN {_HAS} THEN 'PASS:PRESENT' WHEN {flag} AND {_KEYGONE} THEN 'FAIL:CONFIRMED_ABSENT'
 WHEN {flag} THEN 'REVIEW:REQUIRED_NO_EVIDENCE' WHEN NOT {flag} THEN 'NOT_APPLICABLE:NOT_REQUIRED' ELSE {open_code} END"""


_LIMIT_SQL = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in THRESHOLDS.items()) + " END"
_OF_TARGET = lambda k: "CASE clause_key " + " ".join(f"WHEN '{m[0]}' THEN {m[k]}" for m in _HEIGHTS) + " END"
_HEIGHT, _BAND, _STATE = f"CAST({_OF_TARGET(1)} AS DOUBLE)", f"coalesce(CAST({_OF_TARGET(2)} AS DOUBLE), 0)", _OF_TARGET(3)
_PIXELS = "CASE clause_key " + " ".join(f"WHEN '{m[0]}' THEN product_id % 30 + {20 + i}" for i, m in enumerate(_HEIGHTS)) + " END"
_MEASURE = f"""CASE WHEN {_KEYGONE} THEN 'FAIL:CONFIRMED_ABSENT' WHEN {_HAS} THEN 'PASS:PRESENT'
 WHEN measurement_status IS NULL OR measurement_status = 'UNAVAILABLE' THEN 'REVIEW:NOT_MEASURED'
 WHEN measurement_status IN ('UNCALIBRATED', 'UNCERTAIN') THEN 'REVIEW:' || measurement_status
 WHEN {_HEIGHT} IS NULL THEN 'REVIEW:TARGET_NOT_MEASURED' WHEN {_STATE} = 'UNCERTAIN' THEN 'REVIEW:HEIGHT_UNCERTAIN'
 WHEN calibration_source <> 'reference_card' THEN 'REVIEW:CALIBRATION_NOT_TRUSTED'
 WHEN {_LIMIT_SQL} IS NULL THEN 'REVIEW:NO_VERIFIED_THRESHOLD'
 WHEN {_HEIGHT} - {_BAND} >= {_LIMIT_SQL} THEN 'PASS:MEETS_THRESHOLD'
 WHEN {_HEIGHT} + {_BAND} < {_LIMIT_SQL} THEN 'FAIL:BELOW_THRESHOLD' ELSE 'REVIEW:STRADDLES_THRESHOLD' END"""
_FUSED = ", ".join(f"{{'value': {v}, 'confidence': CAST({c} AS DOUBLE), 'relation': {p}}}" for n, v, c, p in _FUSED_FIELDS if n != "batchNumber")
_FUSED = f"list_filter([{_FUSED}], lambda x: coalesce(x.value, '') NOT IN ('', 'UNKNOWN', 'REVIEW'))"
_SOME = lambda test: f"len(list_filter({_FUSED}, lambda x: coalesce({test}, false))) > 0"
_PANEL = f"""CASE WHEN visual_status IS NULL THEN {_PRESENCE} WHEN visual_status <> 'SUCCESS' THEN 'REVIEW:MODEL_UNAVAILABLE'
 WHEN NOT panel_found THEN 'REVIEW:PANEL_NOT_FOUND' WHEN panel_confidence < 0.6 THEN 'REVIEW:PANEL_LOW_CONFIDENCE'
 WHEN len({_FUSED}) = 0 THEN 'REVIEW:NO_DECLARATIONS'
 WHEN {_SOME("x.confidence < 0.8")} THEN 'REVIEW:FIELD_LOW_CONFIDENCE'
 WHEN {_SOME("x.relation = 'OUTSIDE'")} THEN 'REVIEW:FIELD_OUTSIDE'
 WHEN {_SOME("x.relation = 'PARTIAL'")} THEN 'REVIEW:FIELD_PARTIAL'
 WHEN {_SOME("coalesce(x.relation, 'UNKNOWN') <> 'INSIDE'")} THEN 'REVIEW:FIELD_RELATION_UNKNOWN' ELSE 'PASS:ALL_INSIDE' END"""
_MPE = """CASE WHEN observed_value IS NULL THEN 'REVIEW:NO_MEASUREMENT' WHEN bad IS NOT NULL THEN 'FAIL:DECLARED_INVALID'
 WHEN o_kind = 'UNKNOWN' OR observed_value <= 0 THEN 'FAIL:OBSERVED_INVALID' WHEN q_kind <> o_kind THEN 'FAIL:KIND_MISMATCH'
 ELSE 'REVIEW:TOLERANCE_UNVERIFIED' END"""
_EVALUATE = f"""CASE evaluator WHEN 'presence' THEN {_PRESENCE} WHEN 'generic' THEN {_PRESENCE}
 WHEN 'quantity' THEN CASE WHEN net_value > 0 AND trim(net_unit) <> '' THEN 'PASS:PRESENT'
   WHEN net_value IS NOT NULL OR net_unit IS NOT NULL THEN 'FAIL:MALFORMED' ELSE 'REVIEW:NO_EVIDENCE' END
 WHEN 'price' THEN CASE WHEN mrp > 0 THEN 'PASS:PRESENT' WHEN mrp IS NOT NULL THEN 'FAIL:MALFORMED'
   WHEN {_KEYGONE} THEN 'FAIL:CONFIRMED_ABSENT' ELSE 'REVIEW:NO_EVIDENCE' END
 WHEN 'contact' THEN CASE WHEN care_phone IS NOT NULL OR care_email IS NOT NULL THEN 'PASS:PRESENT'
   WHEN {_KEYGONE} THEN 'FAIL:CONFIRMED_ABSENT' ELSE 'REVIEW:NO_EVIDENCE' END
 WHEN 'expiry' THEN {_needed('expiry_required', "'REVIEW:APPLICABILITY_OPEN'")}
 WHEN 'dimensions' THEN {_needed('dimensions_applicable', "'REVIEW:APPLICABILITY_OPEN'")}
 WHEN 'unit_price' THEN {_needed('usp_applicable', "'REVIEW:' || basis_code")}
 WHEN 'measurement' THEN {_MEASURE}
 WHEN 'medical' THEN CASE WHEN domain = 'medical_device' THEN {_PRESENCE} ELSE 'REVIEW:NOT_A_MEDICAL_DEVICE' END
 WHEN 'panel' THEN {_PANEL}
 WHEN 'quantity_expression' THEN CASE WHEN {_GONE % "'netQuantity'"} THEN 'FAIL:CONFIRMED_ABSENT'
   WHEN net_value IS NULL AND net_unit IS NULL THEN 'REVIEW:NO_EVIDENCE' WHEN bad IS NOT NULL THEN 'FAIL:' || bad ELSE 'PASS:PRESENT' END
 WHEN 'permissible_error' THEN {_MPE} ELSE 'REVIEW:NO_EVALUATOR' END"""
_PLAIN = lambda x: f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
_ITEM = lambda field, value, source, state="'PRESENT'", conf="CAST(NULL AS DOUBLE)": f"{{'field': {field}, 'value': {value}, 'source': {source}, 'state': {state}, 'confidence': {conf}}}"
_SAID_Q = f"concat_ws(' ', {_PLAIN('net_value')}, net_unit)"
_PANEL_ITEMS = ", ".join(
    _ITEM(f"'{n}'", v, "'vision'", f"coalesce({p}, 'UNKNOWN')", f"CAST({c} AS DOUBLE)") for n, v, c, p in _FUSED_FIELDS if n != "batchNumber"
)
_NOTHING = f"list_filter([{_ITEM(chr(39) * 2, chr(39) * 2, chr(39) * 2)}], lambda x: false)"
_EVIDENCE = f"""CASE WHEN fits NOT LIKE 'APPLICABLE%' THEN {_NOTHING}
 WHEN o LIKE '%:CONFIRMED_ABSENT' THEN [{_ITEM('clause_key', 'CAST(NULL AS VARCHAR)', "'ocr'", "'ABSENT_CONFIRMED'")}]
 WHEN o LIKE '%:NO_EVIDENCE' THEN {_NOTHING}
 WHEN evaluator = 'permissible_error' AND o NOT LIKE '%:NO_MEASUREMENT' THEN [{_ITEM("'netQuantity'", _SAID_Q, "'ocr'")},
  {_ITEM("'observedQuantity'", f"concat_ws(' ', {_PLAIN('observed_value')}, observed_unit)", "'manual'")}]
 WHEN evaluator = 'quantity_expression' THEN [{_ITEM("'netQuantity'", _SAID_Q, "'ocr'")}]
 WHEN o LIKE '%:PRESENT' OR o LIKE '%:MALFORMED' THEN [{_ITEM('clause_key', f"""CASE clause_key WHEN 'netQuantity' THEN {_SAID_Q}
   WHEN 'mrp' THEN {_PLAIN('mrp')} WHEN 'consumerCareDetails' THEN concat_ws(', ', care_phone, care_email) ELSE trim(declared) END""", "CASE WHEN rule_number IN ('7', '8', '9') THEN 'explicit' ELSE 'ocr' END")}]
 WHEN evaluator = 'measurement' AND split_part(o, ':', 2) IN ('CALIBRATION_NOT_TRUSTED', 'NO_VERIFIED_THRESHOLD', 'MEETS_THRESHOLD', 'BELOW_THRESHOLD', 'STRADDLES_THRESHOLD')
  THEN [{_ITEM('clause_key', f"printf('%.2f mm', floor({_HEIGHT} * 100 + 0.5) / 100)", "'measurement'")}]
 WHEN evaluator = 'measurement' AND split_part(o, ':', 2) IN ('UNCALIBRATED', 'HEIGHT_UNCERTAIN') AND {_PIXELS} IS NOT NULL THEN [{_ITEM('clause_key', f"CAST({_PIXELS} AS VARCHAR) || ' px'", "'measurement'")}]
 WHEN evaluator = 'panel' AND (o LIKE '%:FIELD_%' OR o LIKE '%:ALL_INSIDE') THEN list_filter([{_PANEL_ITEMS}], lambda x: coalesce(x.value, '') NOT IN ('', 'UNKNOWN', 'REVIEW'))
 ELSE {_NOTHING} END"""
_CHECKS = f"""SELECT product_id, user_id, rule_number, rule_id, clause_key, automation_level, declared, {_EVIDENCE} AS evidence,
 split_part(o, ':', 1) AS status, split_part(o, ':', 2) AS reason_code FROM (
 SELECT *, CASE WHEN fits LIKE 'APPLICABLE%' THEN {_EVALUATE} ELSE fits END AS o FROM (
  SELECT *, {_FITS % ('', '')} AS fits, {_DECLARED} AS declared, {_INVALID} AS bad,
   coalesce({_BASIS}, 'EXPECTED_PER_' || upper(CASE p_kind WHEN 'count' THEN 'unit'
    WHEN 'mass' THEN CASE WHEN p_base < 1 THEN 'gram' ELSE 'kilogram' END
    WHEN 'volume' THEN CASE WHEN p_base < 1 THEN 'millilitre' ELSE 'litre' END
    ELSE CASE WHEN p_base < 1 THEN 'centimetre' ELSE 'metre' END END)) AS basis_code
  FROM ({_QTY}) f, {_CLAUSES}
  WHERE (rule_number = '11' OR coalesce(consumer_type, '') NOT IN ('INDUSTRIAL', 'INSTITUTIONAL'))
   AND (rule_number IN ('6', '11') OR consumer_type = 'RETAIL')))"""
_CHECK_COLUMNS = "product_id, rule_number, rule_id, clause_key, automation_level, status, reason_code"


def _check_query(name, numbers):
    listed = ", ".join(f"'{n}'" for n in numbers)

    @query(name, f"SELECT {_CHECK_COLUMNS} FROM ({_CHECKS}) WHERE rule_number IN ({listed})")
    def run(spark, sf):
        return ops.evaluate(_with_panel(_facts(spark, sf)), numbers, THRESHOLDS, TRUSTED).drop("evidence", "source", "confidence")

    return run


_check_query("rule6_checks", ["6"])
_check_query("rule789_checks", ["7", "8", "9"])
_check_query("rule11_checks", ["11"])


def _all(spark, sf):
    return ops.evaluate(_with_panel(_facts(spark, sf)), thresholds=THRESHOLDS, trusted=TRUSTED)


@query("permissible_error", f"""SELECT product_id, split_part(o, ':', 1) AS status, split_part(o, ':', 2) AS reason_code,
 CASE WHEN o LIKE '%UNVERIFIED' THEN floor((o_base - q_base) * 1e6 + 0.5) / 1e6 END AS error_base
 FROM (SELECT *, {_MPE} AS o FROM (SELECT *, {_INVALID} AS bad FROM ({_QTY})))""")
def permissible_error(spark, sf):
    return ops.permissible_error(_facts(spark, sf))


@query("clauses", f"""SELECT rule_number, clause_key, rule_id, automation_level, status, count(*) AS n
 FROM ({_CHECKS}) GROUP BY 1, 2, 3, 4, 5""")
def clauses(spark, sf):
    """How often each clause of the dimension was decided each way."""
    keys = ["rule_number", "clause_key", "rule_id", "automation_level", "status"]
    return _all(spark, sf).groupBy(*keys).agg(F.count("*").alias("n"))


_WORST = f"""SELECT product_id, rule_number, coalesce(CASE min(CASE status WHEN 'FAIL' THEN 1 WHEN 'PASS' THEN 3
  WHEN 'NOT_APPLICABLE' THEN NULL ELSE 2 END) WHEN 1 THEN 'FAIL' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'PASS' END, 'NOT_APPLICABLE') AS status,
 count(*) FILTER (WHERE status <> 'NOT_APPLICABLE') AS executed FROM ({_CHECKS}) GROUP BY 1, 2"""


@query("rule_worst_status", _WORST)
def rule_worst_status(spark, sf):
    return ops.worst_status(_all(spark, sf), ["product_id", "rule_number"])


@query("overall_status", f"""SELECT f.product_id, CASE WHEN bool_or(status = 'FAIL') THEN 'NON_COMPLIANT'
 WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' WHEN bool_or(status = 'PASS') THEN 'COMPLIANT' ELSE 'REVIEW' END AS overall
 FROM @product_facts f LEFT JOIN ({_WORST}) w ON w.product_id = f.product_id GROUP BY 1""")
def overall_status(spark, sf):
    worst = ops.worst_status(_all(spark, sf), ["product_id", "rule_number"])
    return ops.overall_status(_facts(spark, sf), worst)


@query("report_summary", f"""SELECT product_id, count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS passed,
 count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'REVIEW') AS review,
 coalesce(string_agg(clause_key, ',' ORDER BY clause_key) FILTER (WHERE status = 'FAIL'), '') AS violations,
 coalesce(string_agg(clause_key, ',' ORDER BY clause_key) FILTER (WHERE status = 'REVIEW'), '') AS reviews
 FROM ({_CHECKS}) WHERE status <> 'NOT_APPLICABLE' GROUP BY 1""")
def report_summary(spark, sf):
    return reports.report_summary(_all(spark, sf))


@query("report_rows", """
SELECT product_id, coalesce(nullif(common_generic_name, ''), 'Not detected') AS product_name,
 coalesce(brand_name, 'Not detected') AS brand_name, coalesce(category, 'Unknown') AS category, coalesce(batch_lot_number, 'Not detected') AS batch_lot_number,
 coalesce(strftime(date_of_packing, '%Y-%m-%d'), 'Not detected') AS date_of_packing,
 coalesce(manufacturer_name, 'Not detected') AS manufacturer_name, coalesce(country_of_origin, 'Not detected') AS country_of_origin,
 CASE WHEN mrp IS NULL OR mrp = 0 THEN 'Not detected' ELSE '₹' || regexp_replace(CAST(mrp AS VARCHAR), '\\.0$', '') END AS mrp,
 CASE WHEN net_value IS NULL OR net_value = 0 THEN 'Not detected' ELSE regexp_replace(CAST(net_value AS VARCHAR), '\\.0$', '') || ' ' || net_unit END AS net_quantity,
 coalesce(strftime(date_of_manufacture, '%Y-%m-%d'), 'Not detected') AS date_of_manufacture,
 coalesce(strftime(expiry_date, '%Y-%m-%d'), 'Not detected') AS expiry_date,
 'Phone: ' || coalesce(care_phone, 'N/A') || ', Email: ' || coalesce(care_email, 'N/A') AS consumer_care
FROM @product_facts""")
def report_rows(spark, sf):
    return reports.report_rows(_facts(spark, sf))


_LISTED = "array_to_string(list_transform({0}, lambda e: e.field || '=' || coalesce(e.value, '') || '@' || e.source || ':' || e.state), '|')"


def _listed(checks):
    item = lambda e: F.concat(e["field"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit("@"), e["source"], F.lit(":"), e["state"])
    return checks.withColumn("evidence", F.array_join(F.transform("evidence", item), "|"))


@query("context_projection", f"""SELECT product_id, rule_number, clause_key, status, reason_code, {_LISTED.format('evidence[1:3]')} AS evidence
 FROM ({_CHECKS}) WHERE status <> 'NOT_APPLICABLE'""")
def context_projection(spark, sf):
    return _listed(reports.context_projection(_all(spark, sf)))


@query("clause_evidence", f"""SELECT product_id, rule_number, clause_key, status, len(evidence)::INT AS items, {_LISTED.format('evidence')} AS evidence,
 list_min(list_transform(evidence, lambda e: e.confidence)) AS confidence, '{ops.SOURCE_DOCUMENT}' || ' ' || rule_id AS source FROM ({_CHECKS}) WHERE len(evidence) > 0""")
def clause_evidence(spark, sf):
    """Checks with what led to them: fields, values, where they come from, and the legal source."""
    checks = _all(spark, sf).where(F.size("evidence") > 0).withColumn("items", F.size("evidence"))
    source = F.concat_ws(" ", "source.document", "source.rule_id").alias("source")
    return _listed(checks).select("product_id", "rule_number", "clause_key", "status", "items", "evidence", "confidence", source)


@query("validate_checks", f"""SELECT rule_number, count(*) AS n, count(*) FILTER (WHERE NOT (rule_id <> '' AND
 status IN ('PASS', 'FAIL', 'REVIEW', 'NOT_APPLICABLE', 'PENDING'))) AS broken FROM ({_CHECKS}) GROUP BY 1""")
def validate_checks(spark, sf):
    from labelwright.operators.validation import check_is_valid

    return (
        _all(spark, sf)
        .groupBy("rule_number")
        .agg(F.count("*").alias("n"), F.count_if(~check_is_valid()).alias("broken"))
    )
