"""Clause-level compliance checks and their roll-up.

Input is one row per product with its declarations and context; output is one row per
product and clause. Evidence that is merely missing gives REVIEW, never FAIL.
Everything is a chain of column expressions over the exploded clause array, so a run
over any number of products is one narrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions import quantity
from labelwright.functions.evidence import has_value, known, listed, plain_number
from labelwright.functions.literals import map_of
from labelwright.functions.plan import settle, spread
from labelwright.functions.rounding import half_up
from labelwright.operators.rulebook import CLAUSES, with_clauses

# The declarations that may have to stand on a package.
MANDATORY_FIELDS = [
    "manufacturerName",
    "manufacturerAddress",
    "packerName",
    "packerAddress",
    "importerName",
    "importerAddress",
    "countryOfOrigin",
    "commonGenericName",
    "netQuantity",
    "monthYearOfManufacture",
    "dateOfPacking",
    "bestBefore",
    "useBy",
    "mrp",
    "consumerCarePhone",
    "consumerCareEmail",
    "unitSalePrice",
    "dimensions",
]
# The clauses whose declaration is visual evidence.
VISUAL_CLAUSES = [
    "surroundingSpace",
    "presentedDeclarations",
    "wrapperVisibility",
    "legibility",
    "prominence",
    "contrastingPresentation",
    "languageFramework",
    "medicalDeviceOverride",
    "pdpLocation",
]
# The clauses that a measured height decides.
MEASURED_CLAUSES = ["numeralLetterHeight", "smallPackage", "letterHeight", "letterWidthRatio", "quantityTypeDependentSize"]
PANEL_MIN_CONFIDENCE = 0.6
FIELD_MIN_CONFIDENCE = 0.8

STATUS_RANK = {"FAIL": 1, "REVIEW": 2, "PENDING": 2, "PASS": 3}


_MEASUREMENTS = "array<struct<target:string,pixel_height:double,physical_height:double,uncertainty:double,status:string>>"


def prepare(products: DataFrame) -> DataFrame:
    """Collect declarations and context of a product into maps keyed by clause name.

    Evidence by inspection is read from ``explicit`` (map of clause name to value) and measured heights from
    ``measurements``, an array with one entry per measured clause (its ``target``). Tables without these columns give
    one ``visual_evidence`` for all visual clauses, ``size_evidence`` for the numeral height and one
    ``physical_height`` with its ``height_uncertainty`` and ``height_status`` for all measured clauses.
    """
    c = F.col
    by_clause = "explicit" in products.columns
    if "measurements" in products.columns:
        heights = F.col("measurements").cast(_MEASUREMENTS)
    else:
        one = lambda key: F.struct(
            F.lit(key), F.lit(None).cast("double"), c("physical_height"), c("height_uncertainty"), c("height_status")
        )
        heights = F.array(*[one(key) for key in MEASURED_CLAUSES]).cast(_MEASUREMENTS)
    text = lambda name: c(name).cast("string")
    declared = {
        "manufacturerName": c("manufacturer_name"),
        "manufacturerAddress": c("manufacturer_address"),
        "countryOfOrigin": c("country_of_origin"),
        "commonGenericName": c("common_generic_name"),
        "dateOfManufacture": text("date_of_manufacture"),
        "dateOfPacking": text("date_of_packing"),
        "expiryOrUseByDate": text("expiry_date"),
        "dimensions": c("dimensions"),
        "unitSalePrice": c("unit_sale_price"),
        **({k: c("explicit")[k] for k in MEASURED_CLAUSES} if by_clause else {"numeralLetterHeight": c("size_evidence")}),
        **{key: c("explicit")[key] if by_clause else c("visual_evidence") for key in VISUAL_CLAUSES},
    }
    context = {
        "domain": c("domain"),
        "commodityType": c("commodity_type"),
        "packageDimensions": c("package_dimensions"),
        "dimensionsApplicable": text("dimensions_applicable"),
        "unitSalePriceApplicable": text("usp_applicable"),
    }

    def as_map(values: Mapping[str, Column]) -> Column:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])

    return products.select(
        "*",
        as_map(declared).alias("declared"),
        as_map(context).alias("context"),
        F.split("confirmed_absent", ",").alias("absent_fields"),
        heights.alias("heights"),
    )


# ---- applicability ---------------------------------------------------------------------
def scope_status(consumer_type: Column) -> Column:
    who = known(consumer_type)
    return (
        F.when(who.isin("INDUSTRIAL", "INSTITUTIONAL"), F.lit("NOT_APPLICABLE"))
        .when(who == "RETAIL", F.lit("APPLICABLE"))
        .otherwise(F.lit("REVIEW"))
    )


def missing_scope_context() -> Column:
    """Context that is absent while the scope is open, comma separated."""
    open_scope = scope_status(F.col("consumer_type")) == "REVIEW"
    parts = F.array_compact(
        F.array(
            F.when(known(F.col("consumer_type")) == "UNKNOWN", F.lit("consumerType")),
            F.when(F.col("net_value").isNull() & (F.coalesce("net_unit", F.lit("")) == ""), F.lit("packageQuantity")),
        )
    )
    return F.when(open_scope, F.array_join(parts, ",")).otherwise(F.lit(""))


def _outcome(status: str, code: str | Column) -> Column:
    reason = F.lit(code) if isinstance(code, str) else code
    return F.struct(F.lit(status).alias("status"), reason.alias("reason_code"))


def _chain(cases, otherwise=None) -> Column:
    """First matching (condition, outcome) pair."""
    first, *rest = cases
    out = reduce(lambda acc, case: acc.when(*case), rest, F.when(*first))
    return out if otherwise is None else out.otherwise(otherwise)


def applicability(clause: Column, limits: Column | None = None) -> Column:
    """struct(status, reason_code) of a clause for a product, tested in fixed order.

    ``limits`` may add consumer, package, domain and quantity limits as a struct with
    the fields consumer_types, exempt_consumer_types, package_types, domains, qty_min,
    qty_max and qty_unit; the clauses of today carry none of them.
    """
    consumer, package = known(F.col("consumer_type")), known(F.col("package_type"))
    imports, domain = known(F.col("import_status")), known(F.col("domain"))
    scope = scope_status(F.col("consumer_type"))
    lacking = F.filter(clause["context_fields"], lambda f: ~has_value(F.col("context")[f]))
    review = lambda code: _outcome("REVIEW", code)
    outside = lambda code: _outcome("NOT_APPLICABLE", code)
    limited = clause["import_statuses"].isNotNull()

    cases = [
        (scope == "NOT_APPLICABLE", outside("OUT_OF_SCOPE")),
        (scope == "REVIEW", review("SCOPE_UNRESOLVED")),
        (limited & (imports == "UNKNOWN"), review("IMPORT_STATUS_UNKNOWN")),
        (limited & ~listed(clause["import_statuses"], imports), outside("IMPORT_STATUS_OUTSIDE")),
    ]
    if limits is not None:
        cases += [
            (limits["consumer_types"].isNotNull() & ~listed(limits["consumer_types"], consumer), outside("CONSUMER_OUTSIDE")),
            (listed(limits["exempt_consumer_types"], consumer), outside("CONSUMER_EXEMPT")),
            (limits["package_types"].isNotNull() & (package == "UNKNOWN"), review("PACKAGE_UNKNOWN")),
            (limits["package_types"].isNotNull() & ~listed(limits["package_types"], package), outside("PACKAGE_OUTSIDE")),
        ]
    cases += [
        (
            listed(lacking, F.lit("unitSalePriceApplicable")) & package.isin(quantity.BUNDLE_PACKAGES),
            review("BUNDLE_UNIT_PRICE_OPEN"),
        ),
        (F.size(lacking) > 0, review("CONTEXT_MISSING")),
    ]
    if limits is not None:
        ranged = limits["qty_min"].isNotNull() | limits["qty_max"].isNotNull()
        value, unit = F.col("net_value"), F.when(F.col("net_unit") != "", F.col("net_unit"))
        cases += [
            (limits["domains"].isNotNull() & (domain == "UNKNOWN"), review("DOMAIN_UNKNOWN")),
            (limits["domains"].isNotNull() & ~listed(limits["domains"], domain), outside("DOMAIN_OUTSIDE")),
            (ranged & (value.isNull() | unit.isNull()), review("QUANTITY_UNKNOWN")),
            (ranged & limits["qty_unit"].isNotNull() & (unit != limits["qty_unit"]), review("UNIT_NOT_COMPARABLE")),
            (ranged & (value < limits["qty_min"]), outside("QUANTITY_BELOW")),
            (ranged & (value > limits["qty_max"]), outside("QUANTITY_ABOVE")),
        ]
    return _chain(cases, _outcome("APPLICABLE", "APPLICABLE"))


# ---- clause evaluators: each a list of (condition, outcome), REVIEW when nothing matches ----
def _absent(name: Column) -> Column:
    return listed(F.col("absent_fields"), name)


def _presence(key: Column) -> Column:
    return _chain(
        [
            (_absent(key), _outcome("FAIL", "CONFIRMED_ABSENT")),
            (has_value(F.col("declared")[key]), _outcome("PASS", "PRESENT")),
        ],
        _outcome("REVIEW", "NO_EVIDENCE"),
    )


def _valued(present: Column, valid: Column, name: str) -> Column:
    """A value decides before a confirmed absence does."""
    return _chain(
        [
            (present & valid, _outcome("PASS", "PRESENT")),
            (present, _outcome("FAIL", "MALFORMED")),
            (_absent(F.lit(name)), _outcome("FAIL", "CONFIRMED_ABSENT")),
        ],
        _outcome("REVIEW", "NO_EVIDENCE"),
    )


def _contact(key: Column) -> Column:
    there = has_value(F.col("care_phone")) | has_value(F.col("care_email"))
    return _chain(
        [(there, _outcome("PASS", "PRESENT")), (_absent(key), _outcome("FAIL", "CONFIRMED_ABSENT"))],
        _outcome("REVIEW", "NO_EVIDENCE"),
    )


def _conditional(name: str, required: Column, undecided: Column) -> Column:
    """Present passes; otherwise the caller's flag decides whether it is needed at all."""
    return _chain(
        [
            (has_value(F.col("declared")[name]), _outcome("PASS", "PRESENT")),
            (required & _absent(F.lit(name)), _outcome("FAIL", "CONFIRMED_ABSENT")),
            (required, _outcome("REVIEW", "REQUIRED_NO_EVIDENCE")),
            (~required, _outcome("NOT_APPLICABLE", "NOT_REQUIRED")),
        ],
        undecided,
    )


def _quantity_present() -> Column:
    return F.col("net_value").isNotNull() | F.col("net_unit").isNotNull()


def _quantity_clause() -> Column:
    value, unit = F.col("net_value"), F.col("net_unit")
    valid = F.coalesce((value > 0) & (F.length(F.trim(unit)) > 0) & (value < float("inf")), F.lit(False))
    return _valued(_quantity_present(), valid, "netQuantity")


def _price_clause() -> Column:
    price = F.col("mrp")
    return _valued(price.isNotNull(), F.coalesce((price > 0) & (price < float("inf")), F.lit(False)), "mrp")


def _unit_price_clause() -> Column:
    expected = F.concat(F.lit("EXPECTED_PER_"), F.upper(F.col("basis.basis_unit")))
    undecided = _outcome("REVIEW", F.coalesce(expected, F.col("basis.reason_code")))
    return _conditional("unitSalePrice", F.col("usp_applicable"), undecided)


def _measured(key: Column) -> Column:
    """The first measurement of a clause's own target; null if it has none."""
    return F.get(F.filter("heights", lambda m: m["target"] == key), F.lit(0))


def _measurement(key: Column, rule_id: Column, thresholds: Mapping[str, float], trusted) -> Column:
    review = lambda code: _outcome("REVIEW", code)
    status, measured = F.col("measurement_status"), _measured(key)
    height = measured["physical_height"]
    limit = F.lit(None).cast("double")
    if thresholds:
        limit = map_of(thresholds)[rule_id]
    trust = F.coalesce(F.col("calibration_source").isin(list(trusted)), F.lit(False)) if trusted else F.lit(False)
    band = F.coalesce(measured["uncertainty"], F.lit(0.0))
    return _chain(
        [
            (_absent(key), _outcome("FAIL", "CONFIRMED_ABSENT")),
            (has_value(F.col("declared")[key]), _outcome("PASS", "PRESENT")),
            (status.isNull() | (status == "UNAVAILABLE"), review("NOT_MEASURED")),
            (status == "UNCALIBRATED", review("UNCALIBRATED")),
            (status == "UNCERTAIN", review("UNCERTAIN")),
            (status != "CALIBRATED", review("NO_EVIDENCE")),
            (height.isNull(), review("TARGET_NOT_MEASURED")),
            (measured["status"] == "UNCERTAIN", review("HEIGHT_UNCERTAIN")),
            (~trust, review("CALIBRATION_NOT_TRUSTED")),
            (limit.isNull(), review("NO_VERIFIED_THRESHOLD")),
            (height - band >= limit, _outcome("PASS", "MEETS_THRESHOLD")),
            (height + band < limit, _outcome("FAIL", "BELOW_THRESHOLD")),
        ],
        review("STRADDLES_THRESHOLD"),
    )


def _panel_declarations() -> Column:
    """Fused declarations that have to stand on a package and were read."""
    return F.filter(
        F.col("panel_fields"),
        lambda f: F.array_contains(F.array(*[F.lit(m) for m in MANDATORY_FIELDS]), f["field"])
        & has_value(f["value"])
        & (f["value"] != "REVIEW"),
    )


def _panel(key: Column) -> Column:
    """Location of the fused declarations relative to the detected display panel."""
    review = lambda code: _outcome("REVIEW", code)
    relevant = F.col("placed")
    some = lambda test: F.exists(relevant, test)
    relation = lambda f: F.coalesce(f["relation"], F.lit("UNKNOWN"))
    status = F.col("visual_status")
    return _chain(
        [
            (status.isNull(), _presence(key)),
            (status != "SUCCESS", review("MODEL_UNAVAILABLE")),
            (~F.coalesce(F.col("panel_found"), F.lit(False)), review("PANEL_NOT_FOUND")),
            (F.col("panel_confidence") < PANEL_MIN_CONFIDENCE, review("PANEL_LOW_CONFIDENCE")),
            (F.coalesce(F.size(relevant), F.lit(0)) == 0, review("NO_DECLARATIONS")),
            (some(lambda f: F.coalesce(f["confidence"] < FIELD_MIN_CONFIDENCE, F.lit(False))), review("FIELD_LOW_CONFIDENCE")),
            (some(lambda f: relation(f) == "OUTSIDE"), review("FIELD_OUTSIDE")),
            (some(lambda f: relation(f) == "PARTIAL"), review("FIELD_PARTIAL")),
            (some(lambda f: relation(f) != "INSIDE"), review("FIELD_RELATION_UNKNOWN")),
        ],
        _outcome("PASS", "ALL_INSIDE"),
    )


def _quantity_expression() -> Column:
    return _chain(
        [
            (_absent(F.lit("netQuantity")), _outcome("FAIL", "CONFIRMED_ABSENT")),
            (~_quantity_present(), _outcome("REVIEW", "NO_EVIDENCE")),
            (F.col("said_invalid").isNotNull(), _outcome("FAIL", F.col("said_invalid"))),
        ],
        _outcome("PASS", "PRESENT"),
    )


def _permissible_error() -> Column:
    return _chain(
        [
            (F.col("observed_value").isNull(), _outcome("REVIEW", "NO_MEASUREMENT")),
            (F.col("said_invalid").isNotNull(), _outcome("FAIL", "DECLARED_INVALID")),
            (F.col("seen_invalid").isNotNull(), _outcome("FAIL", "OBSERVED_INVALID")),
            (F.col("said.kind") != F.col("seen.kind"), _outcome("FAIL", "KIND_MISMATCH")),
        ],
        _outcome("REVIEW", "TOLERANCE_UNVERIFIED"),
    )


def _with_quantities(products: DataFrame) -> DataFrame:
    """Declared and observed quantity in base units, each worked out once per product."""
    return products.select(
        "*",
        quantity.normalize(F.col("net_value"), F.col("net_unit")).alias("said"),
        quantity.normalize(F.col("observed_value"), F.col("observed_unit")).alias("seen"),
    ).select(
        "*",
        quantity.invalid_reason(F.col("said")).alias("said_invalid"),
        quantity.invalid_reason(F.col("seen")).alias("seen_invalid"),
    )


def permissible_error(products: DataFrame) -> DataFrame:
    """Outcome of the quantity-error clause and the measured error in base units."""
    judged = _with_quantities(products).withColumn("o", _permissible_error())
    error = F.col("seen.base_value") - F.col("said.base_value")
    return judged.select(
        "product_id",
        "o.status",
        "o.reason_code",
        F.when(F.col("o.reason_code") == "TOLERANCE_UNVERIFIED", half_up(error, 6)).alias("error_base"),
    )


# Fixed value: where the clauses are published.
SOURCE_DOCUMENT = "Legal Metrology (Packaged Commodities) Rules, 2011 (as amended)"
_MEASURED = ["CALIBRATION_NOT_TRUSTED", "NO_VERIFIED_THRESHOLD", "MEETS_THRESHOLD", "BELOW_THRESHOLD", "STRADDLES_THRESHOLD"]
_PLACED = ["FIELD_LOW_CONFIDENCE", "FIELD_OUTSIDE", "FIELD_PARTIAL", "FIELD_RELATION_UNKNOWN", "ALL_INSIDE"]


def _item(field: Column, value: Column, source: str | Column, state: str | Column = "PRESENT", confidence: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    known_to = F.lit(None).cast("double") if confidence is None else confidence.cast("double")
    return F.struct(field.alias("field"), value.alias("value"), text(source).alias("source"), text(state).alias("state"), known_to.alias("confidence"))


def _evidence(number: Column, key: Column, evaluator: Column, outcome: Column) -> Column:
    """What led to an outcome: array of (field, value, source, state, confidence), empty where nothing did.

    A confirmed absence is an item without value; a declaration gives its value, read or explicit;
    a measurement its own height, in pixels where millimetres are not to be had; the panel clause every fused declaration with its place and confidence.
    """
    reason = outcome["reason_code"]
    said = F.concat_ws(" ", plain_number(F.col("net_value")), F.col("net_unit"))
    seen = F.concat_ws(" ", plain_number(F.col("observed_value")), F.col("observed_unit"))
    value = (
        F.when(key == "netQuantity", said)
        .when(key == "mrp", plain_number(F.col("mrp")))
        .when(key == "consumerCareDetails", F.concat_ws(", ", "care_phone", "care_email"))
        .otherwise(F.trim(F.col("declared")[key]))
    )
    origin = F.when(number.isin("7", "8", "9"), F.lit("explicit")).otherwise(F.lit("ocr"))
    quantity_item = _item(F.lit("netQuantity"), said, "ocr")
    placed = F.transform("placed", lambda f: _item(f["field"], f["value"], "vision", F.coalesce(f["relation"], F.lit("UNKNOWN")), f["confidence"]))
    measured = _measured(key)
    height, pixels = F.format_string("%.2f mm", measured["physical_height"]), F.concat(plain_number(measured["pixel_height"]), F.lit(" px"))
    in_pixels = reason.isin("UNCALIBRATED", "HEIGHT_UNCERTAIN") & measured["pixel_height"].isNotNull()
    return _chain(
        [
            (reason == "CONFIRMED_ABSENT", F.array(_item(key, F.lit(None).cast("string"), "ocr", "ABSENT_CONFIRMED"))),
            (reason == "NO_EVIDENCE", F.array().cast(_EVIDENCE)),
            ((evaluator == "permissible_error") & (reason != "NO_MEASUREMENT"), F.array(quantity_item, _item(F.lit("observedQuantity"), seen, "manual"))),
            (evaluator == "quantity_expression", F.array(quantity_item)),
            (reason.isin("PRESENT", "MALFORMED"), F.array(_item(key, value, origin))),
            ((evaluator == "measurement") & in_pixels, F.array(_item(key, pixels, "measurement"))),
            ((evaluator == "measurement") & reason.isin(_MEASURED), F.array(_item(key, height, "measurement"))),
            ((evaluator == "panel") & reason.isin(_PLACED), placed),
        ],
        F.array().cast(_EVIDENCE),
    )


_EVIDENCE = "array<struct<field:string,value:string,source:string,state:string,confidence:double>>"


def evaluate(products: DataFrame, rule_numbers=("6", "7", "8", "9", "11"), thresholds=None, trusted=()) -> DataFrame:
    """Checks of the given rules in one pass.

    Each check carries the evidence that led to it, its legal source and the least confidence of its
    evidence (null where none states one). Outcomes that depend on the product alone are worked out
    before the clauses are exploded. Out-of-scope products have no checks of rules 6 to 9; products with an
    open scope have none of rules 7 to 9.
    """
    ready = (
        _with_quantities(prepare(spread(products)))
        .withColumn("scope", scope_status(F.col("consumer_type")))
        .withColumn("basis", quantity.price_basis(F.col("net_value"), F.col("net_unit"), F.col("package_type")))
    )
    ready = settle(ready, "placed", _panel_declarations())
    open_review = _outcome("REVIEW", "APPLICABILITY_OPEN")
    per_product = {
        "quantity": lambda: _quantity_clause(),
        "expiry": lambda: _conditional("expiryOrUseByDate", F.col("expiry_required"), open_review),
        "price": lambda: _price_clause(),
        "contact": lambda: _contact(F.lit("consumerCareDetails")),
        "dimensions": lambda: _conditional("dimensions", F.col("dimensions_applicable"), open_review),
        "unit_price": lambda: _unit_price_clause(),
        "panel": lambda: _panel(F.lit("pdpLocation")),
        "quantity_expression": lambda: _quantity_expression(),
        "permissible_error": lambda: _permissible_error(),
    }
    used = dict.fromkeys(c[4] for c in CLAUSES if c[0] in rule_numbers)
    ready = ready.select("*", *[per_product[n]().alias(f"o_{n}") for n in used if n in per_product])
    number, key = F.col("c.rule_number"), F.col("c.clause_key")
    in_scope = (
        F.when(number == "11", F.lit(True))
        .when(number == "6", F.col("scope") != "NOT_APPLICABLE")
        .otherwise(F.col("scope") == "APPLICABLE")
    )
    rows = with_clauses(ready, rule_numbers).filter(in_scope).withColumn("fits", applicability(F.col("c")))
    per_clause = {
        "presence": lambda: _presence(key),
        "generic": lambda: _presence(key),
        "measurement": lambda: _measurement(key, F.col("c.rule_id"), thresholds or {}, trusted),
        "medical": lambda: F.when(F.col("domain") == "medical_device", _presence(key)).otherwise(
            _outcome("REVIEW", "NOT_A_MEDICAL_DEVICE")
        ),
        "review": lambda: _outcome("REVIEW", "NO_EVALUATOR"),
    }
    pick = lambda name: F.col(f"o_{name}") if name in per_product else per_clause[name]()
    evaluated = _chain([(F.col("c.evaluator") == n, pick(n)) for n in used], _outcome("REVIEW", "NO_EVALUATOR"))
    return (
        rows.withColumn("o", F.when(F.col("fits.status") == "APPLICABLE", evaluated).otherwise(F.col("fits")))
        .select(
            "product_id",
            number,
            "c.rule_id",
            key,
            "c.automation_level",
            "o.status",
            "o.reason_code",
            F.when(
                F.col("fits.status") == "APPLICABLE", _evidence(number, key, F.col("c.evaluator"), F.col("o"))
            ).otherwise(F.array().cast(_EVIDENCE)).alias("evidence"),
            F.struct(
                F.lit(SOURCE_DOCUMENT).alias("document"), number.alias("rule_number"), F.col("c.rule_id").alias("rule_id"),
                F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"),
            ).alias("source"),
        )
        .withColumn("confidence", F.array_min(F.transform("evidence", lambda e: e["confidence"])))
    )


# ---- roll-up ---------------------------------------------------------------------------
def _rank(status: Column) -> Column:
    ranks = map_of(STATUS_RANK)
    return F.when(status == "NOT_APPLICABLE", F.lit(None)).otherwise(F.coalesce(ranks[status], F.lit(2)))


def worst_status(checks: DataFrame, keys) -> DataFrame:
    """Worst executed status per key; only NOT_APPLICABLE checks give NOT_APPLICABLE."""
    worst = F.min(_rank(F.col("status")))
    return checks.groupBy(*keys).agg(
        F.when(worst.isNull(), F.lit("NOT_APPLICABLE"))
        .when(worst == 1, F.lit("FAIL"))
        .when(worst == 2, F.lit("REVIEW"))
        .otherwise(F.lit("PASS"))
        .alias("status"),
        F.count_if(F.col("status") != "NOT_APPLICABLE").alias("executed"),
    )


def overall(failed: Column, open_: Column, passed: Column) -> Column:
    """Any failure, then anything open, then at least one pass."""
    return (
        F.when(failed > 0, F.lit("NON_COMPLIANT"))
        .when(open_ > 0, F.lit("REVIEW"))
        .when(passed > 0, F.lit("COMPLIANT"))
        .otherwise(F.lit("REVIEW"))
    )


def overall_status(products: DataFrame, rule_results: DataFrame) -> DataFrame:
    """One status per product; products without any executed rule are REVIEW."""
    status = F.col("status")
    flags = rule_results.groupBy("product_id").agg(
        F.count_if(status == "FAIL").alias("failed"),
        F.count_if(~status.isin("FAIL", "PASS", "NOT_APPLICABLE")).alias("open"),
        F.count_if(status == "PASS").alias("passed"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return products.select("product_id").join(flags, "product_id", "left").select(
        "product_id", overall(zero("failed"), zero("open"), zero("passed")).alias("overall")
    )
