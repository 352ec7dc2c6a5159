"""Rule book, applicability and roll-up: golden cases and invariants."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from labelwright.operators import compliance, rulebook
from labelwright.sources.standins import spark_view


def rules_on(spark, day):
    rows = rulebook.rules_as_of(spark.createDataFrame([(dt.date.fromisoformat(day),)], "day date")).collect()
    return {r["rule_id"] for r in rows if r["clause"] == "6(10A)"}


@pytest.mark.parametrize(
    "day, expected",
    [
        ("2026-06-30", set()),
        ("2026-07-01", {"LMPC-RULE6-10A-2026"}),
        ("2027-06-30", {"LMPC-RULE6-10A-2026"}),
        ("2027-07-01", {"LMPC-RULE6-10A-2027"}),
        ("2027-07-02", {"LMPC-RULE6-10A-2027"}),
    ],
)
def test_dated_rule(spark, day, expected):
    assert rules_on(spark, day) == expected


def test_superseded_rule_leaves_even_when_dates_overlap(spark):
    rules = [("A", "1", "1", "2020-01-01", None, []), ("B", "1", "1", "2021-01-01", None, ["A"])]
    row = spark.range(1).select(
        rulebook.active_rules(F.lit("2022-01-01").cast("date"), rulebook.rule_array(rules)).alias("r")
    ).first()
    assert [r["rule_id"] for r in row["r"]] == ["B"]


@pytest.mark.parametrize(
    "statuses, expected",
    [
        (["PASS", "NOT_APPLICABLE"], "COMPLIANT"),
        (["PASS", "PENDING"], "REVIEW"),
        (["FAIL", "REVIEW"], "NON_COMPLIANT"),
        (["NOT_APPLICABLE"], "REVIEW"),
        ([], "REVIEW"),
        (["PASS", "odd"], "REVIEW"),
    ],
)
def test_overall_status(spark, statuses, expected):
    products = spark.createDataFrame([(1,)], "product_id long")
    for order in itertools.islice(itertools.permutations(statuses), 2):
        rules = spark.createDataFrame([(1, s) for s in order], "product_id long, status string")
        assert compliance.overall_status(products, rules).first()["overall"] == expected


def test_worst_status(spark):
    rows = [(1, "PASS"), (1, "REVIEW"), (2, "NOT_APPLICABLE"), (3, "PASS"), (3, "FAIL"), (4, "PENDING"), (5, "PASS")]
    got = {r["k"]: r["status"] for r in compliance.worst_status(spark.createDataFrame(rows, "k int, status string"), ["k"]).collect()}
    assert got == {1: "REVIEW", 2: "NOT_APPLICABLE", 3: "FAIL", 4: "REVIEW", 5: "PASS"}


def test_missing_evidence_never_fails(spark, sf_dir):
    """Without confirmed absences and with readable values no clause can fail."""
    facts = spark_view(spark, sf_dir, "product_facts").withColumn("confirmed_absent", F.lit(""))
    none = [c for c in facts.columns if c in ("manufacturer_name", "mrp", "net_value", "net_unit", "observed_value", "care_phone", "care_email", "dimensions")]
    for c in none:
        facts = facts.withColumn(c, F.lit(None).cast(dict(facts.dtypes)[c]))
    facts = facts.withColumn("measurement_status", F.lit(None).cast("string")).withColumn(
        "panel_fields", F.array(F.struct(F.lit("mrp").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(0.9).alias("confidence"), F.lit("INSIDE").alias("relation")))
    )
    assert compliance.evaluate(facts).filter(F.col("status") == "FAIL").count() == 0


@pytest.mark.parametrize(
    "observed, unit, status, error",
    [(None, None, "REVIEW", None), (495.0, "mL", "FAIL", None), (495.0, "g", "REVIEW", -5.0), (1.0, "abc", "FAIL", None)],
)
def test_permissible_error(spark, observed, unit, status, error):
    rows = spark.createDataFrame([(1, 500.0, "g", observed, unit)], "product_id int, net_value double, net_unit string, observed_value double, observed_unit string")
    got = compliance.permissible_error(rows).first()
    assert (got["status"], got["error_base"]) == (status, error)


def test_evidence_of_checks(spark):
    """Values, confirmed absences, measurements and panel fields stand as evidence; the context keeps three."""
    from labelwright.operators import reports
    from labelwright.plans import compliance as plans

    facts = spark_view(spark, "/root/testdata/sf0.001", "product_facts").where("consumer_type = 'RETAIL'").limit(1)
    fixed = {
        "manufacturer_name": F.lit(" Acme Foods "), "mrp": F.lit(99.5), "net_value": F.lit(500.0), "net_unit": F.lit("g"), "care_phone": F.lit("1800"), "care_email": F.lit(None).cast("string"),
        "confirmed_absent": F.lit("countryOfOrigin,commonGenericName"), "common_generic_name": F.lit(""), "measurement_status": F.lit("CALIBRATED"), "physical_height": F.lit(2.5),
        "height_status": F.lit("MEASURED"), "calibration_source": F.lit("reference_card"), "size_evidence": F.lit(None).cast("string"), "visual_status": F.lit("SUCCESS"),
        "panel_found": F.lit(True), "panel_confidence": F.lit(0.9), "mrp_relation": F.lit("OUTSIDE"), "mrp_field_confidence": F.lit(0.9), "quantity_relation": F.lit("INSIDE"),
        "date_of_packing": F.lit("2024-01-03").cast("date"), "product_id": F.lit(8).cast("bigint"),
    }
    checks = compliance.evaluate(plans._with_panel(facts.withColumns(fixed)), thresholds=plans.THRESHOLDS, trusted=plans.TRUSTED)
    rows = {r.clause_key: r for r in checks.collect()}
    items = lambda key: [(e.field, e.value, e.source, e.state) for e in rows[key].evidence]
    assert items("manufacturerName") == [("manufacturerName", "Acme Foods", "ocr", "PRESENT")]
    assert items("mrp") == [("mrp", "99.5", "ocr", "PRESENT")] and items("netQuantity") == [("netQuantity", "500 g", "ocr", "PRESENT")]
    assert items("consumerCareDetails") == [("consumerCareDetails", "1800", "ocr", "PRESENT")]
    assert items("commonGenericName") == [("commonGenericName", None, "ocr", "ABSENT_CONFIRMED")]
    assert items("letterHeight")[0][1:3] == ("2.50 mm", "measurement")
    panel = rows["pdpLocation"]
    assert panel.status == "REVIEW" and len(panel.evidence) > 3 and ("mrp", "99.5", "vision", "OUTSIDE") in items("pdpLocation")
    assert panel.confidence == min(e.confidence for e in panel.evidence if e.confidence is not None)
    assert {r.source.document for r in rows.values()} == {compliance.SOURCE_DOCUMENT}
    assert all(not r.evidence for r in rows.values() if r.reason_code == "NO_EVIDENCE" or r.status == "NOT_APPLICABLE")
    shown = {r.clause_key: r.evidence for r in reports.context_projection(checks).collect()}
    assert shown["pdpLocation"] == panel.evidence[:3]


def test_each_clause_has_its_own_measurement_and_evidence(spark):
    """A height decides only the clause it was taken for; inspection of one clause says nothing of another."""
    from labelwright.plans import compliance as plans

    facts = spark_view(spark, "/root/testdata/sf0.001", "product_facts").where("consumer_type = 'RETAIL'").limit(1)
    height = lambda target, value, state="MEASURED": F.struct(F.lit(target).alias("target"), F.lit(40.0).alias("pixel_height"), F.lit(value).cast("double").alias("physical_height"), F.lit(0.2).alias("uncertainty"), F.lit(state).alias("status"))
    heights = F.array(height("numeralLetterHeight", 2.5), height("letterHeight", 0.5), height("letterWidthRatio", 1.0, "UNCERTAIN"), height("quantityTypeDependentSize", None), height("letterHeight", 9.0))
    given = {
        "confirmed_absent": F.lit(""), "measurement_status": F.lit("CALIBRATED"), "calibration_source": F.lit("reference_card"), "package_dimensions": F.lit("10x10"),
        "measurements": heights, "explicit": F.create_map(F.lit("legibility"), F.lit(" seen ")),
    }

    def checks(**more):
        rows = compliance.evaluate(plans._with_panel(facts).withColumns({**given, **more}), ["7", "9"], plans.THRESHOLDS, plans.TRUSTED).collect()
        return {r.clause_key: (r.status, r.reason_code, [(e.value, e.source) for e in r.evidence]) for r in rows}

    got = checks()
    assert got["numeralLetterHeight"] == ("PASS", "MEETS_THRESHOLD", [("2.50 mm", "measurement")])
    assert got["letterHeight"] == ("FAIL", "BELOW_THRESHOLD", [("0.50 mm", "measurement")])
    assert got["letterWidthRatio"] == ("REVIEW", "HEIGHT_UNCERTAIN", [("40 px", "measurement")])
    assert got["quantityTypeDependentSize"] == got["smallPackage"] == ("REVIEW", "TARGET_NOT_MEASURED", [])
    assert got["legibility"] == ("PASS", "PRESENT", [("seen", "explicit")])
    assert got["prominence"] == ("REVIEW", "NO_EVIDENCE", [])
    raw = checks(measurement_status=F.lit("UNCALIBRATED"))
    assert raw["letterHeight"] == ("REVIEW", "UNCALIBRATED", [("40 px", "measurement")])
    assert raw["smallPackage"] == ("REVIEW", "UNCALIBRATED", [])
