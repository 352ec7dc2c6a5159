"""Golden cases and invariants of the other operators."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from labelwright.functions.plan import settle
from labelwright.operators import annotations, audit, boxes, complaints, dashboards, dedup, fields, filters, nutrition, paging, ranking, splits, telemetry
from labelwright.sources import files
from labelwright.streaming import jobs


def detections(spark, lines):
    rows = [("p", i, text, 0.9, 0.0, 20.0 * i, 100.0, 20.0 * i + 15) for i, text in enumerate(lines)]
    return spark.createDataFrame(rows, "image_id string, det_id long, text string, confidence double, x0 double, y0 double, x1 double, y1 double")


def test_attention_area(spark):
    rows = [(1, "NON_COMPLIANT", 28.6, 77.2), (1, "REVIEW", 28.601, 77.201), (1, "COMPLIANT", 28.602, 77.199), (1, "NON_COMPLIANT", 10.0, 10.0), (1, "REVIEW", None, 1.0)]
    got = dashboards.attention_areas(spark.createDataFrame(rows, "user_id int, compliance_status string, latitude double, longitude double")).collect()
    assert [(r["n"], r["score"]) for r in got] == [(3, 2)]


def test_empty_summary_is_one_row_of_zeros(spark):
    empty = spark.createDataFrame([], "user_id int, compliance_status string")
    assert tuple(dashboards.grand_summary(empty).first()) == (0, 0, 0, 0, 0)


def test_page_bounds():
    assert paging.clamp_page("0", "500") == (1, 100)
    assert paging.clamp_page("x", None) == (1, 20)
    assert paging.clamp_page("-3", "-1") == (1, 1)


def test_day_filter_rejects_nonsense(spark):
    df = spark.range(1).withColumn("created_at", F.current_timestamp())
    assert filters.since_days(df, "2024-01-01", "all") is df
    for bad in ("0", "-1", "abc"):
        with pytest.raises(ValueError):
            filters.since_days(df, "2024-01-01", bad)


def test_search_is_literal(spark):
    df = spark.createDataFrame([("a.c",), ("abc",)], "n string")
    assert [r["n"] for r in filters.text_search(df, "A.C", ["n"]).collect()] == ["a.c"]


def test_labelled_fields_of_plain_lines(spark):
    d = detections(spark, ["MRP Rs 250.00", "Net Quantity 500 g", "Batch: ABC123"])
    got = {r["field"]: r["value"] for r in boxes.labelled_values(d, ("mrp", "netQuantity", "batchLotNumber")).collect()}
    assert got == {"mrp": "250.00", "netQuantity": "500 g", "batchLotNumber": "ABC123"}


def test_brand_and_product_scores(spark):
    """Scores added by hand: size, confidence, trade mark or label, wording, nearness."""
    small = lambda i, texts: [(i, 10 + k, t, 0.95, 0.0, 400 + 20.0 * k, 100.0, 415 + 20.0 * k) for k, t in enumerate(texts)]
    rows = [
        ("a", 0, "Acme®", 0.95, 0.0, 0.0, 100.0, 40.0),  # much larger 2, sure 1, mark 4
        ("a", 1, "Detergent Powder", 0.95, 0.0, 60.0, 150.0, 90.0),  # larger 1, sure 1, commodity 3, near the brand 2
        *small("a", ["Net Quantity 500 g", "MRP Rs 99", "Batch: A1"]),
        ("b", 0, "Fresh", 0.95, 0.0, 0.0, 100.0, 40.0),  # 2 + 1 + letters 1, promotional -4: no brand
        ("b", 1, "Basmati Rice", 0.95, 0.0, 900.0, 100.0, 915.0),  # sure 1, commodity 3
        *small("b", ["Net Quantity 500 g", "MRP Rs 99"]),
        ("c", 0, "Brand: Zed", 0.95, 0.0, 0.0, 100.0, 20.0),  # sure 1, label 4
        ("c", 1, "Foods", 0.55, 300.0, 300.0, 400.0, 320.0),
        *small("c", ["MRP Rs 99"]),
        *small("d", ["MRP Rs 99", "1234567", "x"]),
    ]
    d = spark.createDataFrame(rows, "image_id string, det_id long, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    out = fields.brand_and_product(d, spark.createDataFrame([], "image_id string, manufacturer string"))
    got = {(r.image_id, r.field): (r.name, r.status, r.confidence, r.score) for r in out.collect()}
    assert got == {
        ("a", "brandName"): ("Acme", "PASS", 0.95, 7), ("a", "productName"): ("Detergent Powder", "PASS", 0.95, 7),
        ("b", "productName"): ("Basmati Rice", "REVIEW", 0.95, 4), ("c", "brandName"): ("Zed", "PASS", 0.95, 5),
    }


@pytest.mark.parametrize(
    "texts, expected",
    [
        (["Acme", "x", "Use by", "12/08/2026", "y"], (0.3, 0.3, 0.6)),
        (["Acme", "x", "q", "y", "12/08/2026"], (0.45, 0.45, 0.45)),
        (["Acme", "Mfd", "12/08/2026", "B. No 7", "q", "r"], (0.2, 0.3, 0.3)),
        (["Acme", "B. No 7", "12/08/2026", "y", "z", "q"], (0.0, 0.3, 0.3)),
        (["Acme", "batch", "12/08/2026", "y", "z"], None),
        (["12/08/1985"], None),
    ],
)
def test_dates_without_label(spark, texts, expected):
    """Base, word nearby, lower part of the image, lot number nearby; another field's label refuses the date."""
    got = {r.field: (r.value, r.confidence, r.status) for r in fields.implicit_values(detections(spark, texts), ("dates",)).collect()}
    names = ("dateOfManufacture", "dateOfPacking", "expiryOrUseByDate")
    status = lambda c: "PASS" if c >= 0.8 else "REVIEW" if c >= 0.55 else "UNKNOWN"
    assert got == ({} if expected is None else {n: ("2026-08-12", c, status(c)) for n, c in zip(names, expected, strict=True)})


def test_signals_of_values_without_label(spark):
    """What made a score is told, and whether a neighbour of a price says that taxes are included."""
    told = lambda texts, kinds: {(r.field, r.value): (r.inclusive, r.signals) for r in fields.implicit_values(detections(spark, texts), kinds).collect()}
    assert told(["Acme", "₹129", "incl of taxes", "Rs 7", "q", "r", "s", "t"], ("mrp",)) == {
        ("mrp", "129"): (True, "implicit_currency_symbol,nearby_money_candidate"), ("mrp", "7"): (True, "implicit_currency_symbol,nearby_money_candidate"),
    }
    assert told(["Price", "45", "x", "y", "z", "q"], ("mrp",)) == {("mrp", "45"): (False, "bare_number_near_price_label,nearby_price_word,bare_number_capped_review")}
    assert told(["x", "y", "z", "q", "Net Weight", "100 g"], ("netQuantity",)) == {("netQuantity", "100.000 g"): (None, "recognized_metric_unit,compatible_quantity_range,nearby_net_quantity_word,declaration_region")}
    assert told(["Mfd", "08/2026", "B. No 7", "q", "r", "s"], ("dates",)) == {
        ("dateOfManufacture", "2026-08-01"): (None, "month_year_format,nearby_manufacturing_word,batch_label_nearby_penalty"),
        ("dateOfPacking", "2026-08-01"): (None, "month_year_format,no_direct_label"), ("expiryOrUseByDate", "2026-08-01"): (None, "month_year_format,no_direct_label"),
    }


def test_tax_wording_anywhere_on_the_image(spark):
    noted = detections(spark, ["MRP Rs 250.00", "far away", "x", "y", "z", "(Inclusive of all taxes)"])
    plain = detections(spark, ["MRP Rs 99", "taxes extra"])
    got = [fields.labelled_prices(d).first() for d in (noted, plain)]
    assert [(r.value, r.currency, r.inclusive) for r in got] == [(250.0, "INR", True), (99.0, "INR", False)]


def test_labelled_dates(spark):
    d = detections(spark, ["Mfg Date: 15/08/2025", "nothing", "x", "y", "z", "w", "Use By: 01/2027", "Best Before: 31.12.2026"])
    got = {r["field"]: r["value"] for r in boxes.labelled_values(d, ("dateOfManufacture", "expiryOrUseByDate")).collect()}
    assert got == {"dateOfManufacture": "2025-08-15", "expiryOrUseByDate": "2027-01-01"}


def test_manufacturer_stops_at_labels(spark):
    d = detections(spark, ["Manufactured by Good Foods", "Sector 5", "Batch No 12", "far away"])
    assert fields.manufacturers(d).first()["manufacturer"] == "Good Foods Sector 5"


def test_neighbours_match_brute_force(spark):
    rng = random.Random(3)
    rows = [("i%d" % (k % 3), k, "t", 0.9, x, y, x + 40.0, y + 12.0) for k, (x, y) in enumerate((rng.uniform(0, 300), rng.uniform(0, 900)) for _ in range(300))]
    d = spark.createDataFrame(rows, "image_id string, det_id long, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {(r["a"]["det_id"], r["b"]["det_id"]) for r in boxes.neighbours(boxes.as_boxes(d, "a"), d, F.lit(90.0)).collect()}
    want = {
        (a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[1] != b[1] and 0 < ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) ** 0.5 < 90
    }
    assert got == want


@pytest.mark.parametrize("threshold, bands", [(10, 4), (10, 3), (18, 8), (18, 6), (9, 5)])
def test_close_pairs_match_brute_force(spark, threshold, bands):
    rng = random.Random(threshold * 10 + bands)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 20))) for _ in range(4)]
    values = [v if v < 1 << 63 else v - (1 << 64) for v in values]
    rows = [(i, v) for i, v in enumerate(dict.fromkeys(values))]
    df = spark.createDataFrame(rows, "first long, fp long")
    got = {(r["first"], r["o_first"]) for r in dedup.close_pairs(df, threshold, bands).collect()}
    want = {(j, i) for i, a in rows for j, b in rows if i < j and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= threshold}
    assert got == want and want


def test_hot_fingerprint_is_one_entry(spark):
    """A third of all images with one fingerprint: each is a copy of the first, without pairs among them."""
    df = spark.range(3000).select(F.col("id").alias("image_id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id")).alias("fp"))
    out = dedup.near_duplicates(df, dedup.NEAR_BITS)
    copies = out.filter((F.col("image_id") % 3 == 0) & (F.col("image_id") > 0))
    assert copies.filter((F.col("duplicate_of") == 0) & (F.col("distance") == 0)).count() == 999
    assert out.count() == 3000


def test_hamming_of_known_hashes(spark):
    row = spark.sql("SELECT conv('f0f0f0f0f0f0f0f0', 16, -10) AS a, conv('ffffffffffffffff', 16, -10) AS b")
    assert row.select(dedup.hamming(F.col("a").cast("long"), F.col("b").cast("long")).alias("d")).first()["d"] == 32


def test_numbers_are_gap_free_and_ordered(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    rows = ranking.numbered(df, ["k"], "n", start=5).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(6, 1006))


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [float(i) for i in range(1, 20)], [5.0] * 7 + [9.0]])
def test_exclusive_quantile(spark, values):
    import statistics

    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    at = lambda n: ranking.exclusive_place(n, 19, 20)[0]
    found = ranking.order_statistics(df, ["k"], "v", {"low": at, "high": lambda n: at(n) + 1})
    got = found.select(ranking.exclusive_quantile(F.col("low"), F.col("high"), F.col("total"), 19, 20).alias("q")).first()["q"]
    want = statistics.quantiles(values, n=20)[18] if len(values) > 1 else 0.0
    assert got == pytest.approx(want)


def test_order_statistics_of_any_values(spark, monkeypatch):
    """Exact ranks of continuous, tied, tiny and huge values, in groups of which one holds most rows."""
    monkeypatch.setattr(ranking, "BINS", 8)
    rnd = random.Random(3)
    groups = {
        "hot": [rnd.gauss(0, 1e3) for _ in range(3000)] + [17.0] * 2000,
        "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-12, 12) for _ in range(300)] + [1.7e308, -1.7e308, 5e-324, 0.0],
        "tie": [2.5] * 40,
        "one": [-1.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranks = {"least": lambda n: F.lit(1), "third": lambda n: F.floor(n / 3) + 1, "median": lambda n: F.floor((n + 1) / 2), "past": lambda n: n + 5}
    got = {r.k: r for r in ranking.order_statistics(df, ["k"], "v", ranks).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        assert (got[k].total, got[k].least, got[k].third, got[k].median, got[k].past) == (n, vs[0], vs[n // 3], vs[(n + 1) // 2 - 1], vs[-1])
    whole = ranking.order_statistics(df, [], "v", {"median": lambda n: F.floor((n + 1) / 2)}).first()
    every = sorted(v for vs in groups.values() for v in vs)
    assert whole["median"] == every[(len(every) + 1) // 2 - 1]


def test_split_is_disjoint_and_exact(spark):
    products = spark.range(503).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_id"))
    out = splits.seeded_split(products, "s")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 402, "val": 101}
    assert out.select("product_id").distinct().count() == 503
    assert out.exceptAll(splits.seeded_split(products, "s")).count() == 0


def test_polynomial_hash_wraps_like_32_bits(spark):
    def wrap(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h)

    from labelwright.functions.hashing import polynomial

    names = ["", "a", "product_001", "product_zzzzzzzzzzzz", "Q" * 40]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", polynomial(F.col("n")).alias("h"))
    assert {r["n"]: r["h"] for r in df.collect()} == {n: wrap(n) for n in names}


def test_transitions(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, 1, t(1), "SUBMITTED"), (1, 2, t(3), "UNDER_REVIEW"), (1, 3, t(4), "RESOLVED"), (1, 4, t(5), "SUBMITTED")]
    got = complaints.transitions(spark.createDataFrame(rows, "complaint_id int, seq int, changed_at timestamp, status string")).orderBy("seq").collect()
    assert [r["legal"] for r in got] == [True, True, True, False]
    assert got[1]["hours"] == 2.0


def test_recommendations(spark):
    scan = [("s", "biscuits", {"sugars": 20.0, "saturatedFat": 10.0, "energy": 450.0}, 0.9)]
    scans = spark.createDataFrame(scan, "scan_id string, category string, values map<string,double>, category_confidence double")

    def page(*products):
        rows = [(i, "biscuits", name, {f"{k}_100g": v for k, v in n.items()}, float(-i)) for i, (name, n) in enumerate(products)]
        return nutrition.comparable(spark.createDataFrame(rows, "product_id long, category string, name string, nutriments map<string,double>, popularity double"))

    better = ("better", {"sugars": 10.0, "energy-kcal": 400.0})
    worse = ("worse", {"sugars": 40.0, "energy-kcal": 500.0})
    other = ("other", {"fiber": 3.0})
    got = nutrition.recommendations(nutrition.score_scans(scans, page(better, worse, other))).collect()
    assert [r["candidate_id"] for r in got] == [0]
    status = lambda *p: nutrition.recommendation_status(scans, nutrition.score_scans(scans, page(*p))).first()["status"]
    assert status(worse) == "scanned_competitive"
    assert status(other) == "no_comparable_products"


def test_recommendations_in_blocks(spark, monkeypatch):
    """The same five whatever the blocks, with a front that most products are in and products that tie."""
    rnd = random.Random(4)
    pick = lambda: {k: float(rnd.randrange(1, 40)) for k in ("sugars", "saturated-fat", "energy-kcal", "fat") if rnd.random() > 0.1}
    made = [(i, "biscuits", f"p{i}", {f"{k}_100g": v for k, v in pick().items()}, float(rnd.randrange(5))) for i in range(700)]
    products = spark.createDataFrame(made, "product_id long, category string, name string, nutriments map<string,double>, popularity double")
    scans = products.where("product_id < 150").select(
        F.concat(F.lit("s"), "product_id").alias("scan_id"), "category", nutrition.canonical_nutriments(F.col("nutriments")).alias("values"), F.lit(0.9).alias("category_confidence")
    )
    weights = nutrition.PROFILES["biscuits"]
    keep = {"sugars": "sugars", "saturatedFat": "saturated-fat", "energy": "energy-kcal", "totalFat": "fat"}

    def score(scan, product):
        pairs = [(w, max(-1, min(1, (scan[k] - product[k]) / scan[k]))) for k, (w, _) in weights.items() if k in scan and k in product]
        if pairs:
            return math.floor(math.floor(sum(w * d for w, d in pairs) / sum(w for w, _ in pairs) * 1e9 + 0.5) / 1e9 * 1000 + 0.5) / 1000

    values = {i: {k: n[f"{f}_100g"] for k, f in keep.items() if f"{f}_100g" in n} for i, _, _, n, _ in made}
    popularity = {i: p for i, _, _, _, p in made}
    want = {}
    for i in range(150):
        found = [(-x, -popularity[j], j) for j, v in values.items() if v and (x := score(values[i], v)) is not None and x > 0.02]
        want[f"s{i}"] = [j for *_, j in sorted(found)[:5]]
    for block, part in ((2048, 4096), (37, 20)):
        monkeypatch.setattr(nutrition, "BLOCK", block)
        monkeypatch.setattr(nutrition, "SCANS", part)
        rows = nutrition.recommendations(nutrition.score_scans(scans, nutrition.comparable(products))).collect()
        got = {k: [] for k in want}
        for r in sorted(rows, key=lambda r: r.position):
            got[r.scan_id].append(r.candidate_id)
        assert got == want


def test_status_from_few_products(spark, monkeypatch):
    """A scan that one product settles does not meet the others; the statuses are those of all scores."""
    monkeypatch.setattr(nutrition, "PROBE", 20)
    rnd = random.Random(6)
    made = [(i, "biscuits", f"p{i}", {f"{k}_100g": float(rnd.randrange(1, 40)) for k in ("sugars", "fat")[: 1 + i % 2]}, float(i)) for i in range(400)]
    products = spark.createDataFrame(made, "product_id long, category string, name string, nutriments map<string,double>, popularity double")
    values = nutrition.canonical_nutriments(F.col("nutriments"))
    scans = products.select(F.col("product_id").alias("scan_id"), "category", values.alias("values"), F.lit(0.9).alias("category_confidence"))
    best = [(1000, "biscuits", {"sugars": 0.5, "totalFat": 0.5}, 0.9), (1001, "biscuits", {"fibre": 3.0}, 0.9), (1002, "cakes of none", {"sugars": 3.0}, 0.9)]
    scans = scans.unionByName(spark.createDataFrame(best, scans.schema))
    front = nutrition.comparable(products)
    asked = []
    score = nutrition.score_scans
    monkeypatch.setattr(nutrition, "score_scans", lambda s, f: asked.append(s.count()) or score(s, f))
    status = lambda scored: {r.scan_id: r.status for r in nutrition.recommendation_status(scans, scored).collect()}
    assert status(nutrition.best_scores(scans, front)) == status(score(scans, front))
    assert asked[0] == 403 and asked[1] < 100


def test_learning_score(spark):
    row = lambda conf, consent: (1, consent, "proprietary", conf, "1", "1 g", "PASS", "food", False)
    schema = "sample_id int, consent string, source_type string, confidence double, mrp string, net_quantity string, compliance_status string, category string, user_corrected boolean"
    got = lambda *a: annotations.learning_score(spark.createDataFrame([row(*a)], schema)).first()
    assert got(0.4, "allowed_for_training")["candidate"] is True
    assert got(0.4, "inference_only")["candidate"] is False
    assert got(0.9, "allowed_for_training")["score"] == 0


def test_rollback_after_failures(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, i), "d1", "FAILURE" if i < 15 else "SUCCESS") for i in range(20)]
    alerts = telemetry.rollback_alerts(spark.createDataFrame(rows, "ts timestamp, deployment_id string, inference_status string"), "1 hour")
    assert alerts.first()["error_rate"] == 0.75


@pytest.mark.parametrize("days", [2, 5, 64])
def test_triggers_of_long_histories(spark, monkeypatch, days):
    """Stretches of any length give what one fold over a key's whole history gives."""
    monkeypatch.setattr(telemetry, "STRETCH_DAYS", days)
    rnd = random.Random(days)
    first, rows = dt.datetime(2023, 12, 30, 5), []
    for key, share in (("dense", 0.9), ("some", 0.2), ("rare", 0.01), (None, 0.1), ("once", 0.0)):
        rows += [(key, first + dt.timedelta(hours=h), "QUALITY_DEGRADED" if rnd.random() < share else "HEALTHY") for h in range(60 * 24)]
    rows += [("once", first + dt.timedelta(hours=700), "QUALITY_DEGRADED"), ("dense", first + dt.timedelta(days=400), "QUALITY_DEGRADED")]
    want, last = set(), {}
    for key, at, status in sorted(rows, key=lambda r: r[1]):
        if status == "QUALITY_DEGRADED" and (key not in last or at - last[key] >= dt.timedelta(hours=24)):
            want.add((key, at))
            last[key] = at
    df = spark.createDataFrame(rows, "model_version string, window_start timestamp, status string")
    out = telemetry.retrain_triggers(df, ["model_version"]).collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want
    assert telemetry.retrain_triggers(df.where("status = 'HEALTHY'"), ["model_version"]).count() == 0


def test_deployment_reaches_production_or_rolls_back(spark):
    good = [("g", dt.date(2024, 1, d), 100, 0.01) for d in range(1, 9)]
    bad = [("b", dt.date(2024, 1, 1), 100, 0.01), ("b", dt.date(2024, 1, 2), 100, 0.2), ("b", dt.date(2024, 1, 3), 100, 0.0)]
    few = [("f", dt.date(2024, 1, d), 60, 0.0) for d in (1, 2, 3)]
    df = spark.createDataFrame(good + bad + few, "deployment_id string, day date, samples long, error_rate double")
    got = {r["deployment_id"]: r["status"] for r in telemetry.deployment_states(df).collect()}
    assert got == {"g": "PRODUCTION", "b": "ROLLED_BACK", "f": "CANARY_1"}


def test_deployment_stream_in_parts_equals_the_fold(spark, tmp_path):
    """Days in any order within the delay, over several runs of one checkpoint; idle deployments are closed."""
    rnd = random.Random(3)
    first = dt.date(2024, 1, 1)
    rows = [(f"d{k}", first + dt.timedelta(days=d), rnd.choice([20, 60, 120]), rnd.choice([0.0, 0.01, 0.02, 0.06 if k % 3 == 0 else 0.03])) for k in range(12) for d in range(0, 12 + k)]
    rows += [("old", first, 100, 0.0), ("late", first + dt.timedelta(days=70), 5, 0.0)]
    schema = "deployment_id string, day date, samples long, error_rate double"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [(0, 9), (10, 15), (16, 80)]
    for lo, hi in parts:
        part = [r for r in rows if lo <= (r[1] - first).days <= hi]
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.deployment_states(jobs.read_parquet_stream(spark, source, schema))
        changes = jobs.run_to_end(stream, "deployments", mode="update", sink=sink)
    got = {r.deployment_id: (r.status, r.traffic, r.samples, r.reports, r.closed) for r in jobs.latest_states(changes).collect()}
    want = telemetry.deployment_states(spark.createDataFrame([r for r in rows if r[0] != "late"], schema)).collect()
    assert got == {r.deployment_id: (r.status, r.traffic, r.samples, r.reports, True) for r in want}


def test_connected_groups_of_a_chain(spark):
    fps, v = [], 0
    for i in range(12):
        fps.append((i, v))
        v ^= 0b11111 << (5 * i)
    fps.append((99, -1))
    out = dedup.duplicate_groups(spark.createDataFrame(fps, "image_id long, fp long"), bits=5)
    got = {r["image_id"]: r["group_id"] for r in out.collect()}
    assert {got[i] for i in range(12)} == {0} and got[99] == 99


def test_missing_manifest_reads_as_empty(spark):
    assert files.manifests(spark, "/tmp/spark-no-such-folder/manifest.json").count() == 0


def test_settle_evaluates_once(spark):
    plan = settle(spark.range(5), "x", F.col("id") + 1).filter(F.col("x") > 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan


def test_failed_readings_are_uncertain(spark):
    df = spark.createDataFrame([(False, "1", None), (True, None, "x")], "failed boolean, a string, b string")
    got = {r["field"]: (r["detected"], r["missing"], r["uncertain"]) for r in audit.field_coverage(df, ["a", "b"]).collect()}
    assert got == {"a": (1, 0, 1), "b": (1, 1, 0)}


def test_versions_are_published_whole_or_not(spark, tmp_path):
    rows = [(k, f"product_{k % 40}", "TRAINING_ELIGIBLE", None) for k in range(200)]
    schema = "sample_id long, product_id string, candidate_status string, split string"
    good = spark.createDataFrame(rows, schema)
    leak = spark.createDataFrame(rows + [(900, "product_1", "TRAINING_ELIGIBLE", s) for s in ("train", "test")], schema)
    weak = spark.createDataFrame(rows + [(900, "product_1", None, None)], schema)
    folder = str(tmp_path)
    assert splits.publish_version(leak, "a", folder)["status"] == "REFUSED_LEAKAGE" and splits.published(spark, "a", folder) is None
    assert splits.publish_version(weak, "a", folder)["status"] == "REFUSED_NOT_ELIGIBLE" and splits.published(spark, "a", folder) is None
    audit = splits.publish_version(good, "a", folder)
    assert (audit["status"], audit["samples"], audit["products"], audit["leaking"]) == ("PUBLISHED", 200, 40, 0)
    out = splits.published(spark, "a", folder)
    assert out.count() == 200 and {tuple(r) for r in out.select("candidate_status", "dataset_version").distinct().collect()} == {("USED_IN_DATASET", "a")}
    with pytest.raises(FileExistsError):
        splits.publish_version(good.limit(5), "a", folder)
    assert splits.published(spark, "a", folder).count() == 200
    # the order of samples does not matter to the fingerprint, a sample less does
    again = splits.version_audit(splits.dataset_version(good.orderBy(F.desc("sample_id")), "b"), "b").first()
    assert again["fingerprint"] == audit["fingerprint"]
    assert splits.version_audit(splits.dataset_version(good.where("sample_id > 0"), "b"), "b").first()["fingerprint"] != audit["fingerprint"]


def test_array_scan_of_any_layout(spark, tmp_path):
    """Objects with braces, quotes and backslashes in strings, nested, cut anywhere by small splits."""
    rnd = random.Random(6)
    odd = ["}", "{", '"', "\\", '\\"', "},{", "[", "]", "\n", "é", '{"a": "}"}', ""]
    want = {}
    for name in ("a", "b"):
        rows = [{"k": i, "s": "".join(rnd.choices(odd, k=rnd.randrange(12))), "n": {"m": [{"x": "}" * (i % 3)}], "e": {}}} for i in range(400)]
        layout = {"indent": 2} if name == "a" else {"ensure_ascii": False}
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, **layout) + "\n", encoding="utf-8")
        want[name] = rows
    (tmp_path / "c.json").write_text("[]", encoding="utf-8")
    (tmp_path / "d.json").write_text("", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = files.object_texts(spark, str(tmp_path))
        got = sorted((r.file[-6:-5], r.place, json.loads(r.text)) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(f, r) for f, _, r in got] == [(f, r) for f in ("a", "b") for r in want[f]]


def test_array_scan_skips_broken_objects(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"annotationId": 1}, {"annotationId": tru}, {"annotationId": 3, "provenance": "a}"}, {"annotationId": 4', encoding="utf-8")
    got = {(r.annotationId, r.provenance) for r in files.annotation_array(spark, str(tmp_path)).collect()}
    assert got == {(1, None), (3, "a}")}


def _scattered(n, seed):
    """Fingerprints with neighbours at all distances, many of them with a common half."""
    rng = random.Random(seed)
    values = [rng.getrandbits(32) if i % 3 else rng.getrandbits(63) for i in range(n)]
    values += [v ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 20))) for v in values]
    rng.shuffle(values)
    return list(enumerate(values))


def test_nearest_fingerprints_by_brute_force_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SMALL_BLOCK", 100)
    rows = _scattered(300, 5)
    out = dedup.near_duplicates(spark.createDataFrame(rows, "image_id long, fp long"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.image_id: (r.duplicate_of, r.distance) for r in out.collect()}
    for i, v in rows:
        near = min((((v ^ w).bit_count(), j) for j, w in rows[:i]), default=(99, None))
        assert got[i] == ((near[1], near[0]) if near[0] <= 18 else (None, None))


def test_groups_by_brute_force_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SMALL_BLOCK", 100)
    rows = _scattered(300, 6)
    out = dedup.duplicate_groups(spark.createDataFrame(rows, "image_id long, fp long"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    root = {i: i for i, _ in rows}
    for i, v in rows:
        for j, w in rows[:i]:
            if (v ^ w).bit_count() <= 9 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    assert {r.image_id: r.group_id for r in out.collect()} == root


def test_drift_of_a_large_window_is_exact(spark):
    """More rows in a window than a sketch would hold apart."""
    rows = spark.range(150_000).select(
        F.timestamp_seconds(F.col("id") % 80_000).alias("ts"), (F.col("id") * 7919 % 150_000).cast("double").alias("latency_ms"), (F.col("id") % 4).alias("prediction_count")
    )
    row = telemetry.drift_of_counts(telemetry.latency_counts(rows, "1 day")).collect()
    assert [(r.p95_ms, r.no_detection_rate) for r in row] == [(142_499.0, 0.25)]


@pytest.mark.parametrize("query", ["brand_product", "label_value_join", "extract_manufacturer", "implicit_score"])
def test_label_readers_broadcast_nothing(spark, sf_dir, query):
    """Sizes estimated from small part files say nothing about the boxes made of them."""
    import __spark_entry__

    plan = __spark_entry__.queries()[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan or query == "label_value_join"
    assert "Broadcast" not in plan


@pytest.mark.parametrize("view", ["product_facts", "product_texts", "label_left", "label_right", "text_lines"])
def test_costly_views_are_dealt_over_cores(spark, sf_dir, view):
    from labelwright.sources.standins import spark_view

    assert "REPARTITION_BY_COL" in spark_view(spark, sf_dir, view)._jdf.queryExecution().executedPlan().toString()


def test_folders_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).coalesce(1).select((F.col("id") % 200).alias("k"), F.col("id").cast("string").alias("value"))
    files.write_folders(rows, "k", str(tmp_path / "out"))
    written = [p.name.split("-")[1] for p in (tmp_path / "out").rglob("part-*")]
    assert len(written) == 200 and len(set(written)) > 8
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted(int(r.value) for r in back.collect()) == list(range(400))
