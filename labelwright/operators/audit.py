"""Profiles and quality reports over images, readings and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions.rounding import half_up, percent
from labelwright.operators import ranking


def stage_timings(runs: DataFrame) -> DataFrame:
    whole = runs.groupBy("run_id").agg(F.sum("duration_ms").alias("duration_ms")).select(F.lit("TOTAL").alias("stage"), "duration_ms")
    per_stage = runs.select("stage", "duration_ms").unionByName(whole).groupBy("stage").agg(
        F.count("*").alias("runs"), F.sum("duration_ms").alias("total_ms"), half_up(F.avg("duration_ms"), 4).alias("avg_ms"), F.max("duration_ms").alias("max_ms")
    )
    # A window over the aggregated stages, of which there is a handful.
    every = F.max(F.when(F.col("stage") == "TOTAL", F.col("total_ms"))).over(W.partitionBy())
    return per_stage.withColumn("share_pct", half_up(F.col("total_ms") * 100 / every, 2))


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, side by side, without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def image_profile(images: DataFrame) -> DataFrame:
    """Counts, mean and true median of sizes, products with and without a declaration view."""
    products = images.groupBy("product_id").agg(F.bool_or(F.col("view") == "declaration").alias("declared"))
    p = products.agg(F.count("*").alias("products"), F.count_if("declared").alias("with_declaration"), F.count_if(~F.col("declared")).alias("missing_declaration"))
    i = images.agg(
        F.count("*").alias("images"),
        *[F.count_if(F.col("view") == v).alias(v) for v in ("front", "back", "declaration")],
        F.count_if(F.coalesce("category", F.lit("unknown")) == "unknown").alias("unknown_category"),
        half_up(F.avg("width"), 1).alias("avg_width"),
        half_up(F.avg("height"), 1).alias("avg_height"),
        F.percentile("width", F.lit(0.5)).alias("median_width"),
        F.percentile("height", F.lit(0.5)).alias("median_height"),
    )
    return one_row(i, p)


def image_audit(images: DataFrame) -> DataFrame:
    """One row of extremes, means and buckets over all images."""
    mp = F.col("width") * F.col("height") / 1000000.0
    w, h, sigma = F.col("width"), F.col("height"), F.col("sigma")
    n = F.count_if
    poor = (mp < 0.3) | (sigma < 15)
    good = ~poor & (mp > 1.0) & (sigma > 40)
    useful = (w <= h) & (sigma > 20) & (mp > 0.3)
    weak = ~useful & (w > h) & (mp < 0.3)
    return images.agg(
        F.count("*").alias("images"),
        *[f(c).alias(f"{name}_{c}") for c in ("width", "height", "bytes") for name, f in (("min", F.min), ("max", F.max))],
        half_up(F.avg(mp), 4).alias("avg_mp"),
        half_up(F.avg("bytes"), 2).alias("avg_bytes"),
        n(mp < 0.3).alias("mp_tiny"),
        n((mp >= 0.3) & (mp < 0.75)).alias("mp_small"),
        n((mp >= 0.75) & (mp < 1.5)).alias("mp_medium"),
        n((mp >= 1.5) & (mp < 3.0)).alias("mp_large"),
        n(mp >= 3.0).alias("mp_huge"),
        n(w > h).alias("landscape"),
        n(w < h).alias("portrait"),
        n(w == h).alias("square"),
        n(poor).alias("readability_poor"),
        n(good).alias("readability_good"),
        n(~poor & ~good).alias("readability_moderate"),
        n(useful).alias("panel_useful"),
        n(weak).alias("panel_poor"),
        n(~useful & ~weak).alias("panel_uncertain"),
        n(sigma > 10).alias("packaging_useful"),
        n(F.coalesce(F.col("magic") != F.col("extension"), F.lit(False))).alias("format_mismatches"),
    )


def duplicate_stats(images: DataFrame) -> DataFrame:
    """Exact duplicates: distinct hashes, groups, surplus files and their share as text."""
    groups = images.groupBy("sha256").agg(F.count("*").alias("n"))
    return groups.agg(
        F.count("*").alias("unique_hashes"), F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_files"), F.sum("n").alias("_all"),
    ).select("unique_hashes", "duplicate_groups", "duplicate_files",
             F.concat(F.format_string("%.1f", percent(F.col("duplicate_files"), F.col("_all"))), F.lit("%")).alias("duplicate_pct"))


def ocr_baseline(readings: DataFrame) -> DataFrame:
    """Per view: attempts, results, confidence range and the upper median of confidences."""
    totals = readings.groupBy("view").agg(
        F.count_distinct("image_id").alias("attempts"),
        F.count("confidence").alias("detections"),
        half_up(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )
    upper = ranking.order_statistics(readings, ["view"], "confidence", {"median_confidence": lambda n: F.floor(n / 2) + 1})
    return totals.join(upper.drop("total"), "view", "left")


def field_coverage(products: DataFrame, fields: list[str]) -> DataFrame:
    """Detected, missing or uncertain per field; a failed reading leaves a missing field uncertain."""
    long = products.unpivot(["failed"], fields, "field", "value")
    seen = F.coalesce(F.col("value") != "", F.lit(False))
    out = long.groupBy("field").agg(
        F.count_if(seen).alias("detected"), F.count_if(~seen & ~F.col("failed")).alias("missing"),
        F.count_if(~seen & F.col("failed")).alias("uncertain"), F.count("*").alias("_all"),
    )
    return out.select("field", "detected", "missing", "uncertain", percent(F.col("detected"), F.col("_all"), 2).alias("detected_pct"))


def latency_stats(runs: DataFrame, keys: list[str], value: str = "seconds") -> DataFrame:
    """Mean, median, extremes and the exclusive 95th percentile per key."""
    basic = runs.groupBy(*keys).agg(
        F.count(value).alias("n"), half_up(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    ranks = {
        "low": lambda n: F.floor((n + 1) / 2),
        "high": lambda n: F.floor(n / 2) + 1,
        "p_low": lambda n: ranking.exclusive_place(n, 19, 20)[0],
        "p_high": lambda n: ranking.exclusive_place(n, 19, 20)[0] + 1,
    }
    at = ranking.order_statistics(runs, keys, value, ranks)
    p95 = ranking.exclusive_quantile(F.col("p_low"), F.col("p_high"), F.col("total"), 19, 20)
    at = at.select(*keys, half_up((F.col("low") + F.col("high")) / 2, 6).alias("median"), half_up(p95, 6).alias("p95"))
    return basic.join(at, keys)


def failure_class(error: Column) -> Column:
    return (
        F.when(error.contains("missing field"), F.lit("FULL_OCR_FAILURE"))
        .when(F.lower(error).contains("timeout"), F.lit("TIMEOUT"))
        .otherwise(F.lit("FULL_OCR_FAILURE"))
    )


def failure_classes(runs: DataFrame) -> DataFrame:
    failed = runs.filter(~F.col("success"))
    return failed.groupBy(failure_class(F.col("error")).alias("failure")).agg(F.count("*").alias("n"))


def variant_scores(results: DataFrame) -> DataFrame:
    """Score per variant; the highest wins, the first in order on ties."""
    s = results.groupBy("variant").agg(
        F.count_if("success").alias("successes"),
        F.sum("fields").alias("fields"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("latency_ms"))) / F.nullif(F.count_if("success"), F.lit(0)), F.lit(0.0)).alias("avg_latency_ms"),
    )
    scored = s.withColumn("score", half_up(F.col("fields") * 100 + F.col("avg_confidence") * 10 - F.col("avg_latency_ms") / 1000, 6))
    # A handful of aggregated variants, so the window over all of them is small.
    best = F.first("variant").over(W.partitionBy().orderBy(F.desc("score"), "variant"))
    return scored.withColumn("best", best).select(
        "variant", "successes", F.col("fields").cast("bigint").alias("fields"), half_up(F.col("avg_confidence"), 6).alias("avg_confidence"),
        half_up(F.col("avg_latency_ms"), 6).alias("avg_latency_ms"), "score", (F.col("variant") == F.col("best")).alias("best"),
    )


def completeness(images: DataFrame) -> DataFrame:
    both = F.bool_or(F.col("view") == "front") & F.bool_or(F.col("view") == "back")
    return images.groupBy("product_id").agg(F.count("*").alias("images"), both.alias("complete"))
