"""Telemetry queries: batch twins, then the same through Structured Streaming."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from labelwright.operators import annotations as ann

from labelwright.operators import telemetry as ops
from labelwright.plans.catalog import query
from labelwright.session import shared_dir
from labelwright.sources.standins import TELEMETRY_COLUMNS, spark_view
from labelwright.streaming import jobs


def _t(spark, sf):
    return spark_view(spark, sf, "telemetry")


def _text(df):
    """Window bounds as text."""
    named = [c for c in ("window_start", "window_end", "triggered_at") if c in df.columns]
    for c in named:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


def _iso(e):
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


_AGG = """count(*) AS samples, count(*) FILTER (WHERE inference_status = 'FAILURE') AS errors, count(*) FILTER (WHERE inference_status = 'TIMEOUT') AS timeouts,
 floor(count(*) FILTER (WHERE inference_status = 'FAILURE') / count(*) * 1e6 + 0.5) / 1e6 AS error_rate, floor(avg(latency_ms) * 1e6 + 0.5) / 1e6 AS avg_latency"""


def _health_sql(size, minimum, keys="", source="@telemetry", start=None):
    start = start or f"time_bucket(INTERVAL '{size}', ts, TIMESTAMP '1970-01-01')"
    return f"""SELECT {_iso('w')} AS window_start, {_iso(f"w + INTERVAL '{size}'")} AS window_end, {keys} samples, errors, timeouts, error_rate, avg_latency,
 CASE WHEN samples < {minimum} THEN 'INSUFFICIENT_DATA' WHEN errors / samples > 0.02 OR avg_latency > 1500 THEN 'QUALITY_DEGRADED' ELSE 'HEALTHY' END AS status
 FROM (SELECT {start} AS w, {keys} {_AGG} FROM {source} GROUP BY ALL)"""


@query("telemetry_health_5m", _health_sql("5 minutes", 2))
def telemetry_health_5m(spark, sf):
    return _text(ops.health(_t(spark, sf), "5 minutes", min_samples=2))


@query("telemetry_health_1h", _health_sql("1 hour", 5))
def telemetry_health_1h(spark, sf):
    return _text(ops.health(_t(spark, sf), "1 hour", min_samples=5))


@query("telemetry_health_24h", _health_sql("24 hours", 100))
def telemetry_health_24h(spark, sf):
    return _text(ops.health(_t(spark, sf), "24 hours", min_samples=100))


@query("telemetry_sliding", _health_sql("1 hour", 5, source="(SELECT *, unnest(range(12)) AS i FROM @telemetry)", start="time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') - i * INTERVAL '5 minutes'"))
def telemetry_sliding(spark, sf):
    return _text(ops.health(_t(spark, sf), "1 hour", "5 minutes", min_samples=5))


@query("rollback_alerts", f"""SELECT {_iso('w')} AS window_start, {_iso("w + INTERVAL '1 day'")} AS window_end, deployment_id, n AS samples, floor(e / n * 1e6 + 0.5) / 1e6 AS error_rate FROM (
 SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w, deployment_id, count(*) AS n, count(*) FILTER (WHERE inference_status = 'FAILURE') AS e FROM @telemetry GROUP BY 1, 2) WHERE n >= 10 AND e / n > 0.05""")
def rollback_alerts(spark, sf):
    return _text(ops.rollback_alerts(_t(spark, sf), "1 day"))


@query("drift_metrics", f"""SELECT {_iso('w')} AS window_start, {_iso("w + INTERVAL '1 day'")} AS window_end, floor(p * 1e4 + 0.5) / 1e4 AS p95_ms, floor(d * 1e6 + 0.5) / 1e6 AS no_detection_rate, p > 1200 AS slow, d > 0.15 AS blind FROM (
 SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w, quantile_cont(latency_ms, 0.95) AS p, count(*) FILTER (WHERE prediction_count = 0) / count(*) AS d FROM @telemetry GROUP BY 1)""")
def drift_metrics(spark, sf):
    return _text(ops.drift(_t(spark, sf), "1 day"))


@query("telemetry_retention", "SELECT event_id, deployment_id, latency_ms FROM @telemetry WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAY")
def telemetry_retention(spark, sf):
    return ops.retained(_t(spark, sf), "2024-02-10").select("event_id", "deployment_id", "latency_ms")


_DEGRADED = f"SELECT model_version, CAST(window_start AS TIMESTAMP) AS w FROM ({_health_sql('1 hour', 5, 'model_version,')}) WHERE status = 'QUALITY_DEGRADED'"
_TRIGGERS = f"""WITH RECURSIVE d AS ({_DEGRADED}), t(model_version, w) AS (SELECT model_version, min(w) FROM d GROUP BY 1 UNION ALL
 SELECT t.model_version, (SELECT min(d.w) FROM d WHERE d.model_version = t.model_version AND d.w >= t.w + INTERVAL 24 HOUR) FROM t WHERE t.w IS NOT NULL)
 SELECT model_version, {_iso('w')} AS triggered_at FROM t WHERE w IS NOT NULL"""


def _hourly(spark, sf):
    return ops.health(_t(spark, sf), "1 hour", min_samples=5, keys=["model_version"])


@query("retrain_triggers", _TRIGGERS)
def retrain_triggers(spark, sf):
    return _text(ops.retrain_triggers(_hourly(spark, sf), ["model_version"]))


_VERIFIED = "provenance IN ('human_verified', 'human_corrected') AND verification_status IN ('ACCEPTED', 'CORRECTED')"


@query("retrain_gate", f"""SELECT g.*, CASE WHEN products < 50 OR verified < 100 THEN 'RETRAINING_BLOCKED_NOT_READY' ELSE 'RETRAINING_QUEUED' END AS outcome FROM (SELECT * FROM ({_TRIGGERS}),
 (SELECT count(DISTINCT product_id) AS products FROM @images), (SELECT count(*) FILTER (WHERE {_VERIFIED}) AS verified FROM @annotations)) g""")
def retrain_gate(spark, sf):
    counts = ann.dataset_counts(spark_view(spark, sf, "images"), spark_view(spark, sf, "annotations"))
    return _text(ops.gated(ops.retrain_triggers(_hourly(spark, sf), ["model_version"]), counts))


def _states_sql(reports, more=""):
    return f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY day) AS rn FROM {reports}),
 s(deployment_id, rn, stage, rb, samples, rate, used) AS (SELECT DISTINCT deployment_id, 0::BIGINT, 0, false, 0::BIGINT, 0.0::DOUBLE, 0 FROM r UNION ALL
  SELECT x.deployment_id, x.rn, CASE WHEN up THEN stage + 1 ELSE stage END, rb OR bad, CASE WHEN over THEN samples WHEN up THEN 0 ELSE total END, CASE WHEN over THEN rate ELSE nrate END, CASE WHEN over THEN used ELSE used + 1 END FROM (
   SELECT *, NOT over AND nrate > 0.05 AS bad, NOT over AND NOT nrate > 0.05 AND total >= 100 AS up FROM (SELECT r.deployment_id, r.rn, s.stage, s.rb, s.samples, s.rate, s.used, s.rb OR s.stage >= 6 AS over, s.samples + r.samples AS total,
    CASE WHEN r.error_rate <> 0 THEN r.error_rate ELSE s.rate END AS nrate FROM s JOIN r ON r.deployment_id = s.deployment_id AND r.rn = s.rn + 1)) x),
 f AS (SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY rn DESC) AS k FROM s),
 g AS (SELECT *, CASE WHEN rb THEN 'ROLLED_BACK' ELSE ['SHADOW', 'CANARY_1', 'CANARY_5', 'CANARY_25', 'CANARY_50', 'PROMOTING', 'PRODUCTION'][stage + 1] END AS status FROM f WHERE k = 1)
SELECT deployment_id, status, CASE status WHEN 'CANARY_1' THEN 1 WHEN 'CANARY_5' THEN 5 WHEN 'CANARY_25' THEN 25 WHEN 'CANARY_50' THEN 50 WHEN 'PROMOTING' THEN 100 WHEN 'PRODUCTION' THEN 100 ELSE 0 END AS traffic, samples, used AS reports{more} FROM g"""


@query("deployment_states", _states_sql("@stage_reports"))
def deployment_states(spark, sf):
    return ops.deployment_states(spark_view(spark, sf, "stage_reports"))


@query("canary_route", """
WITH b AS (SELECT *, (('0x' || substr(sha256(correlation_id), 1, 8))::UBIGINT % 100)::INT AS bucket FROM @telemetry)
SELECT b.event_id, bucket, CASE WHEN bucket < d.traffic THEN d.candidate ELSE 'v1-baseline' END AS model FROM b LEFT JOIN @deployments d ON b.ts >= d.start_at AND b.ts < d.end_at""")
def canary_route(spark, sf):
    return ops.route(_t(spark, sf), spark_view(spark, sf, "deployments"), "v1-baseline")


@query("canary_compare", f"""
WITH m AS (SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w, model_version, avg(latency_ms) AS l, avg((inference_status = 'FAILURE')::INT) AS f FROM @telemetry GROUP BY 1, 2)
SELECT {_iso('a.w')} AS window_start, {_iso("a.w + INTERVAL '1 day'")} AS window_end, floor(a.l * 1e4 + 0.5) / 1e4 AS champion_ms, floor(b.l * 1e4 + 0.5) / 1e4 AS candidate_ms, floor((b.l - a.l) * 1e4 + 0.5) / 1e4 AS delta_ms,
 floor((b.f - a.f) * 1e6 + 0.5) / 1e6 AS error_delta, b.l - a.l > 250 AS regression FROM m a JOIN m b ON a.w = b.w AND a.model_version = 'm0' AND b.model_version = 'm1'""")
def canary_compare(spark, sf):
    return _text(ops.compare_models(_t(spark, sf), "1 day", "m0", "m1"))


# ---- streams ------------------------------------------------------------------------------------
def _stream(spark, sf, table):
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return jobs.read_parquet_stream(spark, f"{sf}/{table[:-1]}[{table[-1]}].parquet", schema)


def _telemetry_stream(spark, sf):
    raw = _stream(spark, sf, "events")
    return raw.selectExpr(*[e.strip() for e in _split_columns(TELEMETRY_COLUMNS)])


def _split_columns(text):
    """Cut a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return out + [text[start:]]


@query("stream_ingest", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, floor(sum(latency_ms) * 100 + 0.5) / 100 AS latency FROM @telemetry GROUP BY 1")
def stream_ingest(spark, sf):
    """Appended telemetry, counted per day after the stream has ended."""
    stored = jobs.run_to_end(jobs.ingest(_telemetry_stream(spark, sf)), "telemetry")
    return stored.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), (F.floor(F.sum("latency_ms") * 100 + 0.5) / 100).alias("latency")
    )


@query("stream_health", f"SELECT h.* FROM ({_health_sql('5 minutes', 2)}) h WHERE CAST(window_end AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM @telemetry)")
def stream_health(spark, sf):
    """Windows the watermark has closed."""
    return _text(jobs.run_to_end(jobs.health(_telemetry_stream(spark, sf), "5 minutes", 2), "health"))


@query("stream_drift", f"""SELECT {_iso('w')} AS window_start, {_iso("w + INTERVAL '1 day'")} AS window_end, floor(p * 1e4 + 0.5) / 1e4 AS p95_ms, floor(d * 1e6 + 0.5) / 1e6 AS no_detection_rate, p > 1200 AS slow, d > 0.15 AS blind FROM (
 SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS w, quantile_disc(latency_ms, 0.95) AS p, count(*) FILTER (WHERE prediction_count = 0) / count(*) AS d FROM @telemetry GROUP BY 1)
 WHERE w + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM @telemetry)""")
def stream_drift(spark, sf):
    """Days the watermark has closed; the stream counts, ranks are found in the stored counts."""
    return _text(ops.drift_of_counts(jobs.run_to_end(jobs.latency_counts(_telemetry_stream(spark, sf), "1 day"), "drift")))


@query("stream_dedup", "SELECT event_id, deployment_id, inference_status FROM @telemetry")
def stream_dedup(spark, sf):
    """Every record arrives twice and is kept once."""
    twice = _telemetry_stream(spark, sf).withColumn("copy", F.explode(F.lit([0, 1])))
    kept = jobs.run_to_end(jobs.without_repeats(twice, "event_id"), "dedup")
    return kept.select("event_id", "deployment_id", "inference_status")


@query("stream_trend", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total FROM @inspections GROUP BY 1")
def stream_trend(spark, sf):
    raw = _stream(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created_at"))
    out = jobs.run_to_end(jobs.daily_trend(raw), "trend", mode="update")
    # An updated day appears in several batches; its last one counts.
    return out.groupBy("day").agg(F.max_by("total", "batch").alias("total"))


@query("stream_complaints", "SELECT complaint_id, arg_max(status, (changed_at, seq)) AS status, count(*) AS changes FROM @complaint_events GROUP BY 1")
def stream_complaints(spark, sf):
    raw = _stream(spark, sf, "lineitem")

    status = F.element_at(F.lit(["RESOLVED", "SUBMITTED", "UNDER_REVIEW", "REJECTED"]), ((F.col("l_linenumber") + F.col("l_suppkey")) % 4 + 1).cast("int"))
    seq = F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")
    events = raw.select(F.col("l_orderkey").alias("complaint_id"), seq.alias("seq"), F.col("l_shipdate").cast("timestamp").alias("changed_at"), status.alias("status"))
    folder = os.path.join(shared_dir(spark), f"complaints-{uuid.uuid4().hex}")
    jobs.upsert_changes(events, folder).awaitTermination()
    stored = spark.read.parquet(os.path.join(folder, "data"))
    last = F.max(F.struct("changed_at", "seq", "status")).alias("l")
    return stored.groupBy("complaint_id").agg(last, F.sum("changes").alias("changes")).select("complaint_id", "l.status", "changes")


@query("stream_retrain", _TRIGGERS)
def stream_retrain(spark, sf):
    """Health windows stored by one stream, read by a second one with keyed state."""
    folder = os.path.join(shared_dir(spark), f"windows-{uuid.uuid4().hex}")
    windows = jobs.run_to_end(jobs.health(_telemetry_stream(spark, sf), "1 hour", 5, keys=["model_version"]), "windows", sink=folder)
    again = jobs.read_parquet_stream(spark, os.path.join(folder, "data"), windows.schema)
    return _text(jobs.run_to_end(jobs.cooled_triggers(again, "model_version"), "triggers"))


_FINAL = "(SELECT * FROM @stage_reports WHERE day::TIMESTAMP < (SELECT max(day)::TIMESTAMP - INTERVAL 2 DAY FROM @stage_reports))"


@query("stream_deployments", _states_sql(_FINAL))
def stream_deployments(spark, sf):
    """Daily reports as a stream; keyed state with timers gives the state after all reports the watermark has passed."""
    folder = os.path.join(shared_dir(spark), f"reports-{uuid.uuid4().hex}")
    reports = spark_view(spark, sf, "stage_reports")
    reports.write.parquet(folder)
    changes = jobs.run_to_end(jobs.deployment_states(jobs.read_parquet_stream(spark, folder, reports.schema)), "deployments", mode="update")
    return jobs.latest_states(changes).drop("last_day", "closed")
