"""Structured Streaming jobs. Each has a batch twin in ``operators``; both share the aggregation."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelwright.operators import telemetry
from labelwright.session import shared_dir

WATERMARK = "10 minutes"


def read_parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files of a path (or pattern) as a stream; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_to_end(stream: DataFrame, label: str, mode: str = "append", sink: str | None = None) -> DataFrame:
    """Process what is there, write it to files under the shared folder and read the result.

    The checkpoint lies next to the output, so a restarted job goes on where it stopped.
    """
    spark = stream.sparkSession
    base = sink or os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    out = os.path.join(base, "data")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", os.path.join(base, "checkpoint"))
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        # Whole or changed results per batch: the batch's folder is overwritten, so a retry is harmless.
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

        query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def ingest(events: DataFrame) -> DataFrame:
    """Telemetry appended as it comes, with its day for the sink's partitions."""
    return events.withColumn("day", F.to_date("ts"))


def health(events: DataFrame, size: str, min_samples: int, slide: str | None = None, keys=()) -> DataFrame:
    return telemetry.health(events.withWatermark("ts", WATERMARK), size, slide, min_samples, keys)


def latency_counts(events: DataFrame, size: str) -> DataFrame:
    """Counts by latency of the windows that the watermark has closed; ``telemetry.drift_of_counts`` reads them."""
    return telemetry.latency_counts(events.withWatermark("ts", WATERMARK), size)


def without_repeats(samples: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """First arrival of each key; state is dropped once the watermark has passed it."""
    return samples.withWatermark(ts, WATERMARK).dropDuplicatesWithinWatermark([key])


def daily_trend(inspections: DataFrame) -> DataFrame:
    day = F.window("created_at", "1 day")
    return inspections.groupBy(day.alias("w")).agg(F.count("*").alias("total")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total"
    )


def upsert_changes(events: DataFrame, folder: str) -> StreamingQuery:
    """Status changes appended batch by batch, each reduced to the latest per complaint and stored
    under its batch number, so a repeated batch replaces itself."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = F.max(F.struct("changed_at", "seq", "status")).alias("l")
        reduced = batch.groupBy("complaint_id").agg(last, F.count("*").alias("changes"))
        reduced.select("complaint_id", "l.*", "changes").write.mode("overwrite").parquet(os.path.join(folder, "data", f"batch={batch_id}"))

    return (
        events.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", os.path.join(folder, "checkpoint"))
        .foreachBatch(merge)
        .start()
    )


def cooled_triggers(windows: DataFrame, key: str) -> DataFrame:
    """Retraining triggers of degraded windows, at most one per key and cool-down.

    The state of a key is one number, the time of its last trigger; a replayed window is
    never later than it and so triggers nothing again.
    """
    gap = telemetry.COOLDOWN_HOURS * 3600

    def decide(key_value: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(int(t) for batch in batches for t in batch["at"])
        fired = []
        for t in times:
            if last is None or t - last >= gap:
                fired.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [key_value[0]] * len(fired), "at": fired})

    degraded = windows.filter(F.col("status") == "QUALITY_DEGRADED").select(key, F.unix_timestamp("window_start").alias("at"))
    fired = degraded.groupBy(key).applyInPandasWithState(
        decide, f"{key} string, at bigint", "last bigint", "append", GroupStateTimeout.NoTimeout
    )
    return fired.select(key, F.timestamp_seconds("at").alias("triggered_at"))


#: Reports may come this late; a deployment without reports for so many days is closed and its state dropped.
REPORT_DELAY, IDLE_DAYS = "2 days", 30
_STATE = "stage int, rolled_back boolean, samples bigint, rate double, used int, last bigint, days array<bigint>, counts array<bigint>, rates array<double>"


def deployment_states(reports: DataFrame) -> DataFrame:
    """Stage of each deployment as its reports (deployment_id, day, samples, error_rate) become final.

    Reports are folded in order of their days, each once the watermark has passed it; until then it waits in the
    deployment's state, which so holds one folded row and the reports of the watermark's delay. A report behind
    the watermark is late and dropped, as in any window. A timer closes a deployment that reports no more: its
    last row is marked ``closed`` and its state goes, so that only open deployments have state. A row is given
    out whenever the folded part has changed.
    """
    hour, day_ms = 3_600_000, 86_400_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, rolled_back, samples, rate, used, last, *lists = state.get if state.exists else (0, False, 0, 0.0, 0, 0, [], [], [])
        waiting = sorted(zip(*lists, strict=True))
        for batch in batches:
            waiting += zip(batch["at"], batch["samples"], batch["error_rate"], strict=True)
        waiting.sort()
        mark = state.getCurrentWatermarkMs()
        due = [r for r in waiting if r[0] < mark]
        for at, count, share in due:
            stage, rolled_back, samples, rate, used = telemetry.next_state((stage, rolled_back, samples, rate, used), int(count), float(share))
            last = int(at)
        waiting = waiting[len(due) :]
        closed = not waiting and last + IDLE_DAYS * day_ms < mark
        if closed:
            state.remove()
        else:
            days, counts, rates = (list(x) for x in zip(*waiting, strict=True)) if waiting else ([], [], [])
            state.update((stage, rolled_back, samples, rate, used, last, [int(x) for x in days], [int(x) for x in counts], [float(x) for x in rates]))
            wake = int(days[0]) + hour if waiting else last + IDLE_DAYS * day_ms + hour
            state.setTimeoutTimestamp(max(wake, mark + 1))
        if due or closed:
            yield pd.DataFrame({"deployment_id": [key[0]], "stage": [stage], "rolled_back": [rolled_back], "samples": [samples], "reports": [used], "last": [last], "closed": [closed]})

    timed = reports.withColumn("ts", F.col("day").cast("timestamp")).withWatermark("ts", REPORT_DELAY)
    rows = timed.select("deployment_id", "ts", F.unix_millis("ts").alias("at"), "samples", "error_rate")
    out = rows.groupBy("deployment_id").applyInPandasWithState(
        fold, "deployment_id string, stage int, rolled_back boolean, samples bigint, reports int, last bigint, closed boolean", _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
    status = telemetry.state_name(F.col("rolled_back"), F.col("stage"))
    return out.withColumn("status", status).select(
        "deployment_id", "status", telemetry.state_traffic(F.col("status")).alias("traffic"), "samples", "reports", F.timestamp_millis("last").cast("date").alias("last_day"), "closed"
    )


def latest_states(changes: DataFrame) -> DataFrame:
    """The last row of each deployment among the stored changes (with their ``batch``)."""
    row = F.struct("batch", "last_day", "reports", "closed", "status", "traffic", "samples")
    return changes.groupBy("deployment_id").agg(F.max(row).alias("r")).select(
        "deployment_id", "r.status", "r.traffic", "r.samples", "r.reports", "r.last_day", "r.closed"
    )
