"""Structured Streaming forms of ingestion and run monitoring. Each has a batch twin, so that results can be compared."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.sources.tables import dedupe_uploads, line_chunks

# Progress of a job by stage.
PROGRESS = {"view": 10, "click": 40, "search": 60, "error": 0, "purchase": 100}


def ingest(docs: DataFrame) -> DataFrame:
    """Batch twin: chunks of the first document of each content, with the content's hash."""
    one = dedupe_uploads(docs).filter("not is_duplicate").select("doc_id", "sha256")
    fresh = docs.join(one.select("doc_id"), "doc_id", "left_semi")
    return line_chunks(fresh).join(one.withColumnRenamed("doc_id", "document_id"), "document_id")


def ingested(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The chunks that stand after the batches (below ``before``) at ``path``: each document's from its last batch."""
    schema = "document_id long, chunk_index int, line int, text string, sha256 string, batch long"
    rows = spark.read.schema(schema).parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    last = rows.groupBy("document_id").agg(F.max("batch").alias("_last")).withColumnRenamed("document_id", "_id")
    return rows.join(last, (F.col("document_id") == F.col("_id")) & (F.col("batch") == F.col("_last"))).drop("_id", "_last")


def stream_ingest(docs: DataFrame, path: str):
    """A writer that cuts documents into chunks, one folder of ``path`` for each micro-batch.

    Contents that already stand there are no longer written, in whatever batch they came; a document that comes again with
    other content replaces its chunks. A batch that is run again overwrites its own folder, so each counts once.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = ingest(df)
        if number:
            known = ingested(df.sparkSession, path, number).select("sha256").distinct()
            rows = rows.join(known, "sha256", "left_anti").select(*rows.columns)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch)


def _late(rows: DataFrame, late: str | None) -> DataFrame:
    """A watermark on ``ts``; watermarks want timestamps with a zone."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else rows


def stage_state(events: DataFrame) -> DataFrame:
    """Latest stage, its time and the progress of each job; in update mode on a stream."""
    table = F.create_map(*(F.lit(x) for pair in PROGRESS.items() for x in pair))
    last = events.groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("events"))
    return last.withColumn("progress", F.coalesce(F.try_element_at(table, "stage"), F.lit(0)))


def run_health(events: DataFrame, width: str = "1 day", late: str | None = "1 hour", budget: float = 50.0) -> DataFrame:
    """Runs, failures and latency of each lane and time window."""
    rows = _late(events, late)
    sums = rows.groupBy(F.window("ts", width), "lane").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("lane") == "error").alias("failures"), F.count_if(F.col("value") > budget).alias("over_budget"), F.round(F.max("value"), 6).alias("slowest"),
    )
    return sums.select(F.col("window.start").alias("window_start"), "lane", "runs", "failures", "over_budget", "slowest")


def quality_drift(warnings: DataFrame, width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Warnings by source, code and window."""
    rows = _late(warnings, late)
    sums = rows.groupBy(F.window("ts", width), "source", "code").agg(F.count(F.lit(1)).alias("warnings"))
    return sums.select(F.col("window.start").alias("window_start"), "source", "code", "warnings")


def bursts(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """Sessions of events of one key with gaps of at most ``gap``."""
    rows = _late(events, late)
    sums = rows.groupBy(F.session_window("ts", gap), "job_id").agg(F.count(F.lit(1)).alias("events"))
    return sums.select("job_id", F.col("session_window.start").alias("start"), "events")


def stalled_jobs(heartbeats: DataFrame, now, lease: str, most_attempts: int) -> DataFrame:
    """Batch twin: running jobs whose last heartbeat is older than the lease, and what to do with them."""
    last = heartbeats.groupBy("job_id").agg(F.max("ts").alias("last_ts"), F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.count_if(F.col("stage") == "error").alias("attempts"))
    overdue = last.filter((F.col("last_ts") < F.lit(now).cast("timestamp") - F.expr(f"interval {lease}")) & (F.col("stage") != "purchase"))
    return overdue.withColumn("action", F.when(F.col("attempts") >= most_attempts, "fail").when(F.col("stage") == "search", "resume").otherwise("retry"))


def stream_stalled_jobs(heartbeats: DataFrame, lease_ms: int, most_attempts: int, late: str = "0 seconds") -> DataFrame:
    """The stream: an event-time timeout fires when a job has been silent for its lease. The state is three values a job."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, stage, attempts = state.get
            state.remove()
            if stage != "purchase":
                action = "fail" if attempts >= most_attempts else "resume" if stage == "search" else "retry"
                yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), stage, attempts, action)], columns=["job_id", "last_ts", "stage", "attempts", "action"])
            return
        last, stage, attempts = state.get if state.exists else (0, "", 0)
        for batch in batches:
            for t, s in zip(batch["ts"], batch["stage"], strict=True):
                ms = int(pd.Timestamp(t).timestamp() * 1000)
                attempts += s == "error"
                if ms >= last:
                    last, stage = ms, s
        state.update((last, stage, int(attempts)))
        state.setTimeoutTimestamp(max(last + lease_ms, state.getCurrentWatermarkMs() + 1))

    return _late(heartbeats, late).groupBy("job_id").applyInPandasWithState(
        step, "job_id long, last_ts timestamp, stage string, attempts int, action string", "last long, stage string, attempts int", "append", GroupStateTimeout.EventTimeTimeout,
    )
