"""Job progress as a stream.

Functions that only transform take a batch or a streaming DataFrame of events
(job_id, event_id, ts, step, message).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ladders import ladder, text

TTL_SECONDS = 3600
TERMINAL = ["COMPLETED", "FAILED"]

# Status shown for each workflow step.
STEP_STATUS = {
    "crawl": "CRAWLING",
    "extract": "EXTRACTING_IMAGES",
    "prioritize": "EXTRACTING_IMAGES",
    "search": "SEARCHING_WEB",
    "candidates": "SEARCHING_WEB",
    "vit": "SEARCHING_WEB",
    "logo": "ANALYSING_FORENSICS",
    "reuse": "ANALYSING_FORENSICS",
    "manipulation": "ANALYSING_FORENSICS",
    "identity": "ANALYSING_FORENSICS",
    "fusion": "SCORING",
}


def step_status(step: Column) -> Column:
    """K1. Status of a step; an unknown step is its own upper-case name."""
    return ladder([(step == s, v) for s, v in STEP_STATUS.items()], F.upper(step))


def _seconds(ts: Column) -> Column:
    """Epoch seconds with fraction, for timestamps with and without time zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def _watermarked(events: DataFrame, delay: str | None) -> DataFrame:
    """Event time as a zoned timestamp with a watermark; untouched without ``delay``."""
    return events if delay is None else events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def with_status(events: DataFrame) -> DataFrame:
    return events.withColumn("status", step_status(F.col("step")))


def job_state(events: DataFrame) -> DataFrame:
    """K2. Latest status, message and error per job with its creation time.

    A mergeable aggregate: the same expression serves batch and update-mode streams.
    """
    e = with_status(events)
    at = F.struct("ts", "event_id")
    return e.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("message", at).alias("progress_message"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max_by("message", F.when(F.col("status") == "FAILED", at)).alias("error"),
        F.max(F.when(F.col("status") == "FAILED", at)).alias("error_at"),
        F.count("*").alias("n_events"),
        F.max(at).alias("last_event"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """K2. One state per job from the states of several batches of events."""
    last = "last_event"  # time and id: events of one time are ordered as inside a batch
    return states.groupBy("job_id").agg(
        F.max_by("status", last).alias("status"),
        F.max_by("progress_message", last).alias("progress_message"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.max_by("error", "error_at").alias("error"),
        F.max("error_at").alias("error_at"),
        F.sum("n_events").alias("n_events"),
        F.max("last_event").alias("last_event"),
    )


def evict_stale(state: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """K3 (batch). Drop finished jobs created more than ``ttl_seconds`` ago; running jobs stay."""
    age = _seconds(now) - _seconds(F.col("created_at"))
    return state.filter(~((age > ttl_seconds) & F.col("status").isin(TERMINAL)))


class Retention(StatefulProcessor):
    """State of one job: creation, latest status, and a timer for the end of its retention."""

    STATE = "created long, status string, last_us long, last_event long, due long"  # due in milliseconds, as timers are

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        created, status, last, due = None, None, None, None
        if self.job.exists():
            created, status, *last, due = self.job.get()
            last = tuple(last)
        for batch in rows:
            for ts, event, step in zip(batch["ts_us"].tolist(), batch["event_id"].tolist(), batch["status"].tolist()):
                created = ts if created is None else min(created, ts)
                if last is None or (ts, event) >= last:
                    last, status = (ts, event), step
        wanted = max(created // 1000 + self.ttl, timerValues.getCurrentWatermarkInMs()) + 1 if status in TERMINAL else None
        if due is not None and due != wanted:
            self.handle.deleteTimer(due)
        if wanted is not None and due != wanted:
            self.handle.registerTimer(wanted)
        self.job.update((created, status, *last, wanted))
        yield pd.DataFrame(columns=["job_id", "status", "created_us"]).astype({"job_id": "int64", "status": "object", "created_us": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            created, status, *_ = self.job.get()
            self.job.clear()
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "created_us": [created]})

    def close(self) -> None:
        pass


def evictions(events: DataFrame, ttl_seconds: int = TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """K3 (stream). One row per job when its retention ends: a state timer per finished job.

    A job is due ``ttl_seconds`` after its creation, or at the next watermark where it finishes later; an earlier creation
    or a new status moves or removes its timer. Events may come late, repeated or in any order within the watermark's
    ``delay``: only the earliest time and the latest event count. Needs the RocksDB state store, which ``prepare`` sets.
    """
    keyed = with_status(_watermarked(events, delay)).withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    out = keyed.select("job_id", "event_id", "status", "ts", "ts_us").groupBy("job_id").transformWithStateInPandas(
        Retention(ttl_seconds), "job_id long, status string, created_us long", "Append", "EventTime"
    )
    return out.withColumn("created_at", F.timestamp_micros("created_us")).drop("created_us")


def report_responses(state: DataFrame) -> DataFrame:
    """K4. What a report request answers: report, error, or still in progress."""
    s = F.col("status")
    return state.select(
        "job_id",
        ladder([(s == "FAILED", 500), (s != "COMPLETED", 425)], 200).alias("http_status"),
        ladder(
            [
                (s == "FAILED", text("Analysis job failed: ", F.coalesce("error", F.lit("Unknown pipeline failure")))),
                (s != "COMPLETED", text("Analysis job is still in progress (current status: ", s, ").")),
            ],
            F.lit(None).cast("string"),
        ).alias("detail"),
        (s == "COMPLETED").alias("has_report"),
    )


def elapsed_times(events: DataFrame) -> DataFrame:
    """K6. Elapsed time per job as ``mm:ss``, frozen at the first terminal event."""
    e = with_status(events)
    done = F.when(F.col("status").isin(TERMINAL), F.col("ts"))
    per = e.groupBy("job_id").agg(F.min("ts").alias("start"), F.min(done).alias("done"), F.max("ts").alias("last"))
    seconds = F.floor(
        (F.unix_micros(F.coalesce("done", "last").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / F.lit(1e6)
    ).cast("long")
    per = per.withColumn("seconds", F.greatest(F.lit(0).cast("long"), seconds))
    minutes, rest = F.floor(F.col("seconds") / 60).cast("long"), F.col("seconds") % 60
    return per.select(
        "job_id",
        F.col("done").isNotNull().alias("is_finished"),
        "seconds",
        F.concat(
            F.when(minutes < 10, F.concat(F.lit("0"), minutes.cast("string"))).otherwise(minutes.cast("string")),
            F.lit(":"), F.lpad(rest.cast("string"), 2, "0"), F.lit("s"),
        ).alias("elapsed"),
    )


def status_counts(events: DataFrame, window: str, slide: str | None = None, delay: str | None = "10 minutes") -> DataFrame:
    """K7. Events per status in tumbling or sliding event-time windows (our addition)."""
    e = with_status(_watermarked(events, delay))
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return e.groupBy(span.alias("w"), "status").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "n"
    )


def job_sessions(events: DataFrame, gap: str, delay: str | None = "10 minutes") -> DataFrame:
    """K7. Activity sessions per job: events closer than ``gap`` belong together (our addition)."""
    e = _watermarked(events, delay)
    return e.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(
        "job_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )
