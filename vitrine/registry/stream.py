"""Queries of the streaming family (SURVEY K), in batch form and as streams over the files of the events table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir
from ..streaming import jobs, tables
from .core import Tables, query
from .views import SPARK_VIEWS
from .similarity import _COS

_STATUS = "CASE step " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in jobs.STEP_STATUS.items()) + " ELSE upper(step) END"
_EV = f"ev AS (SELECT *, {_STATUS} AS status FROM v_event)"
_ST = f"""{_EV}, st AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(message, (ts, event_id)) AS progress_message, min(ts) AS created_at, max(ts) AS updated_at, arg_max(message, (ts, event_id)) FILTER (status = 'FAILED') AS error, count(*) AS n_events FROM ev GROUP BY 1)"""


@query("job_step_statuses", "K1", f"WITH {_EV} SELECT event_id, step, status FROM ev")
def _(t):
    return jobs.with_status(t.view("v_event")).select("event_id", "step", "status")


@query("job_states", "K2", f"WITH {_ST} SELECT * FROM st")
def _(t):
    return jobs.job_state(t.view("v_event")).drop("error_at", "last_event")


@query("job_states_in_batches", "K2", f"WITH {_ST} SELECT * FROM st")
def _(t):
    events = t.view("v_event")
    parts = [jobs.job_state(events.filter(F.col("event_id") % 3 == i)) for i in range(3)]
    return jobs.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2])).drop("error_at", "last_event")


# finer jobs, so that some are finished and some are running
_FINE = "ej AS (SELECT event_id % 4000 AS job_id, event_id, ts, step, message FROM v_event)"
_FST = f"{_FINE}, ev AS (SELECT *, {_STATUS} AS status FROM ej), st AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS created_at, arg_max(message, (ts, event_id)) FILTER (status = 'FAILED') AS error FROM ev GROUP BY 1)"


def fine_events(t):
    return t.view("v_event").withColumn("job_id", F.col("event_id") % 4000)


@query("job_retention", "K3", f"WITH {_FST} SELECT job_id, status, created_at FROM st WHERE NOT (epoch(TIMESTAMP '2024-01-06 00:00:00') - epoch(created_at) > 3600 AND status IN ('COMPLETED', 'FAILED'))")
def _(t):
    now = F.lit("2024-01-06 00:00:00").cast("timestamp")
    return jobs.evict_stale(jobs.job_state(fine_events(t)), now).select("job_id", "status", "created_at")


@query("job_report_responses", "K4", f"""WITH {_FST} SELECT job_id, CASE status WHEN 'COMPLETED' THEN 200 WHEN 'FAILED' THEN 500 ELSE 425 END AS http_status, CASE status WHEN 'COMPLETED' THEN NULL WHEN 'FAILED' THEN 'Analysis job failed: ' || error ELSE 'Analysis job is still in progress (current status: ' || status || ').' END AS detail, status = 'COMPLETED' AS has_report FROM st""")
def _(t):
    return jobs.report_responses(jobs.job_state(fine_events(t)))


@query("incremental_index_matches", "K5", f"""WITH a9 AS (SELECT asset_hash, merchant_id, batch_no, replace(lower(domain), 'www.', '') AS dom, embedding FROM v_asset),
c9 AS (SELECT q.asset_hash, x.asset_hash AS match_hash, {_COS('q.embedding', 'x.embedding')} AS s FROM a9 q JOIN a9 x ON x.batch_no < q.batch_no AND q.merchant_id <> x.merchant_id AND NOT (x.dom = q.dom OR suffix(x.dom, '.' || q.dom))),
m9 AS (SELECT *, row_number() OVER (PARTITION BY asset_hash ORDER BY round(s, 4) DESC, match_hash) AS match_no FROM c9 WHERE s >= 0.82 QUALIFY match_no <= 5) SELECT asset_hash, CAST(match_no AS INT) AS match_no, match_hash, round(s, 4) AS similarity FROM m9""")
def _(t):
    assets = t.view("v_asset").withColumn("ts", F.col("batch_no"))
    return tables.incremental_matches(assets, [0, 1, 2]).select("asset_hash", "match_no", "match_hash", "similarity")


@query("job_elapsed_times", "K6", f"""WITH {_FINE}, ev AS (SELECT *, {_STATUS} AS status FROM ej), g AS (SELECT job_id, min(ts) AS a, min(ts) FILTER (status IN ('COMPLETED', 'FAILED')) AS d, max(ts) AS z FROM ev GROUP BY 1), s AS (SELECT job_id, d IS NOT NULL AS is_finished, CAST(floor((epoch_us(coalesce(d, z)) - epoch_us(a)) / 1e6) AS BIGINT) AS seconds FROM g)
SELECT job_id, is_finished, seconds, CASE WHEN seconds // 60 < 10 THEN '0' ELSE '' END || (seconds // 60) || ':' || CASE WHEN seconds % 60 < 10 THEN '0' ELSE '' END || (seconds % 60) || 's' AS elapsed FROM s""")
def _(t):
    return jobs.elapsed_times(fine_events(t))


@query("job_status_windows", "K7", f"WITH {_EV} SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS window_end, status, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def _(t):
    return jobs.status_counts(t.view("v_event"), "1 hour", delay=None)


@query("job_status_sliding_windows", "K7", f"""WITH {_EV}, w AS (SELECT status, time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes' * k AS window_start FROM ev CROSS JOIN (SELECT unnest([0, 1]) AS k)) SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, status, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def _(t):
    return jobs.status_counts(t.view("v_event"), "1 hour", "30 minutes", delay=None)


@query("job_sessions", "K7", """WITH g AS (SELECT job_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY job_id ORDER BY ts) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM v_event), s AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT job_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n FROM s GROUP BY job_id, sid""")
def _(t):
    return jobs.job_sessions(t.view("v_event"), "2 hours", delay=None)


# ---- the same as streams ------------------------------------------------------------------


def event_stream(t: Tables) -> DataFrame:
    """``v_event`` over a stream of the files of the events table, which may be one file or a folder (hence the pattern)."""
    name = f"events_{uuid.uuid4().hex}"
    t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.directory}/events.parque[t]").createOrReplaceTempView(name)
    return t.spark.sql(re.sub(r"\bFROM events\b", f"FROM {name}", SPARK_VIEWS["v_event"]))


def _run(writer) -> None:
    """All that there is to read, then stop."""
    stream = writer.trigger(availableNow=True).start()
    stream.awaitTermination()


def _folder(t: Tables) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/vitrine-stream-{uuid.uuid4().hex}"


@query("job_states_streamed", "K2", f"WITH {_ST} SELECT * FROM st")
def _(t):
    folder = _folder(t)
    states = tables.JobStateTable(f"{folder}/states")
    _run(states.start(event_stream(t), f"{folder}/checkpoint"))
    return states.current(t.spark).drop("error_at", "last_event")


@query("job_retention_streamed", "K3", f"WITH {_FST}, now AS (SELECT max(ts) - INTERVAL '10 minutes' AS now FROM v_event) SELECT job_id, status, created_at FROM st, now WHERE epoch_ms(now) - epoch_ms(created_at) > 3600000 AND status IN ('COMPLETED', 'FAILED')")
def _(t):
    folder = _folder(t)
    fine = event_stream(t).withColumn("job_id", F.col("event_id") % 4000)
    gone = jobs.evictions(fine).select("job_id", "status", "created_at")
    _run(gone.writeStream.format("parquet").option("path", f"{folder}/gone").option("checkpointLocation", f"{folder}/checkpoint"))
    return t.spark.read.schema(gone.schema).parquet(f"{folder}/gone")


@query("job_windows_streamed", "K7", f"""WITH {_EV}, m AS (SELECT max(ts) - INTERVAL '10 minutes' AS now FROM v_event), w AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS window_end, status, count(*) AS n FROM ev GROUP BY 1, 2, 3) SELECT w.* FROM w, m WHERE window_end <= now""")
def _(t):
    folder = _folder(t)
    closed = jobs.status_counts(event_stream(t), "1 hour")
    _run(closed.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/checkpoint"))
    return t.spark.read.schema(closed.schema).parquet(f"{folder}/windows")
