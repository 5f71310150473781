"""Content hashes that several merchants show, merchants without a crawl row, events out of order."""

import numpy as np
from pyspark.sql import functions as F

from vitrine.operators import crawl, similarity
from vitrine.streaming import jobs


def test_hash_shown_by_several_merchants(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    near = lambda: [float(x) for x in base + rng.normal(size=8) * 0.01]
    same = [float(x) for x in base]
    assets = [(f"H|{m}", "H", m, f"shop{m}.com", same) for m in (1, 2, 3)]
    index = [("N1", 1, "shop1.com", near())] + [(f"F{i}", 10 + i, f"other{i}.com", near()) for i in range(6)] + [("H", 3, "shop3.com", same)]
    got = similarity.index_matches(
        spark.createDataFrame(assets, "asset_key string, asset_hash string, merchant_id long, domain string, embedding array<double>"),
        spark.createDataFrame(index, "asset_hash string, merchant_id long, domain string, embedding array<double>"), key="asset_key",
    ).collect()
    for key, _, m, domain, vector in assets:
        unit = np.array(vector) / np.linalg.norm(vector)
        want = sorted(
            ((-round(float(unit @ (np.array(v) / np.linalg.norm(v))), 4), h) for h, o, d, v in index if h != "H" and o != m and d != domain)
        )[:5]
        own = sorted((r.match_no, r.match_hash) for r in got if r.asset_key == key)
        assert own == [(i + 1, h) for i, (_, h) in enumerate(want)]


def test_last_error_message_is_kept(spark):
    rows = [(1, 1, "TIMEOUT", True, "first"), (1, 2, "DNS", False, "second"), (2, 1, "TIMEOUT", True, "x"), (2, 2, None, False, None)]
    got = {r.merchant_id: r for r in crawl.merchant_crawl_status(spark.createDataFrame(rows, "merchant_id long, attempt_no int, error_type string, is_root boolean, error_msg string")).collect()}
    assert (got[1].crawl_status, got[1].crawl_error) == ("DNS", "second")
    assert (got[2].crawl_status, got[2].crawl_error) == ("SUCCESS", None)


def test_every_merchant_has_a_decision(spark, tables):
    from dataclasses import replace

    from vitrine.plans.merchant_report import build_report
    from vitrine.registry.report import report_inputs

    inputs = report_inputs(tables)
    attempts = inputs.attempts.filter("merchant_id % 5 <> 0")
    report = build_report(replace(inputs, attempts=attempts))
    decisions = {r.merchant_id: r for r in report.decisions.collect()}
    assert set(decisions) == {r.merchant_id for r in inputs.merchants.collect()}
    absent = [r for r in decisions.values() if r.crawl_status is None]
    assert absent and all(r.text_risk_score == 18.0 and r.final_score is not None for r in absent)
    failed = [r for r in decisions.values() if r.crawl_status not in (None, "SUCCESS")]
    assert all(r.merchant_name for r in failed)
    assert report.claims.select("merchant_id").distinct().count() == len(decisions)


def events(spark, rows):
    return spark.createDataFrame(rows, "job_id long, event_id long, ts string, step string").withColumns({"ts": F.col("ts").cast("timestamp"), "message": F.lit("m")})


def test_late_event_does_not_reopen_a_job(spark, tmp_path):
    batches = [
        [(1, 1, "2024-01-01 10:05:00", "COMPLETED"), (3, 2, "2024-01-01 10:05:00", "COMPLETED")],
        [(1, 3, "2024-01-01 10:04:00", "crawl")],
        [(9, 8, "2024-01-01 14:30:00", "crawl")],
        [(9, 9, "2024-01-01 14:31:00", "crawl")],
    ]
    for b in batches:
        events(spark, b).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    q = jobs.evictions(stream).writeStream.outputMode("append").foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.job_id for r in seen) == [1, 3]


def test_equal_times_across_batches(spark):
    first = events(spark, [(1, 2, "2024-01-01 10:00:00", "COMPLETED")])
    second = events(spark, [(1, 1, "2024-01-01 10:00:00", "crawl")])
    merged = jobs.merge_states(jobs.job_state(first).unionByName(jobs.job_state(second))).first()
    assert merged.status == jobs.job_state(first.unionByName(second)).first().status == "COMPLETED"


def test_repeated_batch_without_rows_replaces_the_earlier_one(spark, tmp_path):
    from vitrine.streaming.tables import JobStateTable

    table = JobStateTable(f"{tmp_path}/state")
    assert table.current(spark) is None
    rows = events(spark, [(1, 1, "2024-01-01 10:00:00", "crawl")])
    table.process(rows, 0)
    table.process(rows.withColumn("job_id", F.lit(2).cast("long")), 1)
    table.process(rows.limit(0), 1)
    assert [r.job_id for r in table.current(spark).collect()] == [1]
