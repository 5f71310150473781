"""Streams give the batch results, also when a batch is repeated."""

from pyspark.sql import Window, functions as F

from vitrine.sources.index import build_index
from vitrine.sources.manifests import read_case_manifests
from vitrine.sources.sinks import write_lines, write_report
from vitrine.streaming import jobs


def write_parts(df, key, parts, path):
    """One input file per micro-batch, in order of ``key``."""
    for p in range(parts):
        df.filter(F.col(key) == p).drop(key).coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_job_states_from_micro_batches(spark, tables, tmp_path):
    from vitrine.streaming.tables import JobStateTable

    events = tables.view("v_event").withColumn("part", F.ntile(3).over(Window.orderBy("ts")) - 1)
    write_parts(events, "part", 3, tmp_path)
    stream = spark.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = JobStateTable(f"{tmp_path}/state")
    run(table.start(stream, f"{tmp_path}/ck"))
    order = ["job_id", "status", "progress_message", "created_at", "updated_at", "error", "n_events"]
    got = sorted(map(tuple, table.current(spark).select(order).collect()))
    want = sorted(map(tuple, jobs.job_state(events.drop("part")).select(order).collect()))
    assert got == want


def test_update_mode_state(spark, tables, tmp_path):
    events = tables.view("v_event")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    seen = []
    run(jobs.job_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/ck"))
    assert len(seen) == events.select("job_id").distinct().count()


def test_retention_timers(spark, tmp_path):
    rows = [
        (1, 1, "2024-01-01 00:00:00", "crawl"), (1, 2, "2024-01-01 00:10:00", "COMPLETED"),  # finished: evicted
        (2, 3, "2024-01-01 00:00:00", "crawl"),  # running: kept
        (3, 4, "2024-01-01 03:00:00", "FAILED"),  # finished, but too recent
    ]
    df = spark.createDataFrame(rows, "job_id long, event_id long, ts string, step string").withColumns({"ts": F.col("ts").cast("timestamp"), "message": F.lit("m")})
    late = spark.createDataFrame([(4, 9, "2024-01-01 03:30:00", "crawl")], "job_id long, event_id long, ts string, step string").withColumns({"ts": F.col("ts").cast("timestamp"), "message": F.lit("m")})
    for part in (df, late, late.withColumn("event_id", F.lit(10).cast("long"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    run(jobs.evictions(stream).writeStream.outputMode("append").foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck"))
    assert [(r.job_id, r.status) for r in seen] == [(1, "COMPLETED")]
    now = F.lit("2024-01-01 03:30:00").cast("timestamp")
    assert {r.job_id for r in jobs.evict_stale(jobs.job_state(df), now).collect()} == {2, 3}


def test_retention_of_repeated_unordered_and_restarted_streams(spark, tmp_path):
    import random

    dice, rows = random.Random(7), []
    for job in range(30):
        start = dice.randrange(0, 3000)
        for e in range(dice.randrange(1, 5)):
            rows.append((job, job * 10 + e, start + dice.randrange(0, 500), dice.choice(["crawl", "fusion", "COMPLETED", "FAILED"])))
    rows += dice.sample(rows, 20)  # delivered twice
    dice.shuffle(rows)
    event = lambda r: (r[0], r[1], f"2024-01-01 {r[2] // 3600:02d}:{r[2] // 60 % 60:02d}:{r[2] % 60:02d}", r[3])
    parts = [rows[i::3] for i in range(3)] + [[(99, 990 + i, 20_000 + i, "crawl")] for i in range(2)]
    frames = [spark.createDataFrame([event(r) for r in p], "job_id long, event_id long, ts string, step string").withColumns({"ts": F.col("ts").cast("timestamp"), "message": F.lit("m")}) for p in parts]
    seen = []
    for i, part in enumerate(frames):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i % 2:  # the stream is stopped and started again in between
            continue
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run(jobs.evictions(stream, 3600, "2 hours").writeStream.outputMode("append").foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck"))
    every = frames[0]
    for part in frames[1:]:
        every = every.unionByName(part)
    state = jobs.job_state(every.dropDuplicates(["event_id"]))
    now = F.lit("2024-01-01 03:33:00").cast("timestamp")
    kept = {r.job_id for r in jobs.evict_stale(state, now).collect()}
    want = sorted((r.job_id, r.status, r.created_at) for r in state.collect() if r.job_id not in kept)
    assert sorted((r.job_id, r.status, r.created_at) for r in seen) == want and want


def test_incremental_index(spark, tables, tmp_path):
    from vitrine.streaming.tables import IncrementalIndex, incremental_matches

    assets = tables.view("v_asset").filter("asset_id % 1000000 < 40").withColumn("ts", F.col("batch_no"))
    index = IncrementalIndex(f"{tmp_path}/index", f"{tmp_path}/matches")
    for b in range(3):
        index.process(assets.filter(F.col("batch_no") == b), b)
    index.process(assets.filter(F.col("batch_no") == 1), 1)  # a repeated batch changes nothing
    cols = ["asset_hash", "match_no", "match_hash", "similarity"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/matches").select(cols).collect()))
    want = sorted(map(tuple, incremental_matches(assets, [0, 1, 2]).select(cols).collect()))
    assert got == want and got
    assert index.index_before(spark, None).count() == build_index(assets).count()


def test_parts_give_the_rows_of_all_batches(spark, tables, tmp_path):
    from vitrine.streaming import tables as stored

    events = tables.view("v_event").withColumn("part", F.pmod("event_id", F.lit(5)))
    states = stored.JobStateTable(f"{tmp_path}/state")
    for b in (0, 1, 2, 2, 3, 4, 4):  # repeated batches after a failure
        states.process(events.filter(F.col("part") == b).drop("part"), b)
    order = ["job_id", "status", "progress_message", "created_at", "updated_at", "error", "n_events"]
    assert sorted(map(tuple, states.current(spark).select(order).collect())) == sorted(map(tuple, jobs.job_state(events.drop("part")).select(order).collect()))

    assets = tables.view("v_asset").filter("asset_id % 1000000 < 20").withColumn("ts", F.col("asset_id") % 7)
    index = stored.IncrementalIndex(f"{tmp_path}/index", f"{tmp_path}/matches")
    cols = ["asset_hash", "merchant_id", "ts"]
    for b in range(5):
        index.process(assets.filter(F.pmod("asset_id", F.lit(5)) == b), b)
        want = build_index(assets.filter(F.pmod("asset_id", F.lit(5)) <= b))
        assert sorted(map(tuple, index.index_before(spark, b + 1).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_storage_stays_bounded_over_many_batches(spark, tmp_path):
    from vitrine.streaming.tables import BatchTable

    table = BatchTable(f"{tmp_path}/t", build_index)
    rows = lambda b: spark.range(b * 20, b * 20 + 40).coalesce(1).selectExpr("concat('h', id) AS asset_hash", "id AS merchant_id", f"{b} AS ts", "sha2(cast(id AS string), 512) AS body")
    most = 0
    for b in range(40):
        table.add(rows(b), b)
        most = max(most, len(table._manifest(spark, None)["parts"]))
    build_index(table.read(spark)).coalesce(1).write.parquet(f"{tmp_path}/whole")
    whole = sum(f.stat().st_size for f in (tmp_path / "whole").glob("*.parquet"))
    assert most <= 6 and len(table._manifests(spark)) <= 2
    assert table.stored_bytes(spark) <= 3 * whole + 20_000  # footers and checksums of a few small files
    assert table.read(spark).count() == 40 * 20 + 20 and table.read(spark).filter("asset_hash = 'h25'").first().ts == 1


def test_a_batch_that_dies_between_any_two_steps_is_repeated(spark, tmp_path, monkeypatch):
    from vitrine.streaming import tables as stored

    rows = lambda b: spark.createDataFrame([(f"h{b}", b, b), ("shared", b, b)], "asset_hash string, merchant_id long, ts long").coalesce(1)
    content = lambda t, before=None: sorted(map(tuple, t.read(spark, before).collect()))
    clean = stored.BatchTable(f"{tmp_path}/clean", build_index)
    for b in range(4):
        clean.add(rows(b), b)

    def dies(*args):
        raise RuntimeError("executor lost")

    for step in ("merge", "_commit", "_vacuum"):
        table = stored.BatchTable(f"{tmp_path}/{step}", build_index)
        for b in range(3):
            table.add(rows(b), b)
        before = content(table)
        broken = stored.BatchTable(f"{tmp_path}/{step}", build_index)
        monkeypatch.setattr(broken, step, dies)
        try:
            broken.add(rows(3), 3)
        except RuntimeError:
            pass
        assert content(table, 3) == before  # what the batch has to see again
        table.add(rows(3), 3)
        assert content(table) == content(clean) and content(table, 3) == before
        named = {p["name"] for _, n in table._manifests(spark) for p in stored.json.loads(spark.read.option("wholetext", True).text(f"{tmp_path}/{step}/manifests/{n}").first()[0])["parts"]}
        assert set(stored._names(spark, f"{tmp_path}/{step}/parts")) == named


def test_windows_and_sessions_run_as_streams(spark, tables, tmp_path):
    events = tables.view("v_event")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for i, df in enumerate((jobs.status_counts(stream, "1 hour"), jobs.job_sessions(stream, "2 hours"))):
        run(df.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out{i}").option("checkpointLocation", f"{tmp_path}/ck{i}"))
        assert spark.read.parquet(f"{tmp_path}/out{i}").count() > 0


def test_last_write_wins(spark):
    rows = [("h", 1, 5), ("h", 2, 9), ("h", 3, 7), ("", 4, 1), (None, 5, 1), ("k", 6, 1)]
    got = {r.asset_hash: r.merchant_id for r in build_index(spark.createDataFrame(rows, "asset_hash string, merchant_id long, ts long")).collect()}
    assert got == {"h": 2, "k": 6}


def test_manifest_folder_and_sinks(spark, tmp_path):
    for folder, case, body in (("clean", "clean_02_flora_linen", '{"name": "Flora", "claims": {"brand_claim": "b"}}'), ("suspicious", "x1", '{"ground_truth": "MEDIUM"}'), ("other", "x2", "{}")):
        d = tmp_path / "eval_set" / folder / case
        d.mkdir(parents=True)
        (d / "meta.json").write_text(body)
    got = {r.case_id: r for r in read_case_manifests(spark, str(tmp_path / "eval_set")).collect()}
    assert {k: r.ground_truth for k, r in got.items()} == {"clean_02_flora_linen": "LOW", "x1": "MEDIUM"}
    assert got["x1"].merchant_name == "x1" and got["x1"].claims.brand_claim == "Claimed brand identity."
    assert read_case_manifests(spark, str(tmp_path / "eval_set"), original_only=True).count() == 1
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.0)], "id int, line string, x double")
    write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).filter(F.col("value").contains('"x":null')).count() == 1
    write_lines(df, str(tmp_path / "t"), "id")
    assert {r[0] for r in spark.read.text(str(tmp_path / "t")).collect()} == {"a", "b"}
