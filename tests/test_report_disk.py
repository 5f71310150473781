"""What a report writes: images are chosen by narrow rows, and what its jobs shuffle goes as they end."""

from pyspark.sql import functions as F

from vitrine.operators import assets, candidates
from vitrine.plans import merchant_report
from vitrine.registry import report
from vitrine.registry.report import report_inputs
from vitrine.session import FILE_CLEANUP

FETCHED = "src string, asset_hash string, width int, height int, n_bytes long, dhash long, embedding array<double>"


def test_images_are_chosen_without_their_vectors(spark, tables, monkeypatch):
    report.checkpoint_dir(spark)
    shown = "".join(f'<img src="https://cdn.example.com/{name}.jpg" alt="a long name">' for name in ("a", "b", "c", "d"))
    pages = spark.createDataFrame([(m, 10 + m, f"https://shop{m}.example.com/", f"<html><body>{shown}</body></html>") for m in (1, 2)], "merchant_id long, page_id long, url string, html string")
    src = "https://cdn.example.com/{}.jpg".format
    rows = [(src("a"), "ha", 400, 400, 5000, 0, [1.0, 2.0]), (src("b"), "hb", 400, 400, 5000, 255, None), (src("c"), "hc", 400, 400, 5000, 255 << 16, [3.0, 4.0]),
            (src("c"), "hc", 400, 400, 5000, 255 << 16, [5.0, 6.0]), (src("e"), "he", 400, 400, 5000, 255 << 32, [7.0, 8.0])]  # c was fetched twice, d never, e is not shown
    names = spark.createDataFrame([(1, "One", "shop1.example.com"), (2, "Two", "shop2.example.com")], "merchant_id long, merchant_name string, domain string")
    seen, clusters = [], assets.perceptual_clusters

    def watched(named, *args, **kwargs):
        seen.append(named.columns)
        return clusters(named, *args, **kwargs)

    monkeypatch.setattr(assets, "perceptual_clusters", watched)
    got = merchant_report.selected_images(pages, spark.createDataFrame(rows, FETCHED), names)
    assert {"asset_key", "slot", "embedding"} <= set(got.columns) and not {"v1", "v2"} & set(got.columns)
    found = sorted((r.merchant_id, r.asset_hash, tuple(r.embedding or ())) for r in got.collect())
    assert found == sorted((m, r[1], tuple(r[6] or ())) for m in (1, 2) for r in rows[:4])
    assert "embedding" not in seen[0]


def test_candidates_of_other_images_are_left_out_first(tables, monkeypatch):
    plans = []

    def stop(pairs):
        plans.append(pairs._jdf.queryExecution().analyzed().toString())
        raise InterruptedError

    monkeypatch.setattr(candidates, "verify_candidates", stop)
    try:
        merchant_report.build_report(report_inputs(tables))
    except InterruptedError:
        pass
    assert "LeftSemi" in plans[0]


def test_shuffles_of_a_report_are_dropped_as_its_jobs_end(spark, tables, monkeypatch):
    before, during = spark.conf.get(FILE_CLEANUP), []
    monkeypatch.setattr(report, "build_report", lambda inputs: during.append(spark.conf.get(FILE_CLEANUP)))
    fetched = []
    monkeypatch.setattr(report, "report_inputs", lambda t: fetched.append(t))
    report.merchant_report(tables)
    assert during == ["true"] and fetched and spark.conf.get(FILE_CLEANUP) == before


def test_vectors_of_fetched_images_are_not_written(tables):
    fetched = report_inputs(tables).fetched
    leaves = fetched._jdf.queryExecution().optimizedPlan().collectLeaves()
    written = [leaves.apply(i) for i in range(leaves.size()) if "LogicalRDD" in leaves.apply(i).getClass().getName()]
    assert written and not any("array" in w.schema().simpleString() for w in written)
    assert fetched.filter(F.size("embedding") > 0).count() == fetched.count() > 0
