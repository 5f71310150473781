"""The whole workflow: every merchant comes back, and its parts agree with one another."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators.similarity import exact_round4
from vitrine.plans.merchant_report import build_report, updated_index
from vitrine.plans.refresh import affected_merchants, refresh_report
from vitrine.registry.report import report_inputs


@pytest.fixture(scope="module")
def report(tables):
    return build_report(report_inputs(tables))


def test_parts_of_the_report_agree(report, tables):
    decisions = {r.merchant_id: r for r in report.decisions.collect()}
    scored = {m for m, r in decisions.items() if not r.is_unverifiable}
    for part, merchants in ((report.fingerprints, set(decisions)), (report.tier_explanations, set(decisions)), (report.provenance, set(decisions))):
        ids = [r.merchant_id for r in part.select("merchant_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) == merchants
    listed = {r.merchant_id: r["count"] for r in report.candidates.groupBy("merchant_id").count().collect()}
    assert listed and {r.merchant_id: r.online_evidence_candidates for r in report.provenance.collect()} == {m: listed.get(m, 0) for m in decisions}
    counted = report.selected.groupBy("merchant_id").agg((F.count("*") + F.bool_or(F.col("role") == "logo").cast("int")).alias("n"))  # a logo counts again
    images = {r.merchant_id: r.n for r in counted.collect()}
    for m in {r.merchant_id for r in report_inputs(tables).documents.collect()} & scored:  # and a document
        images[m] = images.get(m, 0) + 1
    assert {r.merchant_id: r.images_analyzed for r in report.provenance.collect()} == {m: images.get(m, 0) for m in decisions}
    signals = report.signals.filter(F.col("signal_id").isin("forensic_manipulation", "identity_coherence"))
    assert signals.count() == 2 * len(scored)
    assert report.analysed_assets.count() == report.selected.count() > 0
    platform = report.candidates.filter("source_type = 'PLATFORM_VIT'")
    assert platform.filter("source_domain IS NULL OR similarity < 0.7").count() == 0


def test_limits_are_parameters(tables, report):
    few = build_report(report_inputs(tables), primary_only=False, selected_images_per_merchant=2, max_pages=2)
    assert few.selected.groupBy("merchant_id").count().agg(F.max("count")).first()[0] <= 2
    assert few.decisions.count() == report.decisions.count()


def test_catalogue_documents_and_write_back(spark, tables):
    inputs = report_inputs(tables)
    plain = build_report(replace(inputs, catalogue=None, documents=None))
    base = {r.merchant_id: r for r in plain.decisions.collect()}
    shown = plain.selected.select("merchant_id", "slot", "asset_hash", "embedding").collect()
    first = min(shown, key=lambda r: (r.merchant_id, r.slot))
    catalogue = spark.createDataFrame([("known.jpg", first.embedding)], "filename string, embedding array<double>")
    documents = spark.createDataFrame([(first.merchant_id, "none"), (-5, "x")], "merchant_id long, asset_id string")
    with_both = build_report(replace(inputs, catalogue=catalogue, documents=documents))
    got = {r.merchant_id: r for r in with_both.decisions.collect()}
    sims = {}
    for r in shown:
        a, b = np.array(r.embedding), np.array(first.embedding)
        sims.setdefault(r.merchant_id, []).append(float(exact_round4(np.clip(np.array([a @ b / np.linalg.norm(a) / np.linalg.norm(b)]), 0, 1))[0]))
    assert set(got) == set(base)
    for m, r in got.items():
        best = max(sims.get(m, [0.0]))
        if base[m].is_unverifiable:
            assert r.is_unverifiable
        elif best > base[m].max_similarity:
            assert r.max_similarity == best
        else:
            assert (r.max_similarity, r.reuse_risk_score) == (base[m].max_similarity, base[m].reuse_risk_score)
    assert got[first.merchant_id].max_similarity == 1.0 and got[first.merchant_id].reuse_risk_score >= 40.0
    assert got[first.merchant_id].manipulation_score == 5.0  # the document has no cells: the neutral score
    provenance = {r.merchant_id: r.images_analyzed for r in with_both.provenance.collect()}
    before = {r.merchant_id: r.images_analyzed for r in plain.provenance.collect()}
    assert {m: provenance[m] - before[m] for m in before if provenance[m] != before[m]} == {first.merchant_id: 1}
    index = inputs.index.withColumn("ts", F.lit(1).cast("long"))
    after = updated_index(index, plain, F.lit(2))
    hashes = {r.asset_hash for r in shown}
    assert {r.asset_hash for r in after.filter("ts = 2").collect()} == hashes
    assert after.count() == len(hashes | {r.asset_hash for r in inputs.index.select("asset_hash").collect()})


def test_one_changed_page_is_one_merchant(spark, tables):
    old = report_inputs(tables)
    before = build_report(old)
    live = before.decisions.filter("NOT is_unverifiable").agg(F.min("merchant_id")).first()[0]
    more = F.concat("html", F.lit("<p>contact us, privacy policy, refund policy, pricing, about us</p><img src='https://cdn.example.com/new.jpg'>"))
    page = old.pages.filter(F.col("merchant_id") == live).agg(F.min("page_id")).first()[0]
    new = replace(old, pages=old.pages.withColumn("html", F.when((F.col("merchant_id") == live) & (F.col("page_id") == page), more).otherwise(F.col("html"))))
    done = refresh_report(old, new, before)
    assert [r.merchant_id for r in done.affected.collect()] == [live]
    whole = build_report(new)
    for part in ("decisions", "conclusions", "candidates"):
        a, b = getattr(done.report, part), getattr(whole, part)
        rows = lambda df, columns=a.columns: sorted(str(tuple(r)) for r in df.select(*columns).collect())
        assert rows(a) == rows(b), part


def test_changes_of_shared_tables_reach_those_that_use_them(spark, tables):
    old = report_inputs(tables)
    report = build_report(old)
    shown = report.selected.select("merchant_id", "asset_hash", "domain", "embedding").collect()
    one = shown[0]
    entry = spark.createDataFrame([("fresh", 999_999, "far.example.org", one.embedding)], old.index.schema)
    close = {r.merchant_id for r in shown if np.dot(r.embedding, one.embedding) / np.linalg.norm(r.embedding) / np.linalg.norm(one.embedding) >= 0.82}
    other = next(r for r in shown if r.merchant_id not in close)
    cells = spark.createDataFrame([(other.asset_hash, 3.0)], "asset_hash string, energy double")
    same = {r.merchant_id for r in shown if r.asset_hash == other.asset_hash}
    handed = {r.merchant_id for r in old.documents.filter(F.col("asset_id") == other.asset_hash).collect()}
    new = replace(old, index=old.index.unionByName(entry), blocks=old.blocks.unionByName(cells))
    reached = {r.merchant_id for r in affected_merchants(old, new, report).collect()}
    assert close | same <= reached <= close | same | handed
