"""The paths taken only by large inputs, forced on small ones and checked against brute force."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.vectors import cosine
from vitrine.operators import assets, evaluation, logos, pages, quantiles, similarity, vector_tree


def brute(a, b):
    n = min(len(a), len(b))
    a, b = np.array(a[:n], float), np.array(b[:n], float)
    d = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if d == 0 else float(np.clip(a @ b / d, 0, 1))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_tree, "LEAF", 24)
    monkeypatch.setattr(similarity, "FRONT", 3)


@pytest.fixture(scope="module")
def vectors():
    """Clusters, exact copies under several owners, a zero vector, two lengths."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(150):
        v = centres[i % 6] + 0.25 * rng.standard_normal(12)
        rows.append([f"h{i:04d}", int(i % 9), f"shop{i % 9}.com", [float(x) for x in v]])
    hot = [float(x) for x in centres[0]]
    for i in range(60):  # one vector at many merchants, most of them one merchant's
        m = 3 if i < 40 else 10 + i
        rows.append([f"copy{i:04d}", m, f"shop{m}.com" if i % 7 else "com", hot])
    rows.append(["zero", 1, "shop1.com", [0.0] * 12])
    for i in range(12):
        rows.append([f"short{i}", 40 + i, f"s{i}.net", rows[i][3][:8]])
    return rows


SCHEMA = "asset_hash string, merchant_id long, domain string, embedding array<double>"


def expected_matches(rows, limit=5):
    out = {}
    for h, m, d, v in rows:
        found = []
        for h2, m2, d2, v2 in rows:
            if h2 == h or m2 == m or d2 == d or d2.endswith("." + d):
                continue
            s = brute(v, v2)
            if s >= 0.82:
                found.append((-round(s, 4), h2))
        out[h] = [(x[1], -x[0]) for x in sorted(found)[:limit]]
    return out


def test_index_matches_with_cut_groups_and_leaves(spark, vectors, small_blocks):
    df = spark.createDataFrame([tuple(r) for r in vectors], SCHEMA)
    got = {}
    for r in similarity.index_matches(df, df).orderBy("asset_hash", "match_no").collect():
        got.setdefault(r.asset_hash, []).append((r.match_hash, r.similarity))
    want = {k: v for k, v in expected_matches(vectors).items() if v}
    assert got == want


def test_index_matches_of_one_length(spark, vectors, small_blocks):
    rows = [r for r in vectors if len(r[3]) == 12]
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    got = {}
    for r in similarity.index_matches(df, df).orderBy("asset_hash", "match_no").collect():
        got.setdefault(r.asset_hash, []).append((r.match_hash, r.similarity))
    assert got == {k: v for k, v in expected_matches(rows).items() if v}


def test_pairs_equal_brute_force(spark, vectors, small_blocks):
    df = spark.createDataFrame([tuple(r) for r in vectors], SCHEMA)
    got = {(r.left_id, r.right_id): (r.similarity, r.left_copies, r.right_copies) for r in similarity.similar_pairs(df, 0.8, "asset_hash").collect()}
    groups = {}
    for h, _, _, v in vectors:
        groups.setdefault(tuple(v), []).append(h)
    reps = [(min(ids), len(ids), v) for v, ids in groups.items()]
    want = {}
    for i, n, v in reps:
        if n > 1 and any(v):
            want[i, i] = (1.0, n, n)
        for j, n2, v2 in reps:
            if i < j and brute(v, v2) >= 0.8:
                want[i, j] = (round(brute(v, v2), 4), n, n2)
    assert got == want


def test_approximate_pairs_are_a_subset(spark, vectors, small_blocks):
    df = spark.createDataFrame([tuple(r) for r in vectors if len(r[3]) == 12], SCHEMA)
    exact = {tuple(r) for r in similarity.similar_pairs(df, 0.9, "asset_hash").collect()}
    near = [tuple(r) for r in similarity.approximate_pairs(df, 0.9, id_col="asset_hash").collect()]
    assert len(near) == len(set(near)) and set(near) <= exact
    assert len(near) >= 0.9 * len(exact)


def test_catalogue_top_matches(spark, vectors, small_blocks):
    images = spark.createDataFrame([(i, r[3]) for i, r in enumerate(vectors[::3])], "asset_id long, embedding array<double>")
    files = [(f"f{i:03d}.jpg", r[3]) for i, r in enumerate(vectors[1::2])]
    got = {}
    for r in similarity.catalogue_matches(images, spark.createDataFrame(files, "filename string, embedding array<double>")).orderBy("match_no").collect():
        got.setdefault(r.asset_id, []).append((r.filename, r.similarity))
    for i, r in enumerate(vectors[::3]):
        want = sorted((-round(brute(r[3], v), 4), f) for f, v in files)[:5]
        assert got[i] == [(f, -s + 0.0) for s, f in want], i


def test_coherence_over_blocks(spark, vectors):
    df = spark.createDataFrame([(r[1] % 3, r[3]) for r in vectors], "merchant_id long, embedding array<double>")
    got = {r.merchant_id: r for r in similarity.identity_coherence(df, block=7).collect()}
    for m in range(3):
        vs = [r[3] for r in vectors if r[1] % 3 == m]
        mean = np.mean([brute(a, b) for i, a in enumerate(vs) for b in vs[i + 1 :]])
        assert got[m].n_images == len(vs)
        assert abs(got[m].mean_similarity - mean) < 1e-9


def fold(hashes):
    leaders, out = [], []
    for o, h in hashes:
        hit = next((lo for lo, lh in leaders if bin(h ^ lh).count("1") <= 4), None)
        if hit is None:
            leaders.append((o, h))
            hit = o
        out.append((o, hit))
    return out


@pytest.mark.parametrize("limit", [20_000, 10])
def test_clusters_equal_sequential_fold(spark, limit):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, 6)
    rows = []
    for o in range(240):
        h = int(base[o % 6])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            h ^= 1 << int(b)
        h = h - 2**64 if h >= 2**63 else h
        rows.append((o % 2 if o % 5 else 2, o, h))
    df = spark.createDataFrame(rows, "merchant_id long, asset_ord long, dhash long")
    got = {(r.merchant_id, r.asset_ord): r.leader_ord for r in assets.perceptual_clusters(df, group_limit=limit).collect()}
    for m in (0, 1, 2):
        for o, lead in fold([(o, h & (2**64 - 1)) for mm, o, h in rows if mm == m]):
            assert got[m, o] == lead


@pytest.mark.parametrize("sketch", [8, 4096])
def test_percentile_by_bracket(spark, sketch, monkeypatch):
    rng = np.random.default_rng(2)
    data = {1: rng.lognormal(0, 2, 9000), 2: np.repeat([1.0, 2.0], [500, 30]), 3: rng.random(4), 4: np.concatenate([rng.random(3000), [1e12]]), 5: np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [(3, None), (6, None)], "g long, v double").repartition(5)
    for margin in (quantiles._margin, lambda size: 1e-3):  # with a small margin a small sketch misses, and the exact way answers
        monkeypatch.setattr(quantiles, "_margin", margin)
        for q in (0.0, 0.5, 0.95, 1.0):
            got = {r.g: (r.n, r.percentile) for r in quantiles.group_percentile(df, "g", "v", q, sketch).collect()}
            assert set(got) == set(data)
            for g, vs in data.items():
                assert got[g][0] == len(vs)
                assert got[g][1] == pytest.approx(np.percentile(vs, q * 100), rel=1e-12)


def test_bracket_keeps_a_small_share(spark):
    df = spark.range(200_000).selectExpr("id % 2 AS g", "cast(hash(id) AS double) AS v")
    plan = quantiles._bracketed(df, "g", 0.95, 4096)
    assert plan.filter("hit").count() == 2
    assert quantiles._margin(4096) < 0.005


def test_cosine_of_different_lengths(spark):
    df = spark.createDataFrame([([1.0, 0.0, 5.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [-1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.5**0.5, 0.0, 0.0])


def test_brand_references_are_complete(spark):
    brands = ["Luxe Atelier", "apex", "Zed", "My Apex Brands Shop", "luxe", ""]
    files = ["verified_brand_luxe-atelier.png", "apex_brands.jpg", "zed.png", "qq.webp"]
    got = {
        (r.claimed_brand, r.filename)
        for r in logos.brand_references(
            spark.createDataFrame([(b,) for b in brands], "claimed_brand string"), spark.createDataFrame([(f,) for f in files], "filename string")
        ).collect()
    }
    want = set()
    squash = lambda s: s.lower().replace(" ", "").replace("-", "").replace("_", "")
    for b in brands:
        for f in files:
            c = squash(f)
            if b and (squash(b) in c or c.replace(".png", "").replace(".jpg", "") in squash(b) or any(w in c for w in b.lower().split() if len(w) > 3)):
                want.add((b, f))
    assert got == want


@pytest.mark.parametrize("bucket", [8, 4096])
def test_nearly_equal_hashes_in_blocks(spark, bucket, monkeypatch):
    """A merchant of nearly equal hashes: blocks of bounded size, no pair list, the same clusters as in sequence."""
    monkeypatch.setattr(assets, "BUCKET", bucket)
    rng = np.random.default_rng(12)
    base = int(rng.integers(0, 2**62))
    hashes = set()
    while len(hashes) < 160:
        h = base
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            h ^= 1 << int(b)
        hashes.add(h)
    rows = [(7, o, h - 2**64 if h >= 2**63 else h) for o, h in enumerate(rng.permutation(np.array(sorted(hashes), dtype=object)).tolist())]
    df = spark.createDataFrame(rows, "merchant_id long, asset_ord long, dhash long")
    got = {r.asset_ord: r.leader_ord for r in assets.perceptual_clusters(df, group_limit=5).collect()}
    assert got == dict(fold([(o, h & (2**64 - 1)) for _, o, h in rows]))


def test_earliest_hashes_decide_a_large_bucket():
    rng = np.random.default_rng(1)
    h = np.uint64(0x0F0F) ^ (np.uint64(1) << rng.integers(0, 64, 60_000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60_000).astype(np.uint64))
    found = assets._any_earlier(h, np.arange(len(h)), np.full(len(h), -1), 4)
    assert not found[0] and found[1:].all()
    few = h[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    side, ords = rng.integers(0, 2, 200), rng.permutation(200)
    want = [any(ords[j] < ords[i] and side[i] != side[j] and int(few[i] ^ few[j]).bit_count() <= 4 for j in range(200)) for i in range(200)]
    assert assets._any_earlier(few, ords, side, 4).tolist() == want


def test_percentiles_of_many_partitions_and_of_nan(spark):
    """Parts of a union with different numbers of partitions, and groups that hold NaN only or NaN at a wanted rank."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(200_000).select((F.col("id") % 14).alias("step"), F.rand(3).alias("latency_ms")).repartition(24)
        got = {r.step: r for r in evaluation.latency_summary(rows, "step").collect()}
        want = {r.step: r for r in rows.groupBy("step").agg(F.percentile("latency_ms", 0.5).alias("p50"), F.percentile("latency_ms", 0.95).alias("p95")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 14 and all((got[s].p50_ms, got[s].p95_ms) == (w.p50, w.p95) for s, w in want.items())
    nan = float("nan")
    odd = spark.createDataFrame([("only", nan)] * 3 + [("some", nan)] * 2 + [("some", float(i)) for i in range(8)], "step string, latency_ms double")
    got = {r.step: (r.n, r.p50_ms, r.p95_ms) for r in evaluation.latency_summary(odd, "step").collect()}
    assert got["only"][0] == 3 and got["only"][1] != got["only"][1] and got["only"][2] != got["only"][2]
    assert got["some"][:2] == (10, 4.5) and got["some"][2] != got["some"][2]


def test_logo_of_tags_without_the_words(spark):
    """Tags are looked into only where they show the words or a character reference; the first in document order counts."""
    pages_ = {
        1: '<img src="/a.png"><img class="x lo&#103;o" src="/b.png"><img class="logo" src="/c.png">',
        2: '<img src="/logo.png"><img id="Brand" src="/b.png">',
        3: '<a class="nav" href="/"><img src="/a.png"></a><a class="br&#x61;nd" href="/"><img src="/b.png"></a>',
        4: '<img alt="our logo" src="/a.png"><img id="logo" src="/b.png">',
        5: '<img src="/a.png"><p>logo</p>',
    }
    df = spark.createDataFrame([(k, f"<html><body>{v}</body></html>") for k, v in pages_.items()], "page_id int, html string")
    got = {r.page_id: r.u for r in df.select("page_id", pages.logo_candidate(F.col("html"), F.lit("https://shop.example/")).alias("u")).collect()}
    assert got == {k: v and f"https://shop.example/{v}" for k, v in {1: "b.png", 2: "b.png", 3: "b.png", 4: "b.png", 5: None}.items()}


def test_recall_leaves_no_shuffled_vectors(spark, tables):
    """What one join of the recall query shuffles is gone before the counts are made."""
    from vitrine.registry import REGISTRY

    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = files()
    counts = REGISTRY["approximate_pairs_recall"].build(tables)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.5)
    assert not files() - before
    row = counts.first()
    assert row.exact_pairs > 0 and row.wrong_pairs == 0 and row.recall_reached


def test_plans_hold_one_table_of_references_for_all_that_a_page_decodes(spark):
    page = spark.createDataFrame([(1, 1, "https://shop.example/", "<title>A&eacute;</title><img class='logo' src='a.png?x=1&amp;y=2'>")], "merchant_id long, page_id long, url string, html string")
    tables = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("&CounterClockwiseContourIntegral;")
    facts = pages.crawl_facts(page)
    assert tables(facts) == 1
    got = facts.first()
    assert (got.title, got.logo_url) == ("Aé", "https://shop.example/a.png?x=1&y=2")
