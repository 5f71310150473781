"""Vector tree, LSH forest, hash neighbours and logo scopes against brute force, with leaves small enough to be cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import evaluation, logos, similarity, vector_tree


def clustered(n, clusters, dim, noise, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return centres[np.arange(n) % clusters] + noise * rng.standard_normal((n, dim))


def cosines(a, b):
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    norms = np.outer(na, nb)
    return np.clip(np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0), 0, 1)


def frame(spark, vectors, name="asset_id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(4)


def test_leaf_pairs_are_spared_on_clustered_vectors(spark):
    m = clustered(2400, 40, 48, 0.12, 1).astype(np.float32)
    df = frame(spark, m)
    met, every = similarity.leaf_shares(df, 0.9, 64)
    assert every > 500 and met <= 0.2 * every
    want = cosines(m.astype(float), m.astype(float))
    got = {(int(r.left_id), int(r.right_id)): r.similarity for r in similarity.similar_pairs(df, 0.9, leaf=64).collect()}
    assert {tuple(sorted(k)) for k in got} == {(int(i), int(j)) for i, j in zip(*np.nonzero(want >= 0.9)) if i < j}
    assert all(abs(v - want[k]) < 6e-5 for k, v in got.items())


def test_points_never_move_vectors_apart():
    rng = np.random.default_rng(4)
    for dim in (1, 3, 16, 17, 64):
        m = rng.standard_normal((60, dim))
        axes, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        p, u = vector_tree.points(m, axes), vector_tree.unit(m)
        far = lambda x: np.linalg.norm(x[:, None] - x[None], axis=2)
        assert (far(p) <= far(u) + 1e-9).all()


def test_structureless_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    m = np.vstack([rng.standard_normal((300, 8)), np.zeros((1, 8)), np.repeat([[1.0] * 8], 90, axis=0), np.eye(8) * 3, -np.eye(8)]).astype(np.float32)
    got = {(r.left_id, r.right_id): (r.left_copies, r.right_copies) for r in similarity.similar_pairs(frame(spark, m), 0.7, leaf=20).collect()}
    groups = {}
    for i, v in enumerate(m):
        groups.setdefault(tuple(v), []).append(str(i))
    reps = [(min(ids), len(ids), np.array([v], float)) for v, ids in groups.items()]
    want = {(i, i): (n, n) for i, n, v in reps if n > 1 and v.any()}
    want |= {(i, j): (n, k) for i, n, v in reps for j, k, w in reps if i < j and cosines(v, w)[0, 0] >= 0.7}
    assert got == want
    assert similarity.similar_pairs(frame(spark, m).where("false"), 0.7, leaf=20).count() == 0


@pytest.mark.parametrize("leaf", [16, 100_000])
def test_best_five_of_a_catalogue(spark, leaf, monkeypatch):
    monkeypatch.setattr(vector_tree, "LEAF", leaf)
    files = clustered(700, 30, 20, 0.3, 5).astype(np.float32)
    files[600:] = files[:100]  # ties
    files[5], images = 0, np.vstack([files[::7], clustered(100, 10, 20, 1.0, 6), np.zeros((1, 20)), -files[:3]]).astype(np.float32)
    catalogue = frame(spark, files, "k").select(F.format_string("f%04d", "k").alias("filename"), "embedding")
    got = {}
    for r in similarity.catalogue_matches(frame(spark, images), catalogue).orderBy("match_no").collect():
        got.setdefault(r.asset_id, []).append((r.filename, r.similarity))
    sims = similarity.exact_round4(cosines(images.astype(float), files.astype(float)))
    for i in range(len(images)):
        want = [(f"f{j:04d}", s) for s, j in sorted((-s, j) for j, s in enumerate(sims[i]))[:5]]
        assert got[i] == [(f, -s + 0.0) for f, s in want], i


def test_far_leaves_are_not_visited(spark):
    """With clusters apart, the second round meets a small share of all leaf pairs."""
    files, images = (frame(spark, clustered(2000, 40, 32, 0.1, 7), "k"), frame(spark, clustered(1600, 40, 32, 0.1, 7) + 0.01, "k"))
    named = lambda df: similarity.with_vectors(df.select(F.col("k").cast("string").alias("row_id"), F.lit("").alias("space"), "embedding"))
    axes = vector_tree.principal_axes(named(files))
    q, g = vector_tree.grow(named(images), axes, 40), vector_tree.grow(named(files), axes, 40)
    floors = q.nodes.select("level", "space", "node", F.lit(0.9).alias("floor"))
    far, every = vector_tree.leaf_pairs(q, g, floors=floors).count(), q.nodes.where(F.col("level") == q.depth).count() * g.nodes.where(F.col("level") == g.depth).count()
    assert far <= 0.2 * every
    near = vector_tree.leaf_pairs(q, g, nearest=2)
    assert near.groupBy("a").count().agg(F.max("count")).first()[0] <= 2
    assert max(r.n for r in g.nodes.where(F.col("level") == g.depth).collect()) <= 40


def test_forest_follows_the_table(spark):
    found = []
    for n in (500, 5000):
        m = clustered(n, n // 2, 32, 0.35, 8).astype(np.float32)
        df = frame(spark, m)
        groups = similarity.vector_groups(df).checkpoint() if spark.sparkContext.getCheckpointDir() else similarity.vector_groups(df)
        _, sizes = similarity.forest_buckets(groups, 0.8, 64, 11)
        assert sizes.where(F.col("bits") < similarity.SIGNATURE).agg(F.max("n")).first()[0] <= 64
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(cosines(m.astype(float), m.astype(float)) >= 0.8)) if i < j}
        got = {tuple(sorted((int(r.left_id), int(r.right_id)))) for r in similarity.approximate_pairs(df, 0.8, bucket=64).collect()}
        assert got <= want and len(got) >= 0.95 * len(want)
        found.append(similarity.forest_shape(n, 0.8, 64))
    assert found[1][0] > found[0][0] and found[1][1] > found[0][1]


def test_one_signature_of_many_rows_is_cut_into_blocks(spark):
    rng = np.random.default_rng(3)
    m = (np.ones((150, 6)) + 1e-9 * rng.standard_normal((150, 6))).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "asset_id long, embedding array<double>")
    assert similarity.approximate_pairs(df, 0.9, bucket=20).count() == 150 * 149 // 2


def test_forest_sends_a_row_to_each_block_once(spark, monkeypatch):
    """Rows do not travel to the buckets of every tree, and no pair of a bucket of the whole table is lost."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    sent, made = [], PandasCogroupedOps.__init__
    monkeypatch.setattr(PandasCogroupedOps, "__init__", lambda self, a, b: (sent.append(a._df.count() + b._df.count()), made(self, a, b))[1])
    m = clustered(2000, 900, 32, 0.35, 8).astype(np.float32)
    found = similarity.approximate_pairs(frame(spark, m), 0.8, bucket=64)
    assert sent == [2000 * vector_tree.BLOCKS]
    got = [tuple(sorted((int(r.left_id), int(r.right_id)))) for r in found.collect()]
    placed, sizes = similarity.forest_buckets(similarity.vector_groups(frame(spark, m)).checkpoint(), 0.8, 64, 11)
    buckets = {}
    for r in placed.collect():
        buckets.setdefault((r.tree, r.bits, r.code), []).append(int(r.row_id))
    sims = cosines(m.astype(float), m.astype(float))
    shared = {(i, j) for ids in buckets.values() for i in ids for j in ids if i < j and sims[i, j] >= 0.8}
    assert len(got) == len(set(got)) and shared <= set(got)


def test_forest_of_two_lengths(spark):
    m = clustered(300, 60, 16, 0.2, 4).astype(float)
    df = spark.createDataFrame([(i, v[: 10 if i % 3 else 16].tolist()) for i, v in enumerate(m)], "asset_id long, embedding array<double>")
    exact = {tuple(r) for r in similarity.similar_pairs(df, 0.9).collect()}
    near = [tuple(r) for r in similarity.approximate_pairs(df, 0.9, bucket=20).collect()]
    assert len(near) == len(set(near)) and set(near) <= exact and len(near) >= 0.95 * len(exact)


def test_nearest_hashes(spark):
    dice = random.Random(6)
    refs = [dice.getrandbits(64) for _ in range(300)]
    asked = refs[:20] + [r ^ (1 << dice.randrange(64)) for r in refs[:100]] + [dice.getrandbits(64) for _ in range(60)] + [2**64 - 1, 0]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    side = lambda hs: spark.createDataFrame([(signed(h),) for h in hs] + [(None,)], "dhash long")
    got = {r.dhash: r.hash_similarity for r in evaluation.nearest_hashes(side(asked), side(refs), leaf=24).collect()}
    assert got == {signed(a): 1 - min(bin(a ^ r).count("1") for r in refs) / 64 for a in asked}


def test_contained_texts(spark):
    dice = random.Random(2)
    text = lambda n: "".join(dice.choice("abé ") for _ in range(n))
    hays, needles = [text(dice.randrange(0, 14)) for _ in range(120)] + [None], [text(dice.randrange(0, 6)) for _ in range(80)] + ["", "zzz", "abz", None]
    hay = spark.createDataFrame(list(enumerate(hays)), "hay_id long, hay string")
    got = sorted(tuple(r) for r in logos.contained(hay, spark.createDataFrame([(n,) for n in needles * 2], "needle string")).collect())
    assert got == sorted((i, n) for i, h in enumerate(hays) if h is not None for n in set(needles) - {None} if n in h)


@pytest.mark.parametrize("leaf", [12, 100_000])
def test_best_reference_where_one_word_is_in_every_file_name(spark, leaf):
    rng, dice = np.random.default_rng(9), random.Random(9)
    brands = ["Acme Store", "Store", "Lux-Acme store", "nobody", "", None, "Zed store"]
    files = [(f"store_{'acme' if i % 3 else 'zed'}_{i}.png", rng.standard_normal(10).round(1).tolist() if i % 11 else None) for i in range(200)] + [("lux.jpg", [0.0] * 10), ("zed.png", [1.0] * 4)]
    shown = [(m, dice.choice(brands), files[dice.randrange(200)][1] if m % 7 else ([0.0] * 10 if m % 2 else None)) for m in range(150)]
    registry = spark.createDataFrame(files, "filename string, embedding array<double>")
    claimed = spark.createDataFrame(shown, "merchant_id long, claimed_brand string, embedding array<double>")
    got = {r.merchant_id: (r.best, r.matched_logo) for r in logos.best_references(claimed, registry, leaf).collect()}
    squash = lambda s: s.lower().replace(" ", "").replace("-", "").replace("_", "")
    want = {}
    for m, b, v in shown:
        found = []
        for f, w in files if b and v else []:
            c = squash(f)
            if w and (squash(b) in c or c.replace(".png", "").replace(".jpg", "") in squash(b) or any(x in c for x in b.lower().split() if len(x) > 3)):
                n = min(len(v), len(w))
                found.append((-float(similarity.exact_round4(cosines(np.array([v[:n]]), np.array([w[:n]])))[0, 0]), f))
        if found:
            want[m] = (-min(found)[0] + 0.0, min(found)[1])
    assert got == want and len({k for k, v in got.items() if v[0] > 0}) > 30


@pytest.mark.parametrize("noise", [0.05, 1.0])
def test_coherence_by_sums(spark, noise):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for m in range(2):
        centre = rng.standard_normal(12)
        vs = [v for v in centre + noise * rng.standard_normal((90, 12))]
        vs += [vs[0]] * 5 + [np.zeros(12)] * 2 + [v[:7] for v in vs[:20]] + [-vs[3]]
        rows += [(m, v.tolist()) for v in vs]
        pairs = []
        for i, a in enumerate(vs):
            for b in vs[i + 1 :]:
                n = min(len(a), len(b))
                pairs.append(cosines(a[None, :n], b[None, :n])[0, 0])
        want[m] = np.mean(pairs)
    df = spark.createDataFrame(rows, "merchant_id long, embedding array<double>")
    got = {r.merchant_id: r.mean_similarity for r in similarity.identity_coherence(df, block=8).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_leaves_are_few_and_travel_in_blocks(spark, monkeypatch):
    """A node is cut no further than its size asks, and a row is sent to the blocks that it meets, not to every leaf."""
    monkeypatch.setattr(vector_tree, "BLOCKS", 2)
    rng = np.random.default_rng(12)
    rows = frame(spark, rng.standard_normal((1000, 24)), "k").select(F.col("k").cast("string").alias("row_id"), F.lit("").alias("space"), "embedding")
    tree = vector_tree.grow(rows, vector_tree.principal_axes(rows), 64)
    leaves = tree.blocks.collect()
    assert 16 <= len(leaves) <= 64 and {r.block for r in leaves} <= {0, 1, 2}
    pairs = vector_tree.leaf_pairs(tree, tree, threshold=-1.0, ordered=True)
    assert pairs.count() == len(leaves) * (len(leaves) + 1) // 2

    def sizes(key, q, g, meetings):
        import pyarrow as pa

        met = sum(len(i) * (len(i) - 1) // 2 if same else len(i) * len(j) for i, j, same in meetings)
        return pa.table({"sent": pa.array([q.num_rows + g.num_rows], pa.int64()), "met": pa.array([met], pa.int64())})

    got = vector_tree.block_join(tree, tree, pairs, sizes, "sent long, met long", ["row_id"], ["row_id"], True).agg(F.sum("sent"), F.sum("met")).first()
    assert got[1] == 1000 * 999 // 2 and got[0] <= 1000 * 2 * 3


def test_first_look_in_single_precision_loses_nothing(spark):
    """Similarities nearer to the threshold than single precision tells apart."""
    rng = np.random.default_rng(13)
    base = np.zeros((60, 40))
    base[:, 0] = 1.0
    angle = np.arccos(0.7) + rng.uniform(-3e-8, 3e-8, 59)
    base[1:, 0], base[np.arange(1, 60), 1 + np.arange(59) % 39] = np.cos(angle), np.sin(angle)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "asset_id long, embedding array<double>")
    got = {r.right_id if r.left_id == "0" else r.left_id for r in similarity.similar_pairs(df, 0.7).collect() if "0" in (r.left_id, r.right_id)}
    cos = base[1:, 0] / np.linalg.norm(base[1:], axis=1)
    assert {str(i + 1) for i in np.flatnonzero(cos >= 0.7 + 1e-12)} <= got <= {str(i + 1) for i in np.flatnonzero(cos >= 0.7 - 1e-12)}
