"""Image filtering, deduplication, clustering and selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hamming
from ..functions.ladders import ladder
from ..functions.urls import url_path, url_safety_reason
from ..session import checkpoint_dir

MAX_CANDIDATES = 30
MAX_DUPLICATE_BITS = 4
MIN_BYTES, MAX_BYTES = 150, 10 * 1024 * 1024
MAX_DIMENSION = 4096

# URL marks of trackers and spacers, and of interface decoration.
TRACKER_MARKS = ["1x1", "pixel", "tracking", "analytics", "spacer", "blank.gif", "empty.png"]
DECORATION_MARKS = ["icon", "arrow", "chevron", "star-rating", "spinner", "loader"]


def _any(value: Column, marks: list[str]) -> Column:
    return value.rlike("|".join(m.replace(".", r"\.") for m in marks))


def is_interface_image(src: Column, css: Column, logo: Column) -> Column:
    """E1. Trackers always; decoration, vector and icon files unless a logo candidate."""
    s, c = F.lower(src), F.lower(F.coalesce(css, F.lit("")))
    soft = _any(s, DECORATION_MARKS) | _any(c, DECORATION_MARKS) | s.endswith(".svg") | s.endswith(".ico")
    return _any(s, TRACKER_MARKS) | (soft & ~F.coalesce(logo, F.lit(False)))


def preliminary_priority(asset_type: Column, alt: Column) -> Column:
    """E2. Priority before an image is fetched."""
    by_type = ladder(
        [(asset_type == "logo", 60.0), (asset_type == "certificate", 55.0), (asset_type == "product_image", 45.0),
         (asset_type == "banner", 30.0)],
        0.0,
    )
    return F.lit(10.0) + by_type + F.when(F.length(F.coalesce(alt, F.lit(""))) > 4, 15.0).otherwise(0.0)


def first_seen(images: DataFrame) -> DataFrame:
    """E3. First image per merchant and URL in ``img_ord`` order; empty URLs dropped.

    A map-side aggregate: copies of one URL never meet in a sort.
    """
    rest = [c for c in images.columns if c not in ("merchant_id", "src")]
    return (
        images.filter(F.coalesce(F.col("src"), F.lit("")) != "")
        .groupBy("merchant_id", "src")
        .agg(F.min_by(F.struct(*rest), "img_ord").alias("i"))
        .select("merchant_id", "src", "i.*")
        .select(images.columns)
    )


def useful_images(images: DataFrame) -> DataFrame:
    """E3 then E1: a URL counts as seen even where the image itself is dropped."""
    seen = first_seen(images)
    return seen.filter(~is_interface_image(F.col("src"), F.col("img_class"), F.col("is_logo_candidate")))


def download_candidates(images: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """E4. The ``limit`` images of each merchant worth fetching, ranked in ``fetch_no``.

    The rank limit is pushed into the map tasks, so even a merchant that owns a third
    of all images sends at most ``limit`` rows per task through the shuffle.
    """
    order = Window.partitionBy("merchant_id").orderBy(F.col("prelim").desc(), "img_ord")
    ranked = images.withColumn("prelim", preliminary_priority(F.col("asset_type"), F.col("alt")))
    return ranked.withColumn("fetch_no", F.row_number().over(order)).filter(F.col("fetch_no") <= limit)


def size_filter(images: DataFrame) -> DataFrame:
    """E5. Both sides at least 50 px; long strips only as banners."""
    w, h = F.col("width"), F.col("height")
    aspect = F.greatest(w / h, h / w)
    return images.filter((w >= 50) & (h >= 50) & ((aspect <= 6.0) | (F.col("asset_type") == "banner")))


def exact_copies(assets: DataFrame, content: str = "content") -> DataFrame:
    """E6. One row per distinct content hash with its first asset and number of copies."""
    return (
        assets.select("asset_id", F.sha2(F.col(content).cast("binary"), 256).alias("asset_hash"))
        .groupBy("asset_hash")
        .agg(F.min("asset_id").alias("first_asset"), F.count("*").alias("copies"))
    )


def download_gate(fetched: DataFrame) -> DataFrame:
    """A10. Safe http(s) URL, byte size in range, sides scaled down to the maximum."""
    ok = url_safety_reason(F.col("src")).isNull() & F.col("src").rlike("^https?://")
    sized = fetched.filter(ok & F.col("n_bytes").between(MIN_BYTES, MAX_BYTES))
    w, h = F.col("width"), F.col("height")
    big = F.greatest(w, h) > MAX_DIMENSION
    # the longer side becomes the maximum; of the two whole lengths around the exact
    # shorter side, the one that keeps the aspect ratio closer is taken
    side, aspect = F.lit(float(MAX_DIMENSION)), w / h

    def nearest(exact: Column, error) -> Column:
        low, high = F.floor(exact).cast("double"), F.ceil(exact).cast("double")
        best = F.when((low == 0.0) | (error(low) <= error(high)), low).otherwise(high)
        return F.greatest(best, F.lit(1.0)).cast("int")

    narrow = nearest(side * aspect, lambda n: F.abs(aspect - n / side))
    flat = nearest(side / aspect, lambda n: F.abs(aspect - F.try_divide(side, n)))
    return sized.withColumns(
        {
            "width": F.when(big & (w > h), MAX_DIMENSION).when(big, narrow).otherwise(w),
            "height": F.when(big & (w > h), flat).when(big, MAX_DIMENSION).otherwise(h),
        }
    )


def search_hints(images: DataFrame) -> DataFrame:
    """A9. Text to search for an image: alt, title or file name, plus the merchant name."""
    alt, title, name = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("alt", "title", "merchant_name"))
    file = F.element_at(F.split(url_path(F.col("src")), "/"), -1)
    stem = F.trim(F.regexp_replace(F.regexp_replace(file, r"(?i)\.(jpg|jpeg|png|webp|avif|gif)$", ""), "[-_]", " "))
    term = ladder(
        [
            ((F.length(alt) > 3) & ~F.lower(alt).rlike("image|photo|img"), alt),
            (F.length(title) > 3, title),
            (F.length(stem) > 3, stem),
        ],
        F.lit(None).cast("string"),
    )
    images = images.withColumn("hint_term", term)
    found = F.coalesce(F.col("hint_term"), F.lit(""))
    raw_name = F.coalesce(F.col("merchant_name"), F.lit(""))
    add = (raw_name != "") & ~F.contains(F.lower(found), F.lower(raw_name))
    hint = F.trim(F.concat_ws(" ", F.col("hint_term"), F.when(add, raw_name)))
    return images.withColumn(
        "search_hint", F.when(F.col("hint_term").isNull() & ~add, F.concat(raw_name, F.lit(" product photo"))).otherwise(hint)
    ).drop("hint_term")


# ---- perceptual clustering -----------------------------------------------------------

# Largest number of distinct hashes of one merchant that is clustered inside one task.
GROUP_LIMIT = 20_000

_LEADERS = "merchant_id long, dhash long, leader_ord long"


def _fold(hashes: np.ndarray, ords: np.ndarray, bits: int) -> np.ndarray:
    """First leader within ``bits`` of each hash, hashes given in order of appearance."""
    leaders = np.empty(len(hashes), dtype=np.uint64)
    leader_ords = np.empty(len(hashes), dtype=np.int64)
    out = np.empty(len(hashes), dtype=np.int64)
    n = 0
    for i, h in enumerate(hashes):
        near = np.flatnonzero(np.bitwise_count(leaders[:n] ^ h) <= bits)
        if len(near):
            out[i] = leader_ords[near[0]]
        else:
            leaders[n], leader_ords[n], out[i] = h, ords[i], ords[i]
            n += 1
    return out


def _cluster_group(table: pa.Table) -> pa.Table:
    table = table.sort_by("first_ord")
    hashes = table["dhash"].to_numpy().view(np.uint64)
    ords = table["first_ord"].to_numpy()
    leaders = _fold(hashes, ords, MAX_DUPLICATE_BITS)
    return pa.table({"merchant_id": table["merchant_id"], "dhash": table["dhash"], "leader_ord": pa.array(leaders)})


def _near_pairs(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """Pairs of hashes of one merchant at most ``bits`` apart (columns l_*, r_*).

    64 bits cut into ``bits + 2`` bands: hashes that differ in at most ``bits`` bits
    agree in two whole bands, so an equi-join on (merchant, band pair, both values)
    misses nothing, and about 21 bits of the key keep the buckets small.
    """
    def banded(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "merchant_id", F.col("dhash").alias(f"{prefix}_hash"), F.col("first_ord").alias(f"{prefix}_ord"),
            F.explode(F.array(*_bands(bits))).alias("b"),
        ).select("*", "b.band", "b.part").drop("b")

    joined = banded(left, "l").join(banded(right, "r"), ["merchant_id", "band", "part"])
    return joined.filter(hamming(F.col("l_hash"), F.col("r_hash")) <= bits)


# Rows of one block of a bucket; two blocks meet in a task.
BUCKET = 4096
_BLOCKED = "merchant_id long, dhash long"


def _any_earlier(hashes: np.ndarray, ords: np.ndarray, side: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have an earlier one within ``bits`` of them; of two blocks only across (sides 0 and 1; -1: one block).

    Everything is compared with the earliest hashes first, and what has found one drops out, so a bucket of nearly equal
    hashes costs little more than its length.
    """
    order = np.argsort(ords, kind="stable")
    h, s = hashes[order], side[order]
    found = np.zeros(len(h), bool)
    left = np.arange(1, len(h))
    for start in range(0, len(h), 256):
        left = left[left > start]
        if not len(left):
            break
        for part in np.array_split(left, max(1, len(left) // 2048)):
            near = np.bitwise_count(h[part, None] ^ h[None, start : start + 256]) <= bits
            near &= np.arange(start, min(start + 256, len(h)))[None, :] < part[:, None]
            near &= (s[part, None] != s[None, start : start + 256]) | (s[part, None] < 0)
            found[part] = near.any(axis=1)
        left = left[~found[left]]
    out = np.zeros(len(h), bool)
    out[order] = found
    return out


def _bands(bits: int) -> list[Column]:
    """Keys of a hash: the values of each two of ``bits + 2`` bands, of which near hashes share at least one."""
    n = bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    part = lambda i: F.shiftrightunsigned(F.shiftleft(F.col("dhash"), 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i])
    return [
        F.struct(F.lit(i * n + j).alias("band"), (F.shiftleft(part(i), 32).bitwiseOR(part(j))).alias("part"))
        for i in range(n)
        for j in range(i + 1, n)
    ]


def _blocked(undecided: DataFrame, bits: int) -> DataFrame:
    """(merchant_id, dhash) of the hashes with an earlier one of their merchant within ``bits``; no pair is listed.

    A bucket of many hashes is cut into blocks; each two blocks meet in one task, which holds 2 * BUCKET rows at most and
    emits each hash once.
    """
    keys = ["merchant_id", "band", "part"]
    banded = undecided.select("merchant_id", "dhash", "first_ord", F.explode(F.array(*_bands(bits))).alias("b")).select("merchant_id", "dhash", "first_ord", "b.*")
    shared = banded.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(float(BUCKET))).cast("long")
    cut = (
        banded.join(shared, keys)
        .withColumn("block", F.pmod(F.xxhash64("dhash"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select(*keys, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), F.when(F.col("other") == F.col("block"), -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"), "dhash", "first_ord")
    )
    group = [*keys, "p", "q"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            found = _any_earlier(table["dhash"].to_numpy().view(np.uint64), table["first_ord"].to_numpy(), table["side"].to_numpy(), bits)
            return pa.RecordBatch.from_arrays([table["merchant_id"].combine_chunks().filter(pa.array(found)), table["dhash"].combine_chunks().filter(pa.array(found))], ["merchant_id", "dhash"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch[c].to_numpy() for c in group], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if held and last != tuple(key[a]):
                    yield done(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(key[a])
        if held:
            yield done(pa.Table.from_batches(held))

    return cut.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, _BLOCKED).distinct()


def _cluster_rounds(distinct: DataFrame, bits: int) -> DataFrame:
    """Greedy leaders of groups too large for one task, by parallel rounds.

    The greedy leaders are those hashes with no earlier leader nearby. Each round
    promotes every undecided hash without an undecided earlier neighbour and retires
    the neighbours of the new leaders; the result is the sequential one. Leaders lie
    more than ``bits`` apart, so few of them share a bucket, and only they are met as
    pairs. Rounds are cut with reliable checkpoints so a lost executor repeats at most one round.
    """
    spark = distinct.sparkSession
    checkpoint_dir(spark)
    undecided = distinct.checkpoint()
    leaders: DataFrame | None = None
    while not undecided.isEmpty():
        fresh = undecided.join(_blocked(undecided, bits), ["merchant_id", "dhash"], "left_anti").checkpoint()
        retired = _near_pairs(undecided, fresh, bits).select("merchant_id", F.col("l_hash").alias("dhash")).distinct()
        undecided = undecided.join(retired, ["merchant_id", "dhash"], "left_anti").checkpoint()
        leaders = fresh if leaders is None else leaders.unionByName(fresh)
    if leaders is None:
        return spark.createDataFrame([], _LEADERS)
    return (
        _near_pairs(distinct, leaders, bits)
        .groupBy("merchant_id", F.col("l_hash").alias("dhash"))
        .agg(F.min("r_ord").alias("leader_ord"))
    )


def perceptual_clusters(assets: DataFrame, group_limit: int | None = GROUP_LIMIT, bits: int = MAX_DUPLICATE_BITS) -> DataFrame:
    """E9. Greedy clustering per merchant: join the first cluster whose leader is within
    ``bits`` bits, else start a new one. Needs merchant_id, asset_ord, dhash.

    Equal hashes always share a cluster, so copies collapse before anything else. A
    merchant with at most ``group_limit`` distinct hashes is folded inside one task;
    a larger one goes through parallel rounds with the same result. ``group_limit``
    None says that the input is already bounded per merchant (E4) and skips the check.
    """
    distinct = assets.groupBy("merchant_id", "dhash").agg(F.min("asset_ord").alias("first_ord"))
    sizes = distinct.groupBy("merchant_id").agg(F.count("*").alias("n"))
    large = None if group_limit is None else sizes.filter(F.col("n") > group_limit).select("merchant_id")
    if large is None or large.isEmpty():
        small_part, rounds = distinct, None
    else:
        small_part = distinct.join(large, "merchant_id", "left_anti")
        rounds = _cluster_rounds(distinct.join(large, "merchant_id", "left_semi"), bits)
    leaders = small_part.groupBy("merchant_id").applyInArrow(_cluster_group, _LEADERS)
    if rounds is not None:
        leaders = leaders.unionByName(rounds.select("merchant_id", "dhash", "leader_ord"))
    return assets.join(leaders, ["merchant_id", "dhash"]).withColumn(
        "is_leader", F.col("asset_ord") == F.col("leader_ord")
    )


# ---- selection -------------------------------------------------------------------------


def product_priority(width: Column, height: Column, alt: Column, merchant_name: Column) -> Column:
    """E11. Priority of a product image."""
    area, a, name = width.cast("long") * height, F.coalesce(alt, F.lit("")), F.coalesce(merchant_name, F.lit(""))
    aspect = width / height
    described = (a != "") & (F.length(F.trim(a)) > 3)
    return (
        F.when(area >= 90000, 35.0).when(area >= 40000, 20.0).otherwise(0.0)
        + F.when((height > 0) & (aspect >= 0.65) & (aspect <= 1.5), 25.0).otherwise(0.0)
        + F.when(described, 20.0).otherwise(0.0)
        + F.when(described & (name != "") & F.contains(F.lower(a), F.lower(name)), 10.0).otherwise(0.0)
    )


def select_representatives(leaders: DataFrame, limit: int = 8) -> DataFrame:
    """E12. One logo, two certificates, one banner, the rest products, ``limit`` in all.

    A second logo competes as a product. Input is at most thirty rows per merchant
    (E4), so the windows below see small groups only. Needs ``fetch_no`` order.
    """
    kind = F.coalesce(F.col("asset_type"), F.lit("product_image"))
    logo_like = (kind == "logo") | F.coalesce(F.col("is_logo_candidate"), F.lit(False))
    merchant = Window.partitionBy("merchant_id")
    first_logo = F.min(F.when(logo_like, F.col("fetch_no"))).over(merchant)
    roles = leaders.withColumn("first_logo", first_logo).withColumn(
        "role",
        ladder(
            [
                (F.col("fetch_no") == F.col("first_logo"), "logo"),
                (logo_like, "product_image"),
                (kind.isin("certificate", "banner"), kind),
            ],
            "product_image",
        ),
    )
    roles = roles.withColumn(
        "priority_score",
        F.when(
            F.col("role") == "product_image",
            product_priority(F.col("width"), F.col("height"), F.col("alt"), F.col("merchant_name")),
        ),
    )
    by_role = Window.partitionBy("merchant_id", "role").orderBy(F.col("priority_score").desc_nulls_last(), "fetch_no")
    numbered = roles.withColumn("role_no", F.row_number().over(by_role))
    quota = ladder(
        [(F.col("role") == "logo", 1), (F.col("role") == "certificate", 2), (F.col("role") == "banner", 1)], F.lit(None).cast("int")
    )
    fixed = F.sum(F.when(F.col("role_no") <= quota, 1).otherwise(0)).over(merchant)
    kept = numbered.withColumns({"fixed_slots": fixed, "quota": quota}).filter(
        F.col("role_no") <= F.coalesce("quota", F.lit(limit) - F.col("fixed_slots"))
    )
    rank = ladder([(F.col("role") == "logo", 0), (F.col("role") == "certificate", 1), (F.col("role") == "banner", 2)], 3)
    order = Window.partitionBy("merchant_id").orderBy(rank, "role_no")
    return kept.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= limit).drop(
        "first_logo", "fixed_slots", "quota", "role_no"
    )


def selection_counts(raw: DataFrame, downloaded: DataFrame, clustered: DataFrame, selected: DataFrame) -> DataFrame:
    """E10. Raw, filtered, deduplicated, cluster and selected counts per merchant."""
    per = lambda df, agg, name: df.groupBy("merchant_id").agg(agg.cast("int").alias(name))
    out = per(raw, F.count("*"), "raw_count")
    for df, agg, name in [
        (downloaded, F.count("*"), "downloaded_count"),
        (clustered, F.count_if("is_leader"), "clusters_count"),
        (selected, F.count("*"), "selected_count"),
    ]:
        out = out.join(per(df, agg, name), "merchant_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "merchant_id",
        "raw_count",
        (F.col("raw_count") - zero("downloaded_count")).alias("filtered_count"),
        (zero("downloaded_count") - zero("clusters_count")).alias("deduplicated_count"),
        zero("clusters_count").alias("clusters_count"),
        zero("selected_count").alias("selected_count"),
    )
