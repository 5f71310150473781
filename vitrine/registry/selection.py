"""Queries of the image filtering and selection family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import assets
from .core import query

_JUNK = """(regexp_matches(lower(src), '1x1|pixel|tracking|analytics|spacer|blank\\.gif|empty\\.png')
 OR (NOT is_logo_candidate AND (regexp_matches(lower(src), 'icon|arrow|chevron|star-rating|spinner|loader') OR regexp_matches(lower(img_class), 'icon|arrow|chevron|star-rating|spinner|loader') OR suffix(lower(src), '.svg') OR suffix(lower(src), '.ico'))))"""
_PRELIM = "10::DOUBLE + CASE asset_type WHEN 'logo' THEN 60 WHEN 'certificate' THEN 55 WHEN 'product_image' THEN 45 WHEN 'banner' THEN 30 ELSE 0 END + CASE WHEN length(alt) > 4 THEN 15 ELSE 0 END"
_SEEN = "seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, src ORDER BY img_ord) AS rn FROM v_image WHERE src <> '') WHERE rn = 1)"
_USEFUL = f"{_SEEN}, useful AS (SELECT * FROM seen WHERE NOT {_JUNK})"
_TOP = f"{_USEFUL}, topk AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY {_PRELIM} DESC, img_ord) AS fetch_no FROM useful QUALIFY fetch_no <= 30)"
_SIZED = f"{_TOP}, sized AS (SELECT * FROM topk WHERE width >= 50 AND height >= 50 AND (greatest(width::DOUBLE / height, height::DOUBLE / width) <= 6 OR asset_type = 'banner'))"


@query("interface_image_filter", "E1", f"SELECT img_ord, {_JUNK} AS is_interface FROM v_image")
def _(t):
    return t.view("v_image").select(
        "img_ord",
        assets.is_interface_image(F.col("src"), F.col("img_class"), F.col("is_logo_candidate")).alias("is_interface"),
    )


@query("preliminary_priority", "E2", f"SELECT img_ord, {_PRELIM} AS priority FROM v_image")
def _(t):
    return t.view("v_image").select(
        "img_ord", assets.preliminary_priority(F.col("asset_type"), F.col("alt")).alias("priority")
    )


@query("first_seen_images", "E3", f"WITH {_USEFUL} SELECT merchant_id, src, img_ord, alt, asset_type FROM useful")
def _(t):
    return assets.useful_images(t.view("v_image")).select("merchant_id", "src", "img_ord", "alt", "asset_type")


@query("download_candidates", "E4", f"WITH {_TOP} SELECT merchant_id, img_ord, {_PRELIM} AS prelim, CAST(fetch_no AS INT) AS fetch_no FROM topk")
def _(t):
    return assets.download_candidates(assets.useful_images(t.view("v_image"))).select(
        "merchant_id", "img_ord", "prelim", "fetch_no"
    )


@query("image_size_filter", "E5", "SELECT img_ord, width, height FROM v_image WHERE width >= 50 AND height >= 50 AND (greatest(width::DOUBLE / height, height::DOUBLE / width) <= 6 OR asset_type = 'banner')")
def _(t):
    return assets.size_filter(t.view("v_image")).select("img_ord", "width", "height")


@query("exact_copies", "E6", "SELECT sha256(text) AS asset_hash, min(doc_id) AS first_asset, count(*) AS copies FROM v_doc GROUP BY 1")
def _(t):
    docs = t.view("v_doc").select(F.col("doc_id").alias("asset_id"), F.col("text").alias("content"))
    return assets.exact_copies(docs)


_GRID = "transform(sequence(0, 71), i -> (p_partkey * (i + 3) * 7 + i * i * 13 + p_size * i) % 256)"
_DGRID = "list_transform(range(0, 72), lambda i: (p_partkey * (i + 3) * 7 + i * i * 13 + p_size * i) % 256)"
_BITS = lambda cmp: f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN g[(i // 8) * 9 + i % 8 + 1] {cmp} g[(i // 8) * 9 + i % 8 + 2] THEN CAST(1 AS HUGEINT) << (63 - i) ELSE CAST(0 AS HUGEINT) END))"
_SIGNED = lambda c: f"CAST(CASE WHEN {c} >= 9223372036854775808 THEN {c} - 18446744073709551616 ELSE {c} END AS BIGINT)"


@query("difference_hashes", "E7", f"WITH a AS (SELECT p_partkey, {_DGRID} AS g FROM part), b AS (SELECT p_partkey, CAST({_BITS('>')} AS HUGEINT) AS c, CAST({_BITS('<')} AS HUGEINT) AS e FROM a) SELECT p_partkey, {_SIGNED('c')} AS crawl_hash, {_SIGNED('e')} AS eval_hash FROM b")
def _(t):
    grids = t.table("part").withColumn("grid", F.expr(_GRID))
    return grids.select(
        "p_partkey", hashing.difference_hash(F.col("grid")).alias("crawl_hash"),
        hashing.difference_hash(F.col("grid"), brighter_left=False).alias("eval_hash"),
    )


@query("hash_distances", "E8", """WITH f AS (SELECT merchant_id, arg_min(dhash, asset_ord) AS first_hash FROM v_hash GROUP BY 1)
SELECT asset_ord, CAST(bit_count(xor(dhash, first_hash)) AS INT) AS distance, 1::DOUBLE - bit_count(xor(dhash, first_hash)) / 64::DOUBLE AS similarity FROM v_hash JOIN f USING (merchant_id)""")
def _(t):
    hashes = t.view("v_hash")
    first = hashes.groupBy("merchant_id").agg(F.min_by("dhash", "asset_ord").alias("first_hash"))
    a, b = F.col("dhash"), F.col("first_hash")
    return hashes.join(first, "merchant_id").select(
        "asset_ord", hashing.hamming(a, b).alias("distance"), hashing.hash_similarity(a, b).alias("similarity")
    )


_CLUSTER = """dist AS (SELECT merchant_id, dhash, min(asset_ord) AS o FROM {source} GROUP BY 1, 2), ordered AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY o) AS i FROM dist),
walk AS (SELECT merchant_id, CAST(1 AS BIGINT) AS i, dhash, o, o AS leader, [struct_pack(h := dhash, o := o)] AS reps FROM ordered WHERE i = 1
 UNION ALL SELECT q.merchant_id, q.i, q.dhash, q.o, coalesce(list_filter(w.reps, lambda r: bit_count(xor(r.h, q.dhash)) <= 4)[1].o, q.o),
  CASE WHEN len(list_filter(w.reps, lambda r: bit_count(xor(r.h, q.dhash)) <= 4)) = 0 THEN list_append(w.reps, struct_pack(h := q.dhash, o := q.o)) ELSE w.reps END
  FROM walk w JOIN ordered q ON q.merchant_id = w.merchant_id AND q.i = w.i + 1)"""


@query("perceptual_clusters", "E9", f"WITH RECURSIVE {_CLUSTER.replace("{source}", "v_hash")} SELECT v.merchant_id, asset_ord, leader AS leader_ord, asset_ord = leader AS is_leader FROM v_hash v JOIN walk USING (merchant_id, dhash)")
def _(t):
    return assets.perceptual_clusters(t.view("v_hash")).select("merchant_id", "asset_ord", "leader_ord", "is_leader")


_NAMED = "leaders AS (SELECT s.*, 'ring' AS merchant_name FROM sized s)"
_PRIORITY = """CASE WHEN width * height >= 90000 THEN 35 WHEN width * height >= 40000 THEN 20 ELSE 0 END + CASE WHEN height > 0 AND width::DOUBLE / height BETWEEN 0.65 AND 1.5 THEN 25 ELSE 0 END
 + CASE WHEN alt <> '' AND length(trim(alt)) > 3 THEN 20 + CASE WHEN contains(lower(alt), 'ring') THEN 10 ELSE 0 END ELSE 0 END"""


@query("product_priority", "E11", f"SELECT img_ord, CAST({_PRIORITY} AS DOUBLE) AS priority FROM v_image")
def _(t):
    return t.view("v_image").select(
        "img_ord",
        assets.product_priority(F.col("width"), F.col("height"), F.col("alt"), F.lit("Ring")).alias("priority"),
    )


def _selection(n: int) -> str:
    return f"""{_SIZED}, r0 AS (SELECT *, asset_type = 'logo' OR is_logo_candidate AS ll FROM sized), r1 AS (SELECT *, min(CASE WHEN ll THEN fetch_no END) OVER (PARTITION BY merchant_id) AS fl FROM r0),
r2 AS (SELECT *, CASE WHEN fetch_no = fl THEN 'logo' WHEN ll THEN 'product_image' WHEN asset_type IN ('certificate', 'banner') THEN asset_type ELSE 'product_image' END AS role, {_PRIORITY} AS pr FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY merchant_id, role ORDER BY CASE WHEN role = 'product_image' THEN -pr ELSE 0 END, fetch_no) AS no FROM r2),
r4 AS (SELECT *, count(*) FILTER ((role = 'logo' AND no <= 1) OR (role = 'certificate' AND no <= 2) OR (role = 'banner' AND no <= 1)) OVER (PARTITION BY merchant_id) AS fixed FROM r3),
picked AS (SELECT * FROM r4 WHERE no <= CASE role WHEN 'logo' THEN 1 WHEN 'certificate' THEN 2 WHEN 'banner' THEN 1 ELSE {n} - fixed END)"""


def downloaded(t):
    ranked = assets.download_candidates(assets.useful_images(t.view("v_image")))
    return assets.size_filter(ranked).withColumn("merchant_name", F.lit("ring"))


@query("representative_selection", "E12", f"""WITH {_selection(8)} SELECT merchant_id, img_ord, role, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY CASE role WHEN 'logo' THEN 0 WHEN 'certificate' THEN 1 WHEN 'banner' THEN 2 ELSE 3 END, no) AS INT) AS slot FROM picked""")
def _(t):
    return assets.select_representatives(downloaded(t)).select("merchant_id", "img_ord", "role", "slot")


@query("selection_counts", "E10", f"""WITH RECURSIVE {_selection(5)}, hashed AS (SELECT s.merchant_id, h.dhash, s.fetch_no AS asset_ord FROM sized s JOIN v_hash h ON h.asset_ord = s.img_ord), {_CLUSTER.replace("{source}", "hashed")},
c AS (SELECT merchant_id, count(DISTINCT leader) AS clusters FROM walk GROUP BY 1),
a AS (SELECT merchant_id, count(*) AS raw FROM v_image GROUP BY 1), d AS (SELECT merchant_id, count(*) AS dl FROM sized GROUP BY 1), e AS (SELECT merchant_id, count(*) AS sel FROM picked GROUP BY 1)
SELECT a.merchant_id, CAST(raw AS INT) AS raw_count, CAST(raw - coalesce(dl, 0) AS INT) AS filtered_count, CAST(coalesce(dl, 0) - coalesce(clusters, 0) AS INT) AS deduplicated_count, CAST(coalesce(clusters, 0) AS INT) AS clusters_count, CAST(coalesce(sel, 0) AS INT) AS selected_count FROM a LEFT JOIN d USING (merchant_id) LEFT JOIN e USING (merchant_id) LEFT JOIN c USING (merchant_id)""")
def _(t):
    down = downloaded(t)
    hashed = down.join(t.view("v_hash").select(F.col("asset_ord").alias("img_ord"), "dhash"), "img_ord")
    clustered = assets.perceptual_clusters(hashed.withColumn("asset_ord", F.col("fetch_no").cast("long")))
    picked = assets.select_representatives(down, limit=5)
    return assets.selection_counts(t.view("v_image"), down, clustered, picked)


@query("download_gate", "A10", """WITH g AS (SELECT img_ord, src, width * 9 AS w, height * 8 AS h, n_bytes FROM v_image WHERE n_bytes BETWEEN 150 AND 10485760),
f AS (SELECT *, 4096::DOUBLE * (w::DOUBLE / h) AS nx, 4096::DOUBLE / (w::DOUBLE / h) AS ny, w::DOUBLE / h AS a FROM g)
SELECT img_ord, CAST(CASE WHEN greatest(w, h) <= 4096 THEN w WHEN w > h THEN 4096 ELSE greatest(1, CASE WHEN abs(a - floor(nx) / 4096) <= abs(a - ceil(nx) / 4096) THEN floor(nx) ELSE ceil(nx) END) END AS INT) AS width,
 CAST(CASE WHEN greatest(w, h) <= 4096 THEN h WHEN w <= h THEN 4096 ELSE greatest(1, CASE WHEN floor(ny) = 0 OR abs(a - 4096 / floor(ny)) <= abs(a - 4096 / ceil(ny)) THEN floor(ny) ELSE ceil(ny) END) END AS INT) AS height FROM f""")
def _(t):
    big = t.view("v_image").withColumns({"width": F.col("width") * 9, "height": F.col("height") * 8})
    return assets.download_gate(big).select("img_ord", "width", "height")


_HINT_NAME = "CASE WHEN merchant_id % 3 = 0 THEN 'ring' WHEN merchant_id % 3 = 1 THEN '' ELSE 'Acme' END"


@query("search_hints", "A9", f"""WITH a AS (SELECT *, {_HINT_NAME} AS nm, trim(replace(replace(regexp_replace(regexp_extract(src, '([^/]*)$', 1), '\\.(jpg|jpeg|png|webp|avif|gif)$', '', 'i'), '-', ' '), '_', ' ')) AS stem FROM v_image),
b AS (SELECT *, CASE WHEN length(trim(alt)) > 3 AND NOT regexp_matches(lower(alt), 'image|photo|img') THEN trim(alt) WHEN length(trim(title)) > 3 THEN trim(title) WHEN length(stem) > 3 THEN stem END AS term FROM a)
SELECT img_ord, CASE WHEN nm <> '' AND NOT contains(lower(coalesce(term, '')), lower(nm)) THEN trim(concat_ws(' ', term, nm)) WHEN term IS NULL THEN nm || ' product photo' ELSE term END AS search_hint FROM b""")
def _(t):
    named = t.view("v_image").withColumn("merchant_name", F.expr(_HINT_NAME))
    return assets.search_hints(named).select("img_ord", "search_hint")
