"""Queries of the vector, candidate and logo families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains, vectors
from ..functions.rounding import exact_round
from ..operators import candidates, logos, similarity
from ..session import written
from .core import _bind_tables, query, sql_pct, sql_round, sql_whole
from .urls import _CLEAN, _sql_list

_COS = lambda a, b: f"greatest(0::DOUBLE, least(1::DOUBLE, list_cosine_similarity({a}, {b})))"


@query("cosine_similarity", "F1", f"""SELECT a.asset_id, round(CASE WHEN a.asset_id % 3 = 0 THEN {_COS('a.embedding[1:48]', 'b.embedding[1:48]')} ELSE {_COS('a.embedding', 'b.embedding')} END, 6) AS similarity
FROM v_asset a JOIN v_asset b ON b.asset_id = a.asset_id + 2000000""")
def _(t):
    a = t.view("v_asset")
    b = a.select((F.col("asset_id") - 2000000).alias("asset_id"), F.col("embedding").alias("other"))
    other = F.when(F.col("asset_id") % 3 == 0, F.slice("other", 1, 48)).otherwise(F.col("other"))
    return a.join(b, "asset_id").select(
        "asset_id", F.round(vectors.cosine(F.col("embedding"), other), 6).alias("similarity")
    )


@query("unit_vectors", "F2", """WITH a AS (SELECT asset_id, list_transform(embedding, lambda x: x * (asset_id % 5)) AS v FROM v_asset), b AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM a)
SELECT asset_id, CAST(i AS INT) AS pos, round(CASE WHEN n > 0 THEN v[i + 1] / n ELSE v[i + 1] END, 6) + 0.0 AS value FROM (SELECT *, unnest(range(len(v))) AS i FROM b)""")
def _(t):
    scaled = F.transform("embedding", lambda x: x * (F.col("asset_id") % 5))
    unit = t.view("v_asset").select("asset_id", F.posexplode(vectors.l2_normalise(scaled)).alias("pos", "x"))
    return unit.select("asset_id", "pos", (F.round("x", 6) + F.lit(0.0)).alias("value"))


_PIXELS = """SELECT l_suppkey AS asset_id, CAST((l_partkey * 7) % 256 AS INT) AS r, CAST((l_orderkey * 11) % 256 AS INT) AS g, CAST((l_linenumber * 36 + l_suppkey) % 256 AS INT) AS b FROM lineitem"""


@query("colour_histograms", "F3", f"""WITH p AS ({_PIXELS}), c AS (SELECT asset_id, CAST(least(7, floor(r / 255::DOUBLE * 8)) * 64 + least(7, floor(g / 255::DOUBLE * 8)) * 8 + least(7, floor(b / 255::DOUBLE * 8)) AS INT) AS bin, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2),
s AS (SELECT asset_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1) SELECT c.asset_id, bin, round(n / (norm + 1e-9), 6) AS value FROM c JOIN s USING (asset_id)""")
def _(t):
    hist = vectors.colour_histograms(t.spark.sql(_bind_tables(_PIXELS, t.directory)))
    return hist.select("asset_id", F.posexplode("embedding").alias("bin", "v")).filter("v > 0").select(
        "asset_id", "bin", F.round("v", 6).alias("value")
    )


_DISTINCT = "d AS (SELECT min(CAST(asset_id AS VARCHAR)) AS rid, count(*) AS n, embedding FROM v_asset GROUP BY embedding)"
_PAIRS = f"""{_DISTINCT}, pr AS (SELECT a.rid AS left_id, b.rid AS right_id, {_COS('a.embedding', 'b.embedding')} AS s, a.n AS left_copies, b.n AS right_copies FROM d a JOIN d b ON a.rid < b.rid),
pairs AS (SELECT left_id, right_id, {sql_round('s', 4)} AS similarity, left_copies, right_copies FROM pr WHERE s >= 0.70 UNION ALL SELECT rid, rid, 1::DOUBLE, n, n FROM d WHERE n > 1)"""


@query("similar_pairs", "F4", f"WITH {_PAIRS} SELECT * FROM pairs")
def _(t):
    return similarity.similar_pairs(t.view("v_asset"), 0.70)


@query("approximate_pairs", "F5")
def _(t):
    return similarity.approximate_pairs(t.view("v_asset"), 0.70)


# share of the pairs of F4 that F5 reports at least; by its bands a pair at 0.70 is found with a chance of 0.99
RECALL_FLOOR = 0.95


@query("approximate_pairs_recall", "F5", f"WITH {_PAIRS} SELECT count(*) AS exact_pairs, 0::BIGINT AS wrong_pairs, true AS recall_reached FROM pairs")
def _(t):
    # one after the other: in one plan, the vectors that both joins shuffle lie on the disks at once
    exact = written(t.spark, lambda: similarity.similar_pairs(t.view("v_asset"), 0.70).select("left_id", "right_id", F.lit(1).alias("exact")))
    found = written(t.spark, lambda: similarity.approximate_pairs(t.view("v_asset"), 0.70).select("left_id", "right_id", F.lit(1).alias("found")))
    n = exact.join(found, ["left_id", "right_id"], "full").agg(
        F.count("exact").alias("exact_pairs"), F.count_if(F.col("exact").isNull()).alias("wrong_pairs"), F.count_if(F.col("exact") == F.col("found")).alias("both")
    )
    return n.select("exact_pairs", "wrong_pairs", (F.col("both") >= RECALL_FLOOR * F.col("exact_pairs")).alias("recall_reached"))


# catalogue: the base vectors; images: the copies and blends
_REF = f"""cat AS (SELECT 'ref_' || CAST(asset_id AS VARCHAR) || '.jpg' AS filename, embedding FROM v_asset WHERE batch_no = 0), img AS (SELECT asset_id, merchant_id, embedding FROM v_asset WHERE batch_no > 0),
cs AS (SELECT asset_id, merchant_id, filename, {_COS('img.embedding', 'cat.embedding')} AS s FROM img CROSS JOIN cat), cr AS (SELECT asset_id, merchant_id, filename, {sql_round('s', 4)} AS similarity FROM cs),
top5 AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY similarity DESC, filename) AS match_no FROM cr QUALIFY match_no <= 5)"""


def _images(t):
    return t.view("v_asset").filter("batch_no > 0").select("asset_id", "merchant_id", "embedding")


def _catalogue(t):
    return t.view("v_asset").filter("batch_no = 0").select(
        F.concat(F.lit("ref_"), F.col("asset_id").cast("string"), F.lit(".jpg")).alias("filename"), "embedding"
    )


@query("catalogue_matches", "F6", f"WITH {_REF} SELECT asset_id, filename, similarity, CAST(match_no AS INT) AS match_no FROM top5")
def _(t):
    return similarity.catalogue_matches(_images(t), _catalogue(t))


def _reuse(t):
    images = _images(t)
    return similarity.catalogue_reuse(images, similarity.catalogue_matches(images, _catalogue(t)))


@query("catalogue_reuse", "F6", f"""WITH {_REF} SELECT asset_id, merchant_id, filename, similarity, CASE WHEN similarity >= 0.85 THEN 'HIGH' WHEN similarity >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS reuse_level,
 CASE WHEN similarity >= 0.85 THEN format('Potential visual reuse detected ({{}}% similarity). Merchant product visual strongly matches catalog reference: {{}}.', {sql_pct('similarity')}, filename) WHEN similarity >= 0.70 THEN format('Moderate visual similarity detected ({{}}%). Product exhibits strong visual commonalities with reference: {{}}.', {sql_pct('similarity')}, filename)
 ELSE format('No significant visual reuse detected. Closest catalog match is {{}}% ({{}}).', {sql_pct('similarity')}, filename) END AS explanation FROM top5 WHERE match_no = 1""")
def _(t):
    return _reuse(t)


_F7 = """b7 AS (SELECT asset_id, merchant_id, similarity, CASE asset_id % 2 WHEN 0 THEN merchant_id ELSE merchant_id * 1000 + CAST(floor(similarity * 10) AS BIGINT) END AS grp FROM top5 WHERE match_no = 1),
g7 AS (SELECT grp AS merchant_id, max(similarity) AS mx, CAST(sum(CAST(round(similarity * 10000) AS BIGINT)) AS DOUBLE) / (count(*) * 10000::DOUBLE) AS av, count(*) FILTER (similarity >= 0.85) AS st, count(*) FILTER (similarity >= 0.70) AS md, count(*) AS n, list_sort(list(similarity), 'DESC')[1:3] AS t3 FROM b7 GROUP BY 1),
h7 AS (SELECT *, CAST(list_sum(list_transform(t3, lambda x: CAST(round(x * 10000) AS BIGINT))) AS DOUBLE) / (len(t3) * 10000::DOUBLE) AS tk FROM g7),
i7 AS (SELECT *, CASE WHEN st >= 2 AND tk >= 0.87 THEN least(100::DOUBLE, 75::DOUBLE + (tk - 0.87::DOUBLE) / 0.13::DOUBLE * 25::DOUBLE) WHEN st >= 2 THEN least(72::DOUBLE, 60::DOUBLE + (tk - 0.85::DOUBLE) / 0.02::DOUBLE * 12::DOUBLE)
 WHEN st = 1 THEN least(64::DOUBLE, 40::DOUBLE + (mx - 0.85::DOUBLE) / 0.15::DOUBLE * 24::DOUBLE) WHEN md >= 2 THEN least(50::DOUBLE, 30::DOUBLE + (tk - 0.70::DOUBLE) / 0.15::DOUBLE * 20::DOUBLE)
 WHEN md = 1 THEN least(35::DOUBLE, 20::DOUBLE + (mx - 0.70::DOUBLE) / 0.15::DOUBLE * 15::DOUBLE) ELSE CASE WHEN mx > 0 THEN mx / 0.70::DOUBLE * 20::DOUBLE ELSE 0 END END AS sc,
 CASE WHEN st >= 2 AND tk >= 0.87 THEN 'HIGH' WHEN st >= 1 OR md >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM h7)"""


def batch(t):
    grouped = _reuse(t).withColumn(
        "merchant_id",
        F.expr("CASE asset_id % 2 WHEN 0 THEN merchant_id ELSE merchant_id * 1000 + CAST(floor(similarity * 10) AS BIGINT) END"),
    )
    return similarity.batch_reuse(grouped)


@query("batch_reuse", "F7", f"""WITH {_REF}, {_F7} SELECT merchant_id, mx AS max_similarity, {sql_round('av', 6)} AS average_similarity, {sql_round('tk', 6)} AS top_k_similarity, st AS strong_match_count, md AS moderate_match_count, n AS image_count, {sql_round('sc', 1)} AS reuse_risk_score, risk_level, st >= 2 AND tk >= 0.87 AS high_eligible FROM i7""")
def _(t):
    return batch(t).select(
        "merchant_id", "max_similarity", exact_round(F.col("average_similarity"), 6).alias("average_similarity"),
        exact_round(F.col("top_k_similarity"), 6).alias("top_k_similarity"), "strong_match_count", "moderate_match_count", "image_count",
        "reuse_risk_score", "risk_level", "high_eligible",
    )


@query("identity_coherence", "F8", f"""WITH x AS (SELECT asset_id, CASE WHEN asset_id % 7 = 0 THEN asset_id + 10000000 ELSE merchant_id END AS merchant_id, embedding FROM v_asset),
p AS (SELECT a.merchant_id, avg({_COS('a.embedding', 'b.embedding')}) AS m FROM x a JOIN x b ON a.merchant_id = b.merchant_id AND a.asset_id < b.asset_id GROUP BY 1), n AS (SELECT merchant_id, count(*) AS n_images FROM x GROUP BY 1),
s AS (SELECT n.merchant_id, n_images, m, greatest(0::DOUBLE, least(100::DOUBLE, CASE WHEN m IS NULL THEN 70::DOUBLE WHEN m >= 0.50 THEN 75::DOUBLE + (m - 0.50::DOUBLE) / 0.50::DOUBLE * 25::DOUBLE WHEN m >= 0.25 THEN 50::DOUBLE + (m - 0.25::DOUBLE) / 0.25::DOUBLE * 25::DOUBLE ELSE greatest(20::DOUBLE, m / 0.25::DOUBLE * 50::DOUBLE) END)) AS c FROM n LEFT JOIN p USING (merchant_id))
SELECT merchant_id, n_images, round(m, 6) AS mean_similarity, {sql_round('c', 1)} AS coherence_score FROM s""")
def _(t):
    assets = t.view("v_asset").withColumn(
        "merchant_id", F.when(F.col("asset_id") % 7 == 0, F.col("asset_id") + 10000000).otherwise(F.col("merchant_id"))
    )
    return similarity.identity_coherence(assets).select(
        "merchant_id", "n_images", F.round("mean_similarity", 6).alias("mean_similarity"), "coherence_score"
    )


_INDEX = f"""a9 AS (SELECT asset_hash, merchant_id, replace(lower(domain), 'www.', '') AS dom, embedding FROM v_asset),
c9 AS (SELECT q.asset_hash, x.asset_hash AS match_hash, x.merchant_id AS mm, {_COS('q.embedding', 'x.embedding')} AS s FROM a9 q JOIN a9 x ON q.asset_hash <> x.asset_hash AND q.merchant_id <> x.merchant_id AND NOT (x.dom = q.dom OR suffix(x.dom, '.' || q.dom))),
r9 AS (SELECT asset_hash, match_hash, mm, s, {sql_round('s', 4)} AS similarity FROM c9 WHERE s >= 0.82), m9 AS (SELECT *, row_number() OVER (PARTITION BY asset_hash ORDER BY similarity DESC, match_hash) AS match_no FROM r9 QUALIFY match_no <= 5)"""


def index_results(t):
    assets = t.view("v_asset").select("asset_hash", "merchant_id", "domain", "embedding")
    return assets, similarity.index_matches(assets, assets)


@query("cross_merchant_matches", "F9", f"""WITH {_INDEX} SELECT asset_hash, CAST(match_no AS INT) AS match_no, match_hash, 'mch_***' || right(CAST(mm AS VARCHAR), 2) AS masked_merchant, similarity, s >= 0.92 AS is_strong FROM m9""")
def _(t):
    return index_results(t)[1].select("asset_hash", "match_no", "match_hash", "masked_merchant", "similarity", "is_strong")


@query("cross_merchant_verdicts", "F9", f"""WITH {_INDEX}, g AS (SELECT asset_hash, max(similarity) AS top, string_agg('mch_***' || right(CAST(mm AS VARCHAR), 2), ',' ORDER BY match_no) AS masked FROM m9 GROUP BY 1)
SELECT a.asset_hash, coalesce(top, 0) AS local_similarity, CASE WHEN top >= 0.92 THEN 'near_duplicate_match' WHEN top >= 0.82 THEN 'similar_image' ELSE 'none' END AS local_result, coalesce(masked, '') AS masked_ids FROM a9 a LEFT JOIN g USING (asset_hash)""")
def _(t):
    assets, matches = index_results(t)
    return similarity.index_verdicts(assets, matches).select(
        "asset_hash", "local_similarity", "local_result", F.array_join("masked_ids", ",").alias("masked_ids")
    )


# ---- candidates ---------------------------------------------------------------------

_VERIFIED = f"""c0 AS (SELECT *, {_COS('asset_embedding', 'embedding')} AS raw, {_CLEAN('source_domain')} AS cd FROM v_candidate),
c1 AS (SELECT *, contains(source_domain, merchant_domain) OR contains(merchant_domain, source_domain) OR contains(split_part(source_domain, '.', 1), split_part(merchant_domain, '.', 1)) AS own,
 {_sql_list('cd', domains.SUPPLIERS)} OR regexp_matches(cd, 'supplier|wholesale|distributor') AS sup, {_sql_list('cd', domains.SOFT_TRUST + domains.IMAGE_AGGREGATORS)} AS lst, {sql_round('raw', 4)} AS similarity, {sql_pct('raw')} AS pct FROM c0),
c2 AS (SELECT *, sup OR lst AS soft, NOT (sup OR lst) AND similarity >= 0.55 AS meaningful FROM c1),
verified AS (SELECT *, CASE WHEN own OR sup THEN 'LOW' WHEN soft THEN CASE WHEN raw < 0.85 THEN 'LOW' ELSE 'MEDIUM' END WHEN raw >= 0.85 THEN 'HIGH' WHEN raw >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE WHEN own OR soft THEN 'LOW' WHEN raw >= 0.85 THEN 'HIGH' WHEN raw >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS strength, CASE WHEN own THEN 'OWN_DOMAIN' WHEN sup THEN 'SUPPLIER_CATALOG' WHEN soft THEN 'SOFT_TRUST' ELSE 'ONLINE' END AS stype,
 CASE WHEN own THEN 'Own Domain / Brand Verified' WHEN sup THEN 'Supplier / Manufacturer Catalog Asset' WHEN soft THEN 'Image Aggregator / Marketplace Match' WHEN raw >= 0.85 THEN 'Potential External Match' WHEN raw >= 0.70 THEN 'Potential Source Match' WHEN raw >= 0.55 THEN 'Weak Visual Match' ELSE 'No Significant Match' END AS label,
 CASE WHEN own THEN format('Verified merchant''s own domain asset on {{}} ({{}}% match).', source_domain, pct) WHEN sup THEN format('Product imagery matches supplier catalog on {{}} ({{}}% match). Common for resellers and distributors — does not indicate visual fraud.', source_domain, pct)
  WHEN soft THEN format('Visual match on {{}} ({{}}% similarity). This source (marketplace/aggregator/stock) commonly hosts legitimate product imagery — insufficient alone to indicate reuse fraud.', source_domain, pct)
  WHEN raw >= 0.85 THEN format('Strong visual similarity ({{}}%) detected against {{}}. Requires corroboration from additional independent signals.', pct, source_domain) WHEN raw >= 0.70 THEN format('Moderate visual similarity ({{}}%) against {{}}.', pct, source_domain)
  WHEN raw >= 0.55 THEN format('Weak visual similarity ({{}}%) — below threshold for meaningful evidence.', pct) ELSE format('Low visual similarity ({{}}%). Candidate does not match merchant image.', pct) END AS expl FROM c2)"""


def verified(t):
    return candidates.verify_candidates(t.view("v_candidate"))


@query("verified_candidates", "F10", f"WITH {_VERIFIED} SELECT asset_id, candidate_id, similarity, pct AS similarity_pct, severity, strength AS evidence_strength, stype AS source_type, label AS match_label, expl AS explanation FROM verified")
def _(t):
    return verified(t).select(
        "asset_id", "candidate_id", "similarity", "similarity_pct", "severity", "evidence_strength", "source_type",
        "match_label", "explanation",
    )


@query("ranked_candidates", "F11", f"WITH {_VERIFIED} SELECT asset_id, candidate_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY own, meaningful DESC, similarity DESC, k) AS INT) AS rank FROM verified")
def _(t):
    return candidates.rank_candidates(verified(t)).select("asset_id", "candidate_id", "rank")


_STATUS = f"""{_VERIFIED}, rk AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY own, meaningful DESC, similarity DESC, k) AS rn FROM verified),
agg AS (SELECT asset_id, count(*) FILTER (NOT own AND meaningful) AS nm, count(*) FILTER (NOT own AND meaningful AND similarity >= 0.85) AS st, count(*) FILTER (NOT own AND meaningful AND similarity >= 0.70) AS md,
 coalesce(max(similarity) FILTER (NOT own AND meaningful), 0) AS mm, arg_min(similarity, rn) FILTER (NOT own) AS me, arg_min(similarity, rn) AS ma, arg_min(candidate_id, rn) AS any_id, arg_min(candidate_id, rn) FILTER (NOT own) AS ext_id, arg_min(candidate_id, rn) FILTER (NOT own AND meaningful) AS mean_id FROM rk GROUP BY 1),
sx AS (SELECT *, coalesce(me, ma) AS best FROM agg),
sy AS (SELECT *, CASE WHEN best < 0.55 THEN 0 WHEN best < 0.70 THEN 1 WHEN st >= 2 OR (st >= 1 AND md >= 2) THEN 2 WHEN nm = 0 THEN 3 WHEN st = 1 THEN 4 ELSE 5 END AS cs FROM sx),
sz AS (SELECT *, CASE cs WHEN 0 THEN any_id WHEN 1 THEN ext_id WHEN 3 THEN ext_id ELSE mean_id END AS top_id, CASE cs WHEN 0 THEN 0::DOUBLE WHEN 1 THEN least(20::DOUBLE, best * 30::DOUBLE) WHEN 3 THEN least(20::DOUBLE, best * 20::DOUBLE)
  WHEN 2 THEN least(80::DOUBLE, 50::DOUBLE + (mm - 0.85::DOUBLE) / (1::DOUBLE - 0.85::DOUBLE) * 20::DOUBLE + least(10::DOUBLE, (st - 1) * 5::DOUBLE)) ELSE least(35::DOUBLE, 20::DOUBLE + (mm - 0.70::DOUBLE) / (1::DOUBLE - 0.70::DOUBLE) * 15::DOUBLE) END AS e4 FROM sy),
statuses AS (SELECT z.asset_id, cs, CASE cs WHEN 0 THEN 'NO_EXTERNAL_MATCH' WHEN 1 THEN 'WEAK_MATCH' WHEN 2 THEN 'CORROBORATED_EXTERNAL_MATCH' ELSE 'INSUFFICIENT_EVIDENCE' END AS match_status, cs <= 1 AS is_own_brand, CAST(st AS INT) AS strong_match_count, CAST(md AS INT) AS moderate_match_count,
  CASE WHEN cs <= 1 THEN 0 ELSE mm END AS max_similarity, {sql_round('e4', 1)} AS e4_score, top_id AS top_candidate_id, v.stype AS top_source_type, CASE cs WHEN 3 THEN 'LOW' WHEN 4 THEN 'MEDIUM' ELSE v.strength END AS evidence_strength,
  CASE cs WHEN 3 THEN format('High visual similarity ({{}}%) detected on soft-trust source ({{}}). This source type commonly hosts legitimate product imagery — insufficient evidence alone to conclude malicious reuse.', v.pct, v.source_domain)
   WHEN 4 THEN format('Single strong match ({{}}%) on {{}}. Insufficient corroborating evidence to conclude meaningful reuse.', v.pct, v.source_domain) WHEN 5 THEN format('Moderate similarity ({{}}%) on {{}}. Evidence present but not corroborated enough to establish reuse.', v.pct, v.source_domain) ELSE v.expl END AS match_explanation
  FROM sz z JOIN verified v ON v.asset_id = z.asset_id AND v.candidate_id = z.top_id)"""


def statuses(t):
    assets = t.view("v_candidate").select("asset_id").distinct()
    return candidates.match_status(assets, verified(t))


@query("match_statuses", "F12", f"WITH {_STATUS} SELECT asset_id, match_status, is_own_brand, strong_match_count, moderate_match_count, max_similarity, top_candidate_id, top_source_type, evidence_strength, match_explanation FROM statuses")
def _(t):
    return statuses(t).drop("e4_score", "top_similarity", "top_source_domain", "top_source_url", "top_filename")


@query("external_evidence_scores", "F13", f"WITH {_STATUS} SELECT asset_id, match_status, e4_score FROM statuses")
def _(t):
    return statuses(t).select("asset_id", "match_status", "e4_score")


@query("candidate_list", "H10", f"""WITH {_VERIFIED} SELECT asset_id, candidate_id, similarity, pct AS similarity_pct, severity, stype AS source_type, source_domain, strength AS evidence_strength, label AS match_label FROM verified
UNION ALL SELECT merchant_id, 'platform_vit_1', local_similarity, {sql_pct('local_similarity')}, CASE WHEN local_similarity >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END, 'PLATFORM_VIT', coalesce(source_domain, 'platform-merchant.internal'), CASE WHEN local_similarity >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END, 'Platform ViT Match' FROM v_signal WHERE local_similarity >= 0.70""")
def _(t):
    platform = t.view("v_signal").select(
        F.col("merchant_id").alias("asset_id"), F.lit(1).alias("seq"), F.col("local_similarity").alias("similarity"),
        F.array("masked_one").alias("masked_ids"), F.col("source_domain").alias("domain"), F.lit(None).cast("string").alias("asset_url"),
    )
    return candidates.candidate_list(verified(t), platform).drop("source_url", "title")


# ---- logos ----------------------------------------------------------------------------

_COMPACT = lambda x: f"replace(replace(replace(lower({x}), ' ', ''), '-', ''), '_', '')"
_REFS = f"""br AS (SELECT DISTINCT claimed_brand AS b FROM v_logo), refs AS (SELECT b, filename FROM br JOIN v_logo_registry r ON contains({_COMPACT('r.filename')}, {_COMPACT('b')})
 OR contains({_COMPACT('b')}, replace(replace({_COMPACT('r.filename')}, '.png', ''), '.jpg', '')) OR len(list_filter(string_split_regex(lower(b), '\\s+'), lambda w: length(w) > 3 AND contains({_COMPACT('r.filename')}, w))) > 0)"""


@query("brand_references", "F14", f"WITH {_REFS} SELECT b AS claimed_brand, filename FROM refs")
def _(t):
    return logos.brand_references(t.view("v_logo"), t.view("v_logo_registry"))


_LOGO = f"""{_REFS}, ls AS (SELECT l.merchant_id, refs.filename, {_COS('l.embedding', 'r.embedding')} AS s FROM v_logo l JOIN refs ON refs.b = l.claimed_brand JOIN v_logo_registry r ON r.filename = refs.filename WHERE l.merchant_id % 9 <> 0),
lr AS (SELECT merchant_id, filename, {sql_round('s', 4)} AS s4 FROM ls), lb AS (SELECT merchant_id, max(s4) AS s4, arg_min(filename, struct_pack(a := -s4, b := filename)) AS f FROM lr GROUP BY 1),
lx AS (SELECT l.merchant_id, f, coalesce(s4, 0.85::DOUBLE) AS sim FROM v_logo l LEFT JOIN lb USING (merchant_id)), ly AS (SELECT *, sim * 100::DOUBLE AS c, greatest(0::DOUBLE, (1::DOUBLE - sim) * 100::DOUBLE) AS r FROM lx)"""


@query("logo_consistency", "F15", f"WITH {_LOGO} SELECT merchant_id, sim AS logo_similarity, {sql_round('c', 1)} AS consistency_score, {sql_round('r', 1)} AS logo_risk, f AS matched_logo, CASE WHEN sim >= 0.82 THEN 'LOW' WHEN sim >= 0.55 THEN 'MEDIUM' ELSE 'HIGH' END AS logo_level FROM ly")
def _(t):
    shown = t.view("v_logo").withColumn("embedding", F.when(F.col("merchant_id") % 9 != 0, F.col("embedding")))
    return logos.logo_consistency(shown, t.view("v_logo_registry")).select(
        "merchant_id", "logo_similarity", "consistency_score", "logo_risk", "matched_logo", "logo_level"
    )


_SPACE = lambda x: f"replace(replace(lower({x}), '-', ' '), '_', ' ')"
_RESOLVED = f"""br AS (SELECT DISTINCT claimed_brand AS b FROM v_logo), st AS (SELECT filename, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM v_logo_registry),
rs AS (SELECT b, min(filename) AS f FROM br LEFT JOIN st ON contains({_SPACE('stem')}, {_SPACE('trim(b)')}) OR contains({_SPACE('trim(b)')}, {_SPACE('stem')}) GROUP BY 1)"""


@query("verified_brands", "F16", f"WITH {_RESOLVED} SELECT b AS claimed_brand, CASE WHEN f IS NULL THEN 'UNAVAILABLE' ELSE 'VERIFIED' END AS brand_status, regexp_replace(f, '\\.[^.]*$', '') AS brand_name FROM rs")
def _(t):
    return logos.resolve_brands(t.view("v_logo"), t.view("v_logo_registry")).drop("brand_file")


@query("logo_mismatch", "F17", f"""WITH {_RESOLVED}, j AS (SELECT l.merchant_id, f, CASE WHEN f IS NOT NULL THEN {_COS('l.embedding', 'r.embedding')} END AS s FROM v_logo l JOIN rs ON rs.b = l.claimed_brand LEFT JOIN v_logo_registry r ON r.filename = rs.f)
SELECT merchant_id, CASE WHEN s IS NULL THEN 'UNAVAILABLE' ELSE 'VERIFIED' END AS brand_status, CASE WHEN s < 0.60 THEN {sql_whole('(1::DOUBLE - s) * 100::DOUBLE')} WHEN s < 0.78 THEN {sql_whole('(0.80::DOUBLE - s) * 50::DOUBLE')} WHEN s IS NOT NULL THEN 0 END AS score FROM j""")
def _(t):
    urls = t.view("v_logo").withColumn("logo_url", F.lit(None).cast("string"))
    return logos.logo_mismatch(urls, t.view("v_logo_registry")).select("merchant_id", "brand_status", "score")
