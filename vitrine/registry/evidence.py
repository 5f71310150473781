"""Queries of the evidence-fusion family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains
from ..operators import evidence
from .core import query, sql_pct, sql_round
from .similarity import _F7, _REF, batch
from .urls import _CLEAN, _sql_list


def detections(t):
    arr = lambda c: F.filter(F.split(c, r"\|"), lambda u: u != "")
    return t.view("v_web").select(
        "asset_id", "asset_url", "asset_type", "merchant_domain", arr("full_urls").alias("full_images"), arr("partial_urls").alias("partial_images"),
        arr("similar_urls").alias("similar_images"), arr("page_urls").alias("page_urls"),
    )


_DOM = lambda u: f"regexp_replace(split_part(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1), ':', 1), '^www\\.', '')"
_LIST = lambda c: f"list_filter(string_split({c}, '|'), lambda u: u <> '')"
# pages and images exploded with their position; own domains removed
_WEB = f"""w AS (SELECT *, {_LIST('full_urls')} AS fl, {_LIST('partial_urls')} AS pl, {_LIST('similar_urls')} AS sl, {_LIST('page_urls')} AS pg, coalesce(merchant_domain, '') AS md FROM v_web),
ex AS (SELECT asset_id, md, 'page' AS src, unnest(pg) AS url, generate_subscripts(pg, 1) AS pos FROM w UNION ALL SELECT asset_id, md, 'image', unnest(list_concat(fl, pl)), generate_subscripts(list_concat(fl, pl), 1) FROM w),
ed AS (SELECT *, {_DOM('url')} AS dom, row_number() OVER (PARTITION BY asset_id, src, url ORDER BY pos) AS rep FROM ex),
eo AS (SELECT *, {_sql_list('dom', domains.MARKETPLACES)} AS mkt, {_sql_list('dom', domains.STOCK_SITES + domains.IMAGE_AGGREGATORS)} AS stk FROM ed WHERE NOT (md <> '' AND (dom = md OR suffix(dom, '.' || md) OR suffix(md, '.' || dom))))"""


@query("normalised_detections", "H1", f"""WITH {_WEB}, pg AS (SELECT * FROM eo WHERE src = 'page' AND rep = 1), use AS (SELECT * FROM pg UNION ALL SELECT * FROM eo WHERE src = 'image' AND asset_id NOT IN (SELECT asset_id FROM pg)),
firsts AS (SELECT asset_id, dom, min(pos) AS fp FROM use GROUP BY 1, 2), top3 AS (SELECT asset_id, string_agg(dom, ', ' ORDER BY fp) AS names FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY fp) AS n FROM firsts QUALIFY n <= 3) GROUP BY 1),
g AS (SELECT asset_id, bool_or(mkt) AS im, bool_or(stk) AS ist, bool_and(mkt) AS am, bool_and(stk) AS ast, string_agg(url, ' ' ORDER BY pos) FILTER (pos5 <= 5) AS pages FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY pos) AS pos5 FROM use) GROUP BY 1)
SELECT w.asset_id, CASE WHEN g.asset_id IS NULL AND len(fl) + len(pl) = 0 THEN 0 WHEN len(fl) > 0 THEN CASE WHEN im OR ist THEN 65 ELSE 75 END WHEN len(pl) > 0 THEN CASE WHEN im OR ist THEN 45 ELSE 55 END ELSE 30 END AS score,
 coalesce(im AND am, FALSE) AS is_marketplace_only, coalesce(ist AND ast, FALSE) AS is_stock_only, coalesce(pages, '') AS matched_pages,
 CASE WHEN g.asset_id IS NULL AND len(fl) + len(pl) = 0 THEN format('Unique asset. No external online web matches discovered for this {{}}.', asset_type) WHEN im THEN format('Visual reuse observed across external marketplace/catalog listing(s) ({{}}). Evidence of multi-channel listing or catalog reuse.', names)
  WHEN ist THEN format('Visual asset matches known stock photography repository ({{}}).', names) ELSE format('Potential external visual reuse discovered across third-party site(s) ({{}}).', coalesce(names, '')) END AS explanation
FROM w LEFT JOIN g USING (asset_id) LEFT JOIN top3 USING (asset_id)""")
def _(t):
    return evidence.normalise_detections(detections(t)).select(
        "asset_id", "score", "is_marketplace_only", "is_stock_only",
        F.array_join(F.transform("matched_pages", lambda p: p["url"]), " ").alias("matched_pages"), "explanation",
    )


_TIER = f"""{_WEB}, pt AS (SELECT asset_id, count(*) AS np, bool_or(mkt) AS mk FROM eo WHERE src = 'page' GROUP BY 1), pf AS (SELECT asset_id, dom, min(pos) AS fp FROM eo WHERE src = 'page' GROUP BY 1, 2),
pd AS (SELECT asset_id, list(dom ORDER BY fp) AS doms FROM pf GROUP BY 1),
tier AS (SELECT w.*, coalesce(np, 0) AS n_pages, coalesce(doms, []) AS doms, CASE WHEN len(fl) > 0 THEN 'full_match' WHEN len(pl) > 0 OR coalesce(np, 0) > 0 THEN 'partial_match' WHEN len(sl) > 0 THEN 'similar_image' ELSE 'none' END AS web_result,
 CASE WHEN len(fl) > 0 THEN CASE WHEN mk THEN 60 ELSE 75 END WHEN len(pl) > 0 OR coalesce(np, 0) > 0 THEN CASE WHEN mk THEN 45 ELSE 50 END WHEN len(sl) > 0 THEN 30 ELSE 0 END AS web_score FROM w LEFT JOIN pt USING (asset_id) LEFT JOIN pd USING (asset_id))"""


@query("web_detection_tiers", "H2", f"WITH {_TIER} SELECT asset_id, web_result, web_score, n_pages, array_to_string(doms, ',') AS matched_domains FROM tier")
def _(t):
    return evidence.web_tiers(detections(t)).select(
        "asset_id", "web_result", "web_score", F.col("n_pages").cast("long").alias("n_pages"), F.array_join("matched_domains", ",").alias("matched_domains")
    )


_LOCAL = "CASE asset_id % 6 WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.85e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.925e0 ELSE 0e0 END"


@query("dual_source_evidence", "H3", f"""WITH {_TIER}, l AS (SELECT *, CAST({_LOCAL} AS DOUBLE) AS sim FROM tier), m AS (SELECT *, CASE WHEN sim >= 0.82 THEN {sql_pct('sim')} ELSE 0 END AS ls, web_result = 'full_match' OR (n_pages >= 1 AND web_score >= 50) AS ws FROM l),
n AS (SELECT *, CASE WHEN ws AND sim >= 0.92 THEN 1 WHEN web_score > 0 AND ls > 0 THEN 2 WHEN web_score > 0 THEN 3 WHEN ls > 0 THEN 4 ELSE 5 END AS c, array_to_string(doms[1:2], ', ') AS two, {sql_pct('sim')} AS pct FROM m)
SELECT asset_id, CASE WHEN c = 4 THEN 'cross_merchant_visual_similarity' ELSE 'external_image_reuse' END AS signal_type,
 CASE c WHEN 1 THEN least(85, CAST(round_even(0.5::DOUBLE * web_score + 0.5::DOUBLE * ls + 15, 0) AS INT)) WHEN 2 THEN least(70, CAST(round_even(0.5::DOUBLE * web_score + 0.5::DOUBLE * ls + 10, 0) AS INT)) WHEN 3 THEN least(60, web_score) WHEN 4 THEN least(58, ls) ELSE 0 END AS score,
 CASE c WHEN 3 THEN 'OPEN_WEB' WHEN 4 THEN 'LOCAL_INDEX' ELSE 'FUSED' END AS evidence_source, c <= 2 AS corroborated, CASE c WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN CASE WHEN ws THEN 'HIGH' ELSE 'MEDIUM' END WHEN 4 THEN CASE WHEN sim >= 0.92 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS confidence,
 CASE c WHEN 1 THEN 'CORROBORATED_POTENTIAL_REUSE' WHEN 2 THEN 'CORROBORATED_POTENTIAL_REUSE' WHEN 5 THEN 'LOW_EVIDENCE' ELSE 'POTENTIAL_REUSE' END AS asset_evidence_level,
 CASE c WHEN 1 THEN format('This asset has corroborated potential visual reuse evidence across both the open web ({{}}) and strong visual similarity ({{}}%) to visuals from previously scanned merchant(s).', CASE WHEN len(doms) > 0 THEN two ELSE 'external domains' END, pct)
  WHEN 2 THEN format('Potential visual reuse evidence: partial matches discovered on open web and moderate cross-merchant visual similarity ({{}}%).', pct) WHEN 3 THEN format('Potential visual reuse evidence discovered on open web ({{}}). No cross-merchant matches found in platform index.', CASE WHEN len(doms) > 0 THEN two ELSE 'third-party pages' END)
  WHEN 4 THEN 'Visual similarity observed against visual assets from previously scanned merchant (mch_***01). No open-web matches found.' ELSE 'Unique asset. No open web matches or cross-merchant visual commonalities detected.' END AS explanation FROM n""")
def _(t):
    fed = evidence.web_tiers(detections(t)).withColumns(
        {"local_similarity": F.expr(f"CAST({_LOCAL} AS DOUBLE)"), "masked_ids": F.array(F.lit("mch_***01"))}
    )
    return evidence.fuse_sources(fed).select(
        "asset_id", "signal_type", "score", "evidence_source", "corroborated", "confidence", "asset_evidence_level", "explanation"
    )


@query("evidence_risk", "H4", """WITH b AS (SELECT DISTINCT merchant_id, CASE WHEN merchant_id % 3 = 0 THEN 'UNAVAILABLE' ELSE 'VERIFIED' END AS brand_status FROM v_evidence),
g AS (SELECT merchant_id, coalesce(max(score) FILTER (signal_type IN ('external_image_reuse', 'cross_merchant_visual_similarity')), 0) AS r, coalesce(max(score) FILTER (signal_type = 'potential_logo_mismatch'), 0) AS l0, coalesce(max(score) FILTER (signal_type = 'manipulation'), 0) AS m,
 coalesce(bool_and(is_marketplace_only OR is_stock_only) FILTER (signal_type IN ('external_image_reuse', 'cross_merchant_visual_similarity')), FALSE) AS soft FROM v_evidence GROUP BY 1),
h AS (SELECT g.*, CASE WHEN brand_status = 'VERIFIED' THEN l0 ELSE 0 END AS l FROM g JOIN b USING (merchant_id)),
i AS (SELECT *, CAST(r >= 40 AS INT) + CAST(l >= 40 AS INT) + CAST(m >= 40 AS INT) AS v, CAST(r > 0 AS INT) + CAST(l > 0 AS INT) + CAST(m > 0 AS INT) AS n, greatest(r, l, m)::DOUBLE AS pk FROM h),
j AS (SELECT merchant_id, CAST(round_even(greatest(0::DOUBLE, least(100::DOUBLE, CASE WHEN n = 0 THEN 0 WHEN v >= 2 THEN 0.60::DOUBLE * pk + 0.40::DOUBLE * ((r + l + m)::DOUBLE / n) WHEN m >= 70 THEN m WHEN soft THEN least(55::DOUBLE, pk * 0.85::DOUBLE) ELSE least(60::DOUBLE, pk) END)), 0) AS INT) AS risk_score FROM i)
SELECT merchant_id, risk_score, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'REVIEW' ELSE 'LOW' END AS risk_level, CASE WHEN risk_score >= 70 THEN 'MANUAL_REVIEW' WHEN risk_score >= 40 THEN 'ADDITIONAL_VERIFICATION' ELSE 'NORMAL_FLOW' END AS action FROM j""")
def _(t):
    rows = t.view("v_evidence")
    brands = rows.select("merchant_id").distinct().withColumn(
        "brand_status", F.when(F.col("merchant_id") % 3 == 0, "UNAVAILABLE").otherwise("VERIFIED")
    )
    return evidence.evidence_risk(rows, brands)


_UNIFIED = """un AS (SELECT *, greatest(max_similarity, local_similarity) AS sim, CASE WHEN local_similarity > max_similarity THEN FALSE ELSE is_own_brand END AS own FROM v_signal)"""
_CALIBRATED = f"""{_UNIFIED}, cq AS (SELECT *, CASE WHEN own OR sim < 0.70 THEN 0::DOUBLE WHEN source_type = 'SUPPLIER_CATALOG' THEN least(20::DOUBLE, 10::DOUBLE + (sim - 0.70::DOUBLE) * 30::DOUBLE) WHEN source_type = 'MARKETPLACE' AND sim < 0.95 THEN least(35::DOUBLE, 15::DOUBLE + (sim - 0.70::DOUBLE) * 40::DOUBLE)
 WHEN sim >= 0.88 THEN least(100::DOUBLE, 75::DOUBLE + (sim - 0.88::DOUBLE) / 0.12::DOUBLE * 25::DOUBLE) ELSE 40::DOUBLE + (sim - 0.70::DOUBLE) / 0.18::DOUBLE * 35::DOUBLE END AS cs FROM un),
cal AS (SELECT *, {sql_round('cs', 1)} AS score, CASE WHEN own OR sim < 0.70 OR source_type = 'SUPPLIER_CATALOG' OR (source_type = 'MARKETPLACE' AND sim < 0.95) THEN 'LOW' WHEN sim >= 0.88 THEN 'HIGH' ELSE 'MEDIUM' END AS lvl FROM cq)"""


def calibrated(t):
    return evidence.calibrate_reuse(evidence.unify_similarity(t.view("v_signal")))


@query("reuse_calibration", "H5", f"WITH {_CALIBRATED} SELECT merchant_id, score AS reuse_risk_score, lvl AS reuse_level FROM cal")
def _(t):
    return calibrated(t).select("merchant_id", "reuse_risk_score", "reuse_level")


@query("similarity_unification", "H6", f"WITH {_UNIFIED} SELECT merchant_id, sim AS max_similarity, own AS is_own_brand FROM un")
def _(t):
    return evidence.unify_similarity(t.view("v_signal")).select("merchant_id", "max_similarity", "is_own_brand")


@query("catalogue_override", "H7", f"""WITH {_REF}, {_F7}, {_CALIBRATED}, bt AS (SELECT merchant_id, mx, {sql_round('sc', 1)} AS bs, risk_level FROM i7)
SELECT c.merchant_id, CASE WHEN mx > sim THEN bs ELSE score END AS reuse_risk_score, CASE WHEN mx > sim THEN risk_level ELSE lvl END AS reuse_level, CASE WHEN mx > sim THEN mx ELSE sim END AS max_similarity FROM cal c LEFT JOIN bt USING (merchant_id)""")
def _(t):
    return evidence.override_with_batch(calibrated(t), batch(t)).select("merchant_id", "reuse_risk_score", "reuse_level", "max_similarity")


def flagged_input(t):
    return calibrated(t).withColumns(
        {
            "masked_ids": F.when(F.col("masked_one").isNotNull(), F.array("masked_one")),
            "local_url": F.concat(F.lit("https://i/"), F.col("merchant_id").cast("string")),
            "local_domain": F.col("source_domain"),
            "top_candidate_id": F.when(F.col("image_count") > 2, "cand"),
            "top_similarity": F.col("top_k_similarity"),
            "top_source_type": F.col("source_type"),
            "top_source_url": F.lit("https://web/"),
            "top_source_domain": F.lit("web"),
            "top_explanation": F.lit("web candidate"),
            "match_explanation": F.lit(None).cast("string"),
            "web_source_type": F.lit("NONE"),
        }
    )


@query("top_flagged_items", "H8", f"""WITH {_CALIBRATED}, k AS (SELECT *, local_similarity >= 0.70 AND local_similarity >= sim AS ul, image_count > 2 AS uw FROM cal)
SELECT merchant_id, CASE WHEN ul THEN 'index' WHEN uw THEN 'web' ELSE 'none' END AS flag_kind, CASE WHEN ul THEN local_similarity WHEN uw THEN top_k_similarity ELSE sim END AS flag_similarity, CASE WHEN ul THEN 'LOCAL_INDEX' WHEN uw THEN source_type ELSE 'NONE' END AS flag_source_type,
 CASE WHEN ul THEN coalesce(source_domain, 'platform-catalog.internal') WHEN uw THEN 'web' END AS flag_source_domain, CASE WHEN ul THEN format('Visual asset matches previously scanned merchant ({{}}) with {{}}% ViT similarity.', coalesce(masked_one, 'platform merchants'), {sql_pct('local_similarity')}) WHEN uw THEN 'web candidate' ELSE 'No external matches found.' END AS flag_explanation FROM k""")
def _(t):
    return evidence.top_flagged(flagged_input(t)).select(
        "merchant_id", "flag_kind", "flag_similarity", "flag_source_type", "flag_source_domain", "flag_explanation"
    )


@query("status_override", "H9", f"WITH {_UNIFIED} SELECT merchant_id, CASE WHEN local_similarity >= 0.70 AND local_similarity >= sim THEN 'CROSS_MERCHANT_REUSE' ELSE match_status END AS match_status FROM un")
def _(t):
    return evidence.override_status(evidence.unify_similarity(t.view("v_signal"))).select("merchant_id", "match_status")
