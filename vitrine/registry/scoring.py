"""Queries of the scoring and explanation families (SURVEY I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import explain, scoring
from .core import Tables, query, sql_pct, sql_round, sql_text, sql_whole

# ---- SQL twins, one CTE per step -----------------------------------------------

BUSINESS = """
b0 AS (SELECT *, crawl_status IS NULL AS absent, coalesce(crawl_status <> 'SUCCESS' OR coalesce(crawl_error, '') <> '', FALSE) AS failed FROM v_crawl),
b1 AS (SELECT *, CASE WHEN absent OR failed THEN NULL ELSE site_category END AS eff_category,
  absent OR (NOT failed AND has_contact) AS c1, absent OR (NOT failed AND has_policy) AS c2, absent OR (NOT failed AND has_pricing) AS c3,
  absent OR (NOT failed AND has_about) AS c4, absent OR (NOT failed AND n_social > 0) AS c5 FROM b0),
b2 AS (SELECT *, coalesce(eff_category IN ('FINTECH_PAYMENTS', 'SAAS_SOFTWARE', 'INFORMATIONAL_INSTITUTION'), FALSE) AS non_retail FROM b1),
business AS (SELECT *, CASE WHEN absent THEN 18::DOUBLE WHEN failed THEN NULL ELSE greatest(5::DOUBLE, least(95::DOUBLE,
   15::DOUBLE + CASE WHEN c1 THEN 0 ELSE 25 END + CASE WHEN c2 THEN 0 ELSE 20 END + CASE WHEN c3 OR non_retail THEN 0 ELSE 15 END
   + CASE WHEN c4 THEN 0 ELSE 5 END + CASE WHEN c5 THEN 0 ELSE 5 END)) END AS text_risk_score FROM b2)"""

VISUAL = f"""
g AS (SELECT *, CASE WHEN is_own_brand OR match_status IN ('NO_EXTERNAL_MATCH', '') THEN 0::DOUBLE
   WHEN match_status = 'INSUFFICIENT_EVIDENCE' THEN least(35::DOUBLE, reuse_risk_score)
   WHEN match_status = 'WEAK_MATCH' THEN least(25::DOUBLE, reuse_risk_score) ELSE reuse_risk_score END AS e1_score FROM v_signal),
h AS (SELECT *, greatest(e1_score, e4_score) AS reuse_risk, greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE - coherence_score)) AS dispersion FROM g),
i AS (SELECT *, 0.40::DOUBLE * reuse_risk + 0.15::DOUBLE * logo_risk + 0.25::DOUBLE * manipulation_score + 0.08::DOUBLE * synthetic_score + 0.12::DOUBLE * dispersion AS linear_base,
   list_sort([reuse_risk, logo_risk, manipulation_score], 'DESC') AS ranked,
   len(list_filter([reuse_risk, logo_risk, manipulation_score], lambda s: s >= 65)) AS n_severe,
   len(list_filter([reuse_risk, logo_risk, manipulation_score], lambda s: s >= 40)) AS n_moderate FROM h),
j AS (SELECT *, CASE WHEN n_severe >= 2 THEN greatest(linear_base, 0.55::DOUBLE * ranked[1] + 0.35::DOUBLE * ranked[2] + 0.10::DOUBLE * linear_base)
   WHEN n_severe = 1 AND n_moderate >= 2 THEN greatest(linear_base, 0.45::DOUBLE * ranked[1] + 0.30::DOUBLE * ranked[2] + 0.25::DOUBLE * linear_base)
   ELSE linear_base END AS composite FROM i),
k AS (SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, CASE WHEN reuse_risk = 0 AND logo_risk < 50 THEN least(composite, 38::DOUBLE) ELSE composite END)) AS raw_visual FROM j),
visual AS (SELECT *, {sql_round('raw_visual', 1)} AS visual_risk_score FROM k)"""

FUSED = f"""{BUSINESS},{VISUAL},
m AS (SELECT v.*, b.text_risk_score, b.non_retail, b.c1, b.c2, b.c4, b.c5, b.failed, b.domain, b.merchant_name, b.crawl_status, b.crawl_error
   FROM business b JOIN visual v ON b.merchant_id = v.merchant_id WHERE NOT b.failed),
n AS (SELECT *, CASE WHEN visual_risk_score >= 70 THEN greatest(visual_risk_score, 0.15::DOUBLE * text_risk_score + 0.85::DOUBLE * visual_risk_score)
   WHEN visual_risk_score >= 40 THEN 0.30::DOUBLE * text_risk_score + 0.70::DOUBLE * visual_risk_score
   WHEN text_risk_score >= 70 AND NOT non_retail THEN greatest(45::DOUBLE, 0.55::DOUBLE * text_risk_score + 0.45::DOUBLE * visual_risk_score)
   ELSE 0.35::DOUBLE * text_risk_score + 0.65::DOUBLE * visual_risk_score END AS raw_fusion,
   CASE WHEN c1 AND c2 AND c4 THEN 5::DOUBLE ELSE 0 END + CASE WHEN c5 THEN 3 ELSE 0 END + CASE WHEN non_retail THEN 8 ELSE 0 END AS trust_deduction,
   source_type IN ('SUPPLIER_CATALOG', 'MARKETPLACE') AS is_supplier FROM m),
o AS (SELECT *, greatest(5::DOUBLE, raw_fusion - trust_deduction) AS fused_score,
   CAST(reuse_risk_score >= 70 AND NOT is_supplier AND match_status NOT IN ('INSUFFICIENT_EVIDENCE', 'WEAK_MATCH', 'NO_EXTERNAL_MATCH') AS INT)
   + CAST(logo_risk >= 60 AS INT) + CAST(manipulation_score >= 60 AS INT) + CAST(text_risk_score >= 65 AND NOT non_retail AS INT) AS severe_count FROM n),
p AS (SELECT *, greatest(5::DOUBLE, least(100::DOUBLE, CASE WHEN severe_count >= 2 THEN greatest(80::DOUBLE, fused_score)
   WHEN severe_count = 1 AND reuse_risk_score >= 88 AND NOT is_supplier THEN least(74::DOUBLE, greatest(55::DOUBLE, fused_score))
   WHEN reuse_risk_score = 0 OR is_supplier THEN least(fused_score, CASE WHEN is_supplier THEN 38::DOUBLE ELSE 32::DOUBLE END)
   ELSE least(64::DOUBLE, fused_score) END)) AS raw_final FROM o),
q AS (SELECT *, {sql_round('raw_final', 1)} AS final_score FROM p),
fused AS (SELECT *, CASE WHEN final_score >= 80 THEN 'HIGH' WHEN final_score >= 65 THEN 'ELEVATED' WHEN final_score >= 50 THEN 'MEDIUM' WHEN final_score >= 30 THEN 'LOW' ELSE 'CLEAR' END AS status_tier,
   CASE WHEN final_score >= 80 THEN 'HIGH' WHEN final_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS status FROM q)"""


def signals(t: Tables) -> DataFrame:
    """Signals and crawl facts on one row per merchant, failed crawls left out."""
    joined = t.view("v_crawl").join(t.view("v_signal"), "merchant_id")
    return joined.withColumn(
        "masked_ids", F.when(F.col("masked_one").isNotNull(), F.array("masked_one"))
    ).filter(~scoring.crawl_failed())


def decided(t: Tables) -> DataFrame:
    return scoring.decide(signals(t))


def failed_crawls(t: Tables) -> DataFrame:
    return t.view("v_crawl").filter(scoring.crawl_failed())


@query("business_risk", "I1", f"""WITH {BUSINESS}
SELECT merchant_id, text_risk_score, c1 AS sig_contact, c2 AS sig_policy, c3 AS sig_pricing, c4 AS sig_about, c5 AS sig_social, non_retail,
  CASE WHEN absent THEN {sql_text(scoring.SUMMARY_OFFLINE)} WHEN failed THEN 'Unreachable Website: ' || coalesce(nullif(crawl_error, ''), 'Merchant website could not be reached')
    WHEN text_risk_score < 40 THEN {sql_text(scoring.SUMMARY_GOOD)} ELSE {sql_text(scoring.SUMMARY_POOR)} END AS text_summary
FROM business""")
def _(t):
    return scoring.business_risk(t.view("v_crawl")).select(
        "merchant_id", "text_risk_score", "sig_contact", "sig_policy", "sig_pricing", "sig_about", "sig_social",
        "non_retail", "text_summary",
    )


@query("reuse_evidence_gate", "I2", f"WITH {VISUAL} SELECT merchant_id, match_status, is_own_brand, e1_score FROM g")
def _(t):
    return scoring.reuse_gate(t.view("v_signal")).select("merchant_id", "match_status", "is_own_brand", "e1_score")


@query("visual_risk", "I3", f"""WITH {VISUAL}
SELECT merchant_id, e1_score, reuse_risk, dispersion, visual_risk_score,
  CASE WHEN visual_risk_score >= 70 THEN 'HIGH' WHEN visual_risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS visual_risk_level,
  n_severe >= 2 AS corroboration_active FROM visual""")
def _(t):
    return scoring.visual_risk(scoring.reuse_gate(t.view("v_signal"))).select(
        "merchant_id", "e1_score", "reuse_risk", "dispersion", "visual_risk_score", "visual_risk_level",
        "corroboration_active",
    )


@query("visual_risk_breakdown", "I3", f"""WITH {VISUAL},
u AS (SELECT merchant_id, 'image_reuse' AS dimension, reuse_risk AS s, 0.40::DOUBLE AS weight FROM visual
 UNION ALL SELECT merchant_id, 'logo_inconsistency', logo_risk, 0.15 FROM visual UNION ALL SELECT merchant_id, 'manipulation', manipulation_score, 0.25 FROM visual
 UNION ALL SELECT merchant_id, 'synthetic_signal', synthetic_score, 0.08 FROM visual UNION ALL SELECT merchant_id, 'identity_dispersion', dispersion, 0.12 FROM visual),
w AS (SELECT *, s * weight AS c FROM u)
SELECT merchant_id, dimension, {sql_round('s', 1)} AS score, weight, {sql_round('c', 1)} AS contribution FROM w""")
def _(t):
    return scoring.visual_breakdown(scoring.visual_risk(scoring.reuse_gate(t.view("v_signal"))))


@query("unverifiable_decisions", "I4", f"""WITH {BUSINESS},
f AS (SELECT merchant_id, crawl_status, nullif(crawl_error, '') AS err, domain FROM business WHERE failed)
SELECT merchant_id, NULL::DOUBLE AS final_score, NULL::DOUBLE AS text_risk_score, NULL::DOUBLE AS visual_risk_score,
  CASE crawl_status WHEN 'ROBOTS_DISALLOWED' THEN 'COMPLIANCE_LIMITED' WHEN 'BOT_BLOCKED' THEN 'BOT_BLOCKED' WHEN 'REDIRECT_LIMIT_EXCEEDED' THEN 'REDIRECT_LIMIT_EXCEEDED' ELSE 'UNVERIFIABLE' END AS status,
  CASE crawl_status WHEN 'ROBOTS_DISALLOWED' THEN '#2563eb' WHEN 'BOT_BLOCKED' THEN '#6366f1' WHEN 'REDIRECT_LIMIT_EXCEEDED' THEN '#f59e0b' ELSE '#64748b' END AS badge_color,
  CASE crawl_status WHEN 'ROBOTS_DISALLOWED' THEN 'Robots.txt Policy: Automated crawling restricted by merchant domain (' || domain || ').'
    WHEN 'BOT_BLOCKED' THEN 'Anti-Bot Protection: Target platform (' || domain || ') returned HTTP 403 / 429.'
    WHEN 'REDIRECT_LIMIT_EXCEEDED' THEN 'Redirect Limit Exceeded: Automated crawl aborted after exceeding 3 redirect hops on ' || domain || '.'
    ELSE 'Website Unreachable: ' || coalesce(err, 'Website crawl failed or domain could not be resolved') || '.' END AS first_reason,
  crawl_status = 'ROBOTS_DISALLOWED' AS is_compliance_limited, crawl_status = 'BOT_BLOCKED' AS is_bot_blocked, crawl_status = 'REDIRECT_LIMIT_EXCEEDED' AS is_redirect_limit_exceeded,
  coalesce(err, CASE crawl_status WHEN 'ROBOTS_DISALLOWED' THEN 'Robots.txt policy restricts automated crawler access.' WHEN 'BOT_BLOCKED' THEN 'Anti-bot protection blocked automated access (HTTP 403).'
    WHEN 'REDIRECT_LIMIT_EXCEEDED' THEN 'Crawl diagnostic: redirect chain exceeded safety limit of 3 hops.' END) AS crawl_error FROM f""")
def _(t):
    return explain.unverifiable_decision(failed_crawls(t)).select(
        "merchant_id", "final_score", "text_risk_score", "visual_risk_score", "status", "badge_color",
        F.col("reasons")[0].alias("first_reason"), "is_compliance_limited", "is_bot_blocked",
        "is_redirect_limit_exceeded", "crawl_error",
    )


@query("base_fusion", "I5", f"""WITH {FUSED} SELECT merchant_id, text_risk_score AS text_in, visual_risk_score AS visual_in, trust_deduction, round(fused_score, 6) AS fused_score FROM fused""")
def _(t):
    return decided(t).select(
        "merchant_id", "text_in", "visual_in", "trust_deduction", F.round("fused_score", 6).alias("fused_score")
    )


@query("severe_signal_count", "I6", f"WITH {FUSED} SELECT merchant_id, is_supplier, severe_count FROM fused")
def _(t):
    return decided(t).select("merchant_id", "is_supplier", "severe_count")


@query("corroboration_gate", "I7", f"WITH {FUSED} SELECT merchant_id, severe_count, final_score FROM fused")
def _(t):
    return decided(t).select("merchant_id", "severe_count", "final_score")


_TIER = lambda field: "CASE " + " ".join(
    f"WHEN final_score >= {tier[0]} THEN {sql_text(tier[field])}" for tier in scoring.TIERS[:-1]
) + f" ELSE {sql_text(scoring.TIERS[-1][field])} END"


@query("risk_tiers", "I8", f"""WITH {FUSED} SELECT merchant_id, final_score, status_tier, status, {_TIER(3)} AS status_label, {_TIER(4)} AS recommendation, {_TIER(5)} AS badge_color FROM fused""")
def _(t):
    return decided(t).select(
        "merchant_id", "final_score", "status_tier", "status", "status_label", "recommendation", "badge_color"
    )


_REASONS = f"""WITH {FUSED},
r AS (SELECT *, coalesce(masked_one, nullif(source_domain, ''), reference_filename, 'external web source') AS ref,
  {sql_pct('max_similarity')} AS pct, {sql_pct('logo_similarity')} AS lpct FROM fused),
flagged AS (SELECT merchant_id, is_own_brand, list_filter([
  CASE WHEN text_risk_score >= 70 THEN 'Merchant website lacks critical business disclosures (contact channels, return policy, and business entity info).' END,
  CASE WHEN is_own_brand THEN 'No external visual matches discovered online — visual content appears unique and proprietary to this merchant.'
    WHEN source_type IN ('SUPPLIER_CATALOG', 'MARKETPLACE', 'SOFT_TRUST') AND max_similarity >= 0.70 THEN format('Product imagery matches supplier/distributor catalog on {{}} ({{}}% ViT similarity) — consistent with authorized reseller sourcing, not misrepresentation.', ref, pct)
    WHEN max_similarity >= 0.85 THEN format('Product imagery strongly matches candidate visual ({{}}% ViT similarity with {{}}) — Potential Visual Misrepresentation.', pct, ref)
    WHEN max_similarity >= 0.70 THEN format('Product imagery exhibits moderate visual similarity ({{}}%) to candidate on {{}}.', pct, ref) END,
  CASE WHEN logo_similarity < 0.55 AND matched_logo IS NOT NULL THEN format('Merchant logo significantly diverges ({{}}% match) from verified {{}} identity.', lpct, matched_logo)
    WHEN logo_similarity < 0.80 AND matched_logo IS NOT NULL THEN format('Merchant logo demonstrates moderate stylistic variance ({{}}%) against verified {{}} assets.', lpct, matched_logo) END,
  CASE WHEN manipulation_score >= 60 THEN 'Visual assets contain high localized compression and splicing indicators (Forensic score: ' || manipulation_score || '%).'
    WHEN manipulation_score >= 35 THEN 'Moderate image recompression and gradient variance indicators detected (Forensic score: ' || manipulation_score || '%).' END,
  CASE WHEN synthetic_score >= 60 THEN 'Elevated synthetic/AI-generation markers observed in product imagery (' || synthetic_score || '% suspicion — supporting signal only).' END,
  CASE WHEN coherence_score < 35 THEN format('Merchant''s product visuals display low internal style coherence ({{}}% consistency — images may originate from disconnected external catalogs).', {sql_whole('coherence_score')}) END
 ], lambda x: x IS NOT NULL) AS flags FROM r)
SELECT merchant_id, array_to_string(CASE WHEN len(flags) = 0 OR (len(flags) = 1 AND is_own_brand) THEN list_concat(flags, ['Visual evidence is internally consistent and matches claimed merchant branding.',
  'No document tampering, forensic anomalies, or deceptive signals detected.']) ELSE flags END, ' || ') AS reasons FROM flagged"""


@query("decision_reasons", "I9", _REASONS)
def _(t):
    return explain.reasons(decided(t)).select("merchant_id", F.array_join("reasons", " || ").alias("reasons"))


@query("risk_explanations", "I10", f"""WITH {FUSED} SELECT merchant_id, CASE WHEN status = 'HIGH' THEN 'Repeated strong visual matches were detected across multiple merchant assets and corroborated by independent external evidence.'
  WHEN status_tier = 'ELEVATED' THEN 'Multiple visual anomalies were detected across independent signals. Evidence is meaningful but conditional approval with monitoring is recommended.'
  WHEN status = 'MEDIUM' THEN 'Multiple visual similarities were detected, but the evidence is insufficient to establish meaningful reuse — enhanced verification recommended.'
  WHEN match_status = 'INSUFFICIENT_EVIDENCE' THEN 'One isolated visual similarity was detected, but no corroborating external evidence was found. Further human investigation may be warranted.'
  ELSE 'No significant visual anomalies detected. Visual content appears consistent and proprietary to this merchant.' END AS risk_explanation FROM fused""")
def _(t):
    return explain.risk_explanation(decided(t)).select("merchant_id", "risk_explanation")


@query("decision_diagnostics", "I11", f"""WITH {FUSED} SELECT merchant_id, image_count, {sql_round('average_similarity', 4)} AS average_similarity, {sql_round('max_similarity', 4)} AS max_similarity,
  {sql_round('top_k_similarity', 4)} AS top_k_similarity, strong_match_count, moderate_match_count, e1_score, e4_score, logo_risk AS logo_score, manipulation_score,
  coherence_score AS identity_score, visual_risk_score AS visual_score, final_score, status AS final_risk_level, match_status AS evidence_status FROM fused""")
def _(t):
    return explain.debug_metrics(decided(t))


# ---- evidence, claims, conclusions ------------------------------------------------

EVIDENCE = f"""
s AS (SELECT *, source_type <> 'SOFT_TRUST' OR max_similarity > 0.2 AS has_top, coalesce(nullif(source_domain, ''), 'public-web-source.com') AS dom,
  coalesce(matched_logo, 'Registered Brand Identity') AS lname, 100::DOUBLE - coherence_score AS disp, max_similarity * 100::DOUBLE AS sim100 FROM v_signal),
evidence AS (
 SELECT merchant_id, 'image_reuse' AS evidence_type, {sql_round('sim100', 1)} AS score, {sql_pct('max_similarity')} AS similarity_pct,
  CASE WHEN max_similarity >= 0.85 THEN 'HIGH' WHEN max_similarity >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN max_similarity >= 0.85 THEN 'CONTRADICTS' WHEN max_similarity >= 0.70 THEN 'REQUIRES_VERIFICATION' ELSE 'SUPPORTS' END AS relationship,
  source_type, 'https://catalog-archive.internal/assets/' || coalesce(reference_filename, 'ref_catalog.jpg') AS source_url, dom AS source_domain, reference_filename AS matched_reference_name,
  CASE WHEN max_similarity >= 0.85 THEN format('Merchant product imagery strongly matches a candidate visual found on {{}} ({{}}% ViT similarity).', dom, {sql_pct('max_similarity')})
   WHEN max_similarity >= 0.70 THEN format('Merchant product imagery exhibits moderate visual commonalities with a candidate on {{}} ({{}}% ViT similarity).', dom, {sql_pct('max_similarity')})
   ELSE format('No significant visual reuse detected. Product images appear original ({{}}% highest candidate match).', {sql_pct('max_similarity')}) END AS explanation FROM s WHERE has_top
 UNION ALL SELECT merchant_id, 'logo_consistency', logo_risk, {sql_pct('logo_similarity')}, CASE WHEN logo_similarity < 0.55 THEN 'HIGH' WHEN logo_similarity < 0.82 THEN 'MEDIUM' ELSE 'LOW' END,
  CASE WHEN logo_similarity < 0.55 THEN 'CONTRADICTS' WHEN logo_similarity < 0.82 THEN 'REQUIRES_VERIFICATION' ELSE 'SUPPORTS' END, 'LOCAL_DEMO', 'https://brand-registry.internal/logos/' || lname, 'brand-registry.internal', lname,
  CASE WHEN logo_similarity < 0.55 THEN format('Merchant logo demonstrates low visual consistency ({{}}%) with verified {{}} identity.', {sql_pct('logo_similarity')}, lname)
   WHEN logo_similarity < 0.82 THEN format('Merchant logo exhibits moderate stylistic variance ({{}}% match) against verified {{}} identity.', {sql_pct('logo_similarity')}, lname)
   ELSE format('Merchant logo demonstrates strong visual alignment ({{}}%) with verified {{}} identity.', {sql_pct('logo_similarity')}, lname) END FROM s
 UNION ALL SELECT merchant_id, 'manipulation', manipulation_score, {sql_whole('manipulation_score')}, CASE WHEN manipulation_score >= 60 THEN 'HIGH' WHEN manipulation_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END,
  CASE WHEN manipulation_score >= 60 THEN 'CONTRADICTS' WHEN manipulation_score >= 35 THEN 'REQUIRES_VERIFICATION' ELSE 'SUPPORTS' END, 'LOCAL_DEMO', NULL, 'forensic-pixel-pipeline', NULL,
  CASE WHEN manipulation_score >= 60 THEN 'Manipulation indicators detected (' || manipulation_score || '% anomaly score). Localized compression and edge-frequency anomalies observed.'
   WHEN manipulation_score >= 35 THEN 'Moderate forensic anomalies detected (' || manipulation_score || '% anomaly score). Minor compression artifacts or multi-layer graphics detected.'
   ELSE 'Document visual displays uniform compression and natural pixel distributions (' || manipulation_score || '% score).' END FROM s
 UNION ALL SELECT merchant_id, 'synthetic_signal', synthetic_score, {sql_whole('synthetic_score')}, CASE WHEN synthetic_score >= 60 THEN 'MEDIUM' ELSE 'LOW' END,
  CASE WHEN synthetic_score >= 60 THEN 'REQUIRES_VERIFICATION' ELSE 'NEUTRAL' END, 'LOCAL_DEMO', NULL, 'spectral-frequency-analyzer', NULL,
  CASE WHEN synthetic_score >= 60 THEN 'Elevated synthetic/AI-generation markers detected (' || synthetic_score || '%). Supporting signal only.'
   ELSE 'Natural photographic frequency and chromatic signatures observed (' || synthetic_score || '% score).' END FROM s
 UNION ALL SELECT merchant_id, 'visual_identity', {sql_round('disp', 1)}, {sql_whole('coherence_score')}, CASE WHEN coherence_score < 25 THEN 'HIGH' WHEN coherence_score < 45 THEN 'MEDIUM' ELSE 'LOW' END,
  CASE WHEN coherence_score < 25 THEN 'CONTRADICTS' WHEN coherence_score < 45 THEN 'REQUIRES_VERIFICATION' ELSE 'SUPPORTS' END, 'LOCAL_DEMO', NULL, 'catalog-coherence-analyzer', NULL,
  format('Merchant product catalog {{}} internal visual consistency ({{}}% coherence).', CASE WHEN coherence_score < 25 THEN 'displays low' WHEN coherence_score < 45 THEN 'displays moderate' ELSE 'shows strong' END, CAST(trunc(coherence_score) AS INT)) FROM s)"""


def evidence(t: Tables) -> DataFrame:
    wide = t.view("v_signal").withColumns(
        {
            "has_top": (F.col("source_type") != "SOFT_TRUST") | (F.col("max_similarity") > 0.2),
            "top_similarity": F.col("max_similarity"),
            "top_source_type": F.col("source_type"),
            "top_source_domain": F.col("source_domain"),
            "top_source_url": F.lit(None).cast("string"),
            "top_filename": F.col("reference_filename"),
        }
    )
    return explain.structured_evidence(wide)


@query("structured_evidence", "I12", f"""WITH {EVIDENCE} SELECT merchant_id, evidence_type, score, similarity_pct, severity, relationship, source_type, source_url, source_domain, matched_reference_name, explanation FROM evidence""")
def _(t):
    return evidence(t).drop("title", "evidence_strength")


_CLAIM_STATUS = """CASE WHEN crawl_status = 'ROBOTS_DISALLOWED' THEN 'COMPLIANCE_LIMITED' WHEN crawl_status = 'BOT_BLOCKED' THEN 'BOT_BLOCKED'
  WHEN crawl_status = 'TIMEOUT' THEN 'UNVERIFIABLE' WHEN crawl_status = 'REDIRECT_LIMIT_EXCEEDED' THEN 'REDIRECT_LIMIT_EXCEEDED' WHEN n_products > 9 THEN 'HIGH' WHEN n_products > 5 THEN 'MEDIUM' ELSE 'LOW' END"""


def claims(t: Tables) -> DataFrame:
    return t.view("v_crawl").select(
        "merchant_id",
        F.expr(_CLAIM_STATUS).alias("status"),
        F.expr("CASE WHEN n_products % 2 = 0 THEN concat('Stock of ', merchant_name) END").alias("inventory_claim"),
        F.expr("CASE WHEN n_products % 3 = 0 THEN concat('Brand ', merchant_name) END").alias("brand_claim"),
        F.lit(None).cast("string").alias("compliance_claim"),
    )


def _suspended(pick: str, i: int, default: str) -> str:
    out = "CASE status"
    for s, e in explain.SUSPENDED_CLAIMS.items():
        value = {"claim": e[3][i][0], "summary": e[3][i][1], "severity": e[0], "domain": e[1],
                 "label": ["ViT Similarity: N/A", "Logo Consistency: N/A", "Forensics: N/A"][i] + (e[2] if i < 2 else "")}[pick]
        out += f" WHEN '{s}' THEN {sql_text(value)}"
    return out + f" ELSE {default} END"


def _claim_sql(i: int) -> str:
    dim, col, default, kind, missing, head, tail = explain.CLAIM_DIMENSIONS[i]
    doc_domain = "'forensic-pixel-pipeline'" if i == 2 else "NULL"
    return f"""SELECT c.merchant_id, {sql_text(dim)} AS dimension, coalesce(c.{col}, {_suspended('claim', i, sql_text(default))}) AS claim,
 coalesce(e.explanation, {_suspended('summary', i, sql_text(missing))}) AS evidence_summary,
 coalesce(e.relationship, CASE WHEN susp THEN 'REQUIRES_VERIFICATION' ELSE 'NEUTRAL' END) AS relationship,
 coalesce(e.severity, {_suspended('severity', i, "'LOW'")}) AS severity,
 coalesce({sql_text(head)} || e.similarity_pct || '%', {_suspended('label', i, sql_text(tail))}) AS score_label,
 coalesce(e.source_type, CASE WHEN susp THEN 'ONLINE' ELSE 'LOCAL_DEMO' END) AS source_type, {'NULL' if i == 2 else 'e.source_url'} AS source_url,
 coalesce(e.source_domain, {_suspended('domain', i, doc_domain)}) AS source_domain
 FROM cl c LEFT JOIN evidence e ON e.merchant_id = c.merchant_id AND e.evidence_type = '{kind}' AND NOT c.susp"""


_CLAIMS = f"""cl AS (SELECT merchant_id, {_CLAIM_STATUS} AS status, CASE WHEN n_products % 2 = 0 THEN concat('Stock of ', merchant_name) END AS inventory_claim,
 CASE WHEN n_products % 3 = 0 THEN concat('Brand ', merchant_name) END AS brand_claim, NULL::VARCHAR AS compliance_claim,
 {_CLAIM_STATUS} IN ('COMPLIANCE_LIMITED', 'BOT_BLOCKED', 'UNVERIFIABLE') AS susp FROM v_crawl)"""


@query("claim_evidence_matrix", "I13", f"WITH {EVIDENCE}, {_CLAIMS} {_claim_sql(0)} UNION ALL {_claim_sql(1)} UNION ALL {_claim_sql(2)}")
def _(t):
    return explain.claim_matrix(claims(t), evidence(t))


_CONCLUSION = lambda i: " ".join(f"WHEN status = '{s}' THEN {sql_text(e[i])}" for s, e in explain.SUSPENDED_CONCLUSIONS.items())


@query("claim_conclusions", "I14", f"""WITH {EVIDENCE}, {_CLAIMS},
cnt AS (SELECT merchant_id, count(*) FILTER (relationship = 'CONTRADICTS') AS con, count(*) FILTER (relationship = 'REQUIRES_VERIFICATION') AS ver, count(*) FILTER (relationship = 'SUPPORTS') AS sup FROM evidence GROUP BY 1)
SELECT cl.merchant_id, status, CASE {_CONCLUSION(0)}
 WHEN status = 'HIGH' AND con >= 2 THEN 'Multiple independent visual signals are inconsistent with the merchant''s stated identity.'
 WHEN status = 'HIGH' THEN 'Critical visual evidence conflicts with merchant assertions and requires senior review.'
 WHEN status = 'MEDIUM' AND con >= 1 THEN 'Visual evidence displays significant inconsistencies and unverified anomalies relative to merchant claims.'
 WHEN status = 'MEDIUM' AND ver >= 2 THEN 'Multiple visual signals require additional verification before merchant onboarding approval.'
 WHEN status = 'MEDIUM' THEN 'Visual evidence displays moderate anomalies requiring merchant documentation verification.'
 WHEN ver >= 1 THEN 'Visual evidence is largely consistent with merchant claims, with isolated low-risk anomalies.'
 ELSE 'Visual evidence strongly supports the merchant''s stated identity and product claims.' END AS conclusion,
 CASE {_CONCLUSION(1)} WHEN status = 'HIGH' THEN 'HIGH → MANUAL REVIEW: Route to Senior Risk Operations for manual visual evidence audit.'
 WHEN status = 'MEDIUM' THEN 'MEDIUM → ADDITIONAL VERIFICATION: Request merchant brand authorization documentation and high-res inventory proof.'
 ELSE 'LOW → NORMAL ONBOARDING: Standard merchant onboarding flow with automated background monitoring.' END AS final_recommendation,
 CAST(CASE WHEN susp THEN 0 ELSE con END AS INT) AS contradiction_count, CAST(CASE WHEN susp THEN 3 ELSE ver END AS INT) AS verification_count, CAST(CASE WHEN susp THEN 0 ELSE sup END AS INT) AS support_count
FROM cl JOIN cnt ON cl.merchant_id = cnt.merchant_id""")
def _(t):
    return explain.conclusions(claims(t), evidence(t))


@query("analysis_provenance", "I15", f"""WITH {EVIDENCE},
src AS (SELECT merchant_id, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS sources FROM evidence GROUP BY 1)
SELECT v.merchant_id, CASE WHEN region_count = 1 THEN 'Fallback Color/Texture Extractor' ELSE 'Vision Transformer (ViT-B/16)' END AS vision_model, region_count = 1 AS is_fallback_extractor,
 image_count + CASE WHEN matched_logo IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN region_count = 2 THEN 1 ELSE 0 END AS images_analyzed, strong_match_count AS online_evidence_candidates, sources AS evidence_sources
FROM v_signal v JOIN src ON src.merchant_id = v.merchant_id""")
def _(t):
    wide = t.view("v_signal").select(
        "merchant_id",
        F.col("image_count").alias("n_products"),
        F.col("matched_logo").isNotNull().alias("has_logo"),
        (F.col("region_count") == 2).alias("has_document"),
        F.col("strong_match_count").alias("n_candidates"),
        (F.col("region_count") == 1).alias("is_fallback_extractor"),
    )
    out = explain.provenance(wide, evidence(t))
    return out.withColumn("evidence_sources", F.array_join("evidence_sources", ","))


@query("merchant_fingerprint", "I16", f"""WITH {FUSED},
a AS (SELECT merchant_id, coherence_score, max_similarity, logo_risk, reuse_risk_score, manipulation_score, final_score, status_tier, FALSE AS unv FROM fused
 UNION ALL SELECT merchant_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM business WHERE failed)
SELECT merchant_id, CAST(floor(CASE WHEN coherence_score <= 1 THEN coherence_score * 100 ELSE coherence_score END + 0.5) AS INT) AS image_consistency,
 CASE WHEN max_similarity IS NOT NULL THEN greatest(0, CAST(floor((1::DOUBLE - max_similarity) * 100::DOUBLE + 0.5::DOUBLE) AS INT)) END AS visual_originality,
 CASE WHEN logo_risk IS NOT NULL THEN greatest(0, CAST(floor(100 - logo_risk + 0.5) AS INT)) END AS logo_consistency,
 CAST(floor(reuse_risk_score + 0.5) AS INT) AS reuse_exposure, CAST(floor(manipulation_score + 0.5) AS INT) AS manipulation_indicators,
 CASE WHEN final_score IS NULL THEN NULL WHEN unv THEN 0 WHEN status_tier IN ('HIGH', 'CLEAR') THEN 90 WHEN status_tier = 'MEDIUM' THEN 72 WHEN status_tier = 'LOW' THEN 60 ELSE 55 END AS evidence_confidence FROM a""")
def _(t):
    cols = ["merchant_id", "coherence_score", "max_similarity", "logo_risk", "reuse_risk_score", "manipulation_score",
            "final_score", "status_tier", "is_unverifiable"]
    scored = decided(t).withColumn("is_unverifiable", F.lit(False)).select(cols)
    failed = explain.unverifiable_decision(failed_crawls(t)).select(
        "merchant_id", "final_score", "status_tier", "is_unverifiable"
    )
    return explain.fingerprint(scored.unionByName(failed, allowMissingColumns=True))


_SIGNAL_BASE = """z AS (SELECT *, source_type IN ('SUPPLIER_CATALOG', 'MARKETPLACE') AS sup,
 reuse_risk_score >= 70 AND source_type NOT IN ('SUPPLIER_CATALOG', 'MARKETPLACE') AND match_status = 'CORROBORATED_EXTERNAL_MATCH' AS act, CAST(floor(coherence_score + 0.5) AS INT) AS coh FROM v_signal)"""


@query("decision_signals", "I17", f"""WITH {_SIGNAL_BASE}
SELECT merchant_id, 'image_reuse' AS signal_id, 'ViT cosine similarity: ' || CAST(floor(max_similarity * 100::DOUBLE + 0.5::DOUBLE) AS INT) || '%' AS detail,
 CASE WHEN sup THEN 'Source classified as supplier/catalog — excluded from severe escalation.' WHEN match_status IN ('INSUFFICIENT_EVIDENCE', 'NO_EXTERNAL_MATCH') THEN 'Single fixture match — insufficient corroboration for escalation.'
  WHEN match_status = 'CORROBORATED_EXTERNAL_MATCH' THEN 'Multi-source corroborated evidence.' ELSE 'Evidence status: ' || regexp_replace(match_status, '_', ' ') END AS context,
 act AS active, sup AS suppressed, CASE WHEN act THEN 'high' WHEN sup THEN 'low' WHEN max_similarity > 0.8 THEN 'medium' ELSE 'low' END AS severity,
 CASE WHEN act THEN 'Contributed to HIGH escalation' WHEN sup THEN 'Excluded — supplier sourcing' ELSE 'Insufficient evidence for escalation' END AS contribution FROM z WHERE max_similarity > 0.3 OR reuse_risk_score > 10
UNION ALL SELECT merchant_id, 'logo_divergence', format('Brand mark similarity: {{}}% (risk: {{}}%)', CAST(floor(logo_similarity * 100::DOUBLE + 0.5::DOUBLE) AS INT), CAST(floor(logo_risk + 0.5) AS INT)),
 CASE WHEN matched_logo IS NOT NULL THEN 'Compared against verified brand asset: ' || replace(replace(matched_logo, 'verified_brand_', ''), '.png', '') ELSE 'No registered brand mark matched.' END,
 logo_risk >= 60, FALSE, CASE WHEN logo_risk >= 60 THEN 'high' WHEN logo_risk > 30 THEN 'medium' ELSE 'low' END,
 CASE WHEN logo_risk >= 60 THEN 'Triggered severe signal — logo divergence ≥ 60%' ELSE 'Logo within acceptable tolerance' END FROM z WHERE matched_logo IS NOT NULL OR logo_risk > 15
UNION ALL SELECT merchant_id, 'forensic_manipulation', format('Compression anomaly score: {{}}% — {{}} risk', CAST(floor(manipulation_score + 0.5) AS INT), manipulation_level),
 CASE WHEN region_count > 0 THEN region_count || ' localized gradient anomaly region(s) detected.' ELSE 'Uniform compression coefficient — no localized splicing detected.' END,
 manipulation_score >= 60, FALSE, CASE WHEN manipulation_score >= 60 THEN 'high' WHEN manipulation_score > 20 THEN 'medium' ELSE 'low' END,
 CASE WHEN manipulation_score >= 60 THEN 'Tampered document — severe signal' ELSE 'No significant manipulation detected' END FROM z
UNION ALL SELECT merchant_id, 'identity_coherence', 'Catalog coherence: ' || CASE WHEN coherence_score <= 1 THEN CAST(floor(coherence_score * 100 + 0.5) AS INT) ELSE coh END || '%',
 CASE WHEN (CASE WHEN coherence_score <= 1 THEN coherence_score * 100 ELSE coh END) < 50 THEN 'Mixed visual styles suggest possible catalog stitching from multiple unrelated sources.' ELSE 'Visual style is consistent across extracted product catalog.' END,
 FALSE, FALSE, CASE WHEN (CASE WHEN coherence_score <= 1 THEN coherence_score * 100 ELSE coh END) < 50 THEN 'medium' ELSE 'low' END, 'Informational — does not independently drive escalation' FROM z""")
def _(t):
    return explain.decision_signals(t.view("v_signal")).drop("label")


@query("tier_explanations", "I17", f"""WITH {FUSED},
c AS (SELECT *, CAST((max_similarity > 0.3 OR reuse_risk_score > 10) AND reuse_risk_score >= 70 AND NOT is_supplier AND match_status = 'CORROBORATED_EXTERNAL_MATCH' AS INT) + CAST(logo_risk >= 60 AS INT) + CAST(manipulation_score >= 60 AS INT) AS sev,
  CAST((max_similarity > 0.3 OR reuse_risk_score > 10) AND is_supplier AS INT) AS supp FROM fused)
SELECT merchant_id, sev AS severe_signals, supp AS suppressed_signals, CASE WHEN status_tier = 'HIGH' THEN sev || ' independently corroborated severe signals satisfied escalation threshold (≥ 2 required).'
 WHEN status_tier = 'MEDIUM' THEN sev || ' severe signal detected. Enhanced verification triggered. A 2nd corroborated signal is required for HIGH escalation.'
 WHEN status_tier = 'LOW' AND sev = 0 AND supp > 0 THEN 'Strong visual matches found, but all originate from supplier/catalog sources — excluded from escalation by safety policy.'
 WHEN status_tier = 'LOW' AND final_score > 20 THEN 'Visual signals detected but insufficient corroboration for escalation. Single uncorroborated matches are intentionally bounded at LOW to protect legitimate resellers.'
 ELSE 'No suspicious visual evidence detected. Merchant approved for standard onboarding.' END AS tier_explanation FROM c
UNION ALL SELECT merchant_id, 0, 0, 'Domain unreachable. Scoring suspended — no evidence available.' FROM business WHERE failed""")
def _(t):
    cols = ["merchant_id", "reuse_risk_score", "max_similarity", "source_type", "match_status", "logo_risk",
            "manipulation_score", "status_tier", "status", "final_score", "is_unverifiable"]
    scored = decided(t).withColumn("is_unverifiable", F.lit(False)).select(cols)
    failed = explain.unverifiable_decision(failed_crawls(t)).select(
        "merchant_id", "status_tier", "status", "final_score", "is_unverifiable"
    )
    return explain.tier_explanation(scored.unionByName(failed, allowMissingColumns=True))


@query("unverifiable_subscores", "I19", f"""WITH {BUSINESS}
SELECT merchant_id, crawl_status, NULL::DOUBLE AS visual_risk_score, 'UNAVAILABLE' AS visual_risk_level, 'MANUAL_REVIEW' AS visual_action,
 format('Visual risk analysis suspended ({{}}). No merchant visual assets were retrieved.', crawl_status) AS visual_summary,
 NULL::DOUBLE AS reuse_risk_score, NULL::DOUBLE AS max_similarity, 'NO_DATA' AS match_status, TRUE AS is_own_brand, 0 AS images_analyzed FROM business WHERE failed""")
def _(t):
    return explain.unverifiable_subscores(failed_crawls(t)).select(
        "merchant_id", "crawl_status", "visual_risk_score", "visual_risk_level", "visual_action", "visual_summary",
        "reuse_risk_score", "max_similarity", "match_status", "is_own_brand", "images_analyzed",
    )
