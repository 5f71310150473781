"""Decisions without scores, reasons, structured evidence and claim matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ladders import count_true, ladder, score_text, text
from ..functions.rounding import clip, exact_round, percent, round_columns, whole

# The four states a failed crawl can end in.
# status -> (crawl_status, label, recommendation, badge, reasons, default error)
UNVERIFIABLE = {
    "COMPLIANCE_LIMITED": (
        "ROBOTS_DISALLOWED",
        "COMPLIANCE-LIMITED — ACCESS RESTRICTED PER POLICY",
        "Merchant site is active, but robots.txt restricts automated bot indexing. Evaluate merchant via manual analyst review or merchant-authorized integration.",
        "#2563eb",
        ("Robots.txt Policy: Automated crawling restricted by merchant domain (", ").", "target site"),
        "The merchant website is active and reachable, but enforces automated bot access restrictions per standard web standards.",
        "Automated visual evaluation suspended per web compliance policy — no negative risk inference.",
        "Robots.txt policy restricts automated crawler access.",
    ),
    "BOT_BLOCKED": (
        "BOT_BLOCKED",
        "COULD NOT VERIFY — ANTI-BOT PROTECTION (HTTP 403)",
        "Target site's anti-bot system (Cloudflare/PerimeterX/WAF) blocked automated scraper access. Review merchant manually or through direct merchant integration.",
        "#6366f1",
        ("Anti-Bot Protection: Target platform (", ") returned HTTP 403 / 429.", "merchant site"),
        "This does not indicate risk — many major legitimate platforms (Etsy, Amazon, etc.) deploy active WAF bot-protection.",
        "Automated crawler blocked by design — no negative risk inference.",
        "Anti-bot protection blocked automated access (HTTP 403).",
    ),
    "REDIRECT_LIMIT_EXCEEDED": (
        "REDIRECT_LIMIT_EXCEEDED",
        "UNVERIFIABLE — REDIRECT SAFETY LIMIT EXCEEDED",
        "Merchant site exceeded the safety redirect limit (3 hops), indicating a redirect loop, geo-block, or consent wall. Manual review required.",
        "#f59e0b",
        ("Redirect Limit Exceeded: Automated crawl aborted after exceeding 3 redirect hops on ", ".", "merchant site"),
        "Possible redirect loop, geographic redirection wall, or dynamic cookie consent loop.",
        "Automated visual scoring suspended — requires manual verification by Risk Operations.",
        "Crawl diagnostic: redirect chain exceeded safety limit of 3 hops.",
    ),
    "UNVERIFIABLE": (
        None,
        "UNVERIFIABLE — INSUFFICIENT EVIDENCE",
        "Merchant site was unreachable or returned errors (DNS/Network/HTTP). Automated visual verification cannot be performed. Manual risk investigation required.",
        "#64748b",
        ("Website Unreachable: ", ".", "Website crawl failed or domain could not be resolved"),
        "Zero visual assets could be extracted due to network/connectivity failure.",
        "Automated risk scoring suspended — requires manual website verification by Risk Operations.",
        None,
    ),
}


def _by_state(pick) -> Column:
    """Ladder over the failed-crawl states; ``pick`` maps (status, entry) to a value."""
    named = [(s, e) for s, e in UNVERIFIABLE.items() if e[0] is not None]
    default = UNVERIFIABLE["UNVERIFIABLE"]
    return ladder([(F.col("crawl_status") == e[0], pick(s, e)) for s, e in named], pick("UNVERIFIABLE", default))


def unverifiable_decision(df: DataFrame) -> DataFrame:
    """I4. Decision row for failed crawls: every score NULL, never a low-risk default.

    Needs ``crawl_status``, ``crawl_error``, ``domain``; apply to failed crawls only.
    """
    error = F.when(F.col("crawl_error") != "", F.col("crawl_error"))

    def first_reason(status, entry):
        before, after, fallback = entry[4]
        what = error if status == "UNVERIFIABLE" else F.col("domain")
        return text(before, F.coalesce(what, F.lit(fallback)), after)

    null_score = F.lit(None).cast("double")
    return df.withColumns(
        {
            "final_score": null_score,
            "text_risk_score": null_score,
            "visual_risk_score": null_score,
            "identity_coherence": null_score,
            "tampering_score": null_score,
            "status": _by_state(lambda s, e: s),
            "status_tier": F.lit(None).cast("string"),
            "status_label": _by_state(lambda s, e: e[1]),
            "recommendation": _by_state(lambda s, e: e[2]),
            "badge_color": _by_state(lambda s, e: e[3]),
            "reasons": F.array(
                _by_state(first_reason), _by_state(lambda s, e: e[5]), _by_state(lambda s, e: e[6])
            ),
            "is_unverifiable": F.lit(True),
            "is_compliance_limited": _by_state(lambda s, e: s == "COMPLIANCE_LIMITED"),
            "is_bot_blocked": _by_state(lambda s, e: s == "BOT_BLOCKED"),
            "is_redirect_limit_exceeded": _by_state(lambda s, e: s == "REDIRECT_LIMIT_EXCEEDED"),
            "crawl_error": F.coalesce(error, _by_state(lambda s, e: F.lit(e[7]).cast("string"))),
        }
    )


def unverifiable_subscores(df: DataFrame) -> DataFrame:
    """I19. Sub-score section of a failed crawl: NULL / UNAVAILABLE everywhere."""
    num = F.lit(None).cast("double")
    return df.select(
        "merchant_id",
        "crawl_status",
        num.alias("visual_risk_score"),
        F.lit("UNAVAILABLE").alias("visual_risk_level"),
        F.lit("MANUAL_REVIEW").alias("visual_action"),
        text("Visual risk analysis suspended (", F.col("crawl_status"), "). No merchant visual assets were retrieved.").alias("visual_summary"),
        num.alias("coherence_score"),
        F.lit("UNAVAILABLE").alias("coherence_level"),
        num.alias("logo_similarity"),
        num.alias("logo_risk"),
        F.lit("UNAVAILABLE").alias("logo_level"),
        num.alias("manipulation_score"),
        num.alias("synthetic_score"),
        F.lit("UNAVAILABLE").alias("manipulation_level"),
        num.alias("max_similarity"),
        num.alias("reuse_risk_score"),
        F.lit("UNAVAILABLE").alias("reuse_level"),
        F.lit(True).alias("is_own_brand"),
        F.lit("NO_DATA").alias("match_status"),
        F.lit(0).alias("images_analyzed"),
        F.lit(0).alias("candidates"),
    )


def reasons(df: DataFrame) -> DataFrame:
    """I9. Explanation bullets as an array, plus two reassurances when nothing stands out.

    Needs ``text_in``, ``max_similarity``, ``is_own_brand``, ``source_type``,
    ``source_domain``, ``masked_ids`` (array), ``reference_filename``,
    ``logo_similarity``, ``matched_logo``, ``manipulation_score``,
    ``synthetic_score``, ``coherence_score``.
    """
    none = F.lit(None).cast("string")
    sim = F.coalesce(F.col("max_similarity"), F.lit(0.0))
    masked = F.when(F.size(F.coalesce(F.col("masked_ids"), F.array().cast("array<string>"))) > 0,
                    F.array_join("masked_ids", ", "))
    present = lambda c: F.when(F.col(c) != "", F.col(c))
    source = F.coalesce(masked, present("source_domain"), present("reference_filename"), F.lit("external web source"))
    own = F.coalesce(F.col("is_own_brand"), F.lit(False))
    soft = F.coalesce(F.col("source_type").isin("SUPPLIER_CATALOG", "MARKETPLACE", "SOFT_TRUST"), F.lit(False))
    logo = F.coalesce(F.col("logo_similarity"), F.lit(1.0))
    manip = F.coalesce(F.col("manipulation_score"), F.lit(0.0))
    synth = F.coalesce(F.col("synthetic_score"), F.lit(0.0))
    coherence = F.coalesce(F.col("coherence_score"), F.lit(70.0))
    has_logo = F.coalesce(F.col("matched_logo"), F.lit("")) != ""
    bullets = [
        F.when(F.col("text_in") >= 70.0, "Merchant website lacks critical business disclosures (contact channels, return policy, and business entity info)."),
        ladder(
            [
                (own, "No external visual matches discovered online — visual content appears unique and proprietary to this merchant."),
                (soft & (sim >= 0.70), text("Product imagery matches supplier/distributor catalog on ", source, " (", percent(sim), "% ViT similarity) — consistent with authorized reseller sourcing, not misrepresentation.")),
                (sim >= 0.85, text("Product imagery strongly matches candidate visual (", percent(sim), "% ViT similarity with ", source, ") — Potential Visual Misrepresentation.")),
                (sim >= 0.70, text("Product imagery exhibits moderate visual similarity (", percent(sim), "%) to candidate on ", source, ".")),
            ],
            none,
        ),
        ladder(
            [
                ((logo < 0.55) & has_logo, text("Merchant logo significantly diverges (", percent(logo), "% match) from verified ", F.col("matched_logo"), " identity.")),
                ((logo < 0.80) & has_logo, text("Merchant logo demonstrates moderate stylistic variance (", percent(logo), "%) against verified ", F.col("matched_logo"), " assets.")),
            ],
            none,
        ),
        ladder(
            [
                (manip >= 60.0, text("Visual assets contain high localized compression and splicing indicators (Forensic score: ", score_text(manip), "%).")),
                (manip >= 35.0, text("Moderate image recompression and gradient variance indicators detected (Forensic score: ", score_text(manip), "%).")),
            ],
            none,
        ),
        F.when(synth >= 60.0, text("Elevated synthetic/AI-generation markers observed in product imagery (", score_text(synth), "% suspicion — supporting signal only).")),
        F.when(coherence < 35.0, text("Merchant's product visuals display low internal style coherence (", whole(coherence), "% consistency — images may originate from disconnected external catalogs).")),
    ]
    df = df.withColumn("flags", F.array_compact(F.array(*bullets)))
    calm = (F.size("flags") == 0) | ((F.size("flags") == 1) & own)
    return df.withColumn(
        "reasons",
        F.when(
            calm,
            F.concat(
                F.col("flags"),
                F.array(
                    F.lit("Visual evidence is internally consistent and matches claimed merchant branding."),
                    F.lit("No document tampering, forensic anomalies, or deceptive signals detected."),
                ),
            ),
        ).otherwise(F.col("flags")),
    ).drop("flags")


def risk_explanation(df: DataFrame) -> DataFrame:
    """I10. One-sentence explanation of the tier."""
    return df.withColumn(
        "risk_explanation",
        ladder(
            [
                (F.col("status") == "HIGH", "Repeated strong visual matches were detected across multiple merchant assets and corroborated by independent external evidence."),
                (F.col("status_tier") == "ELEVATED", "Multiple visual anomalies were detected across independent signals. Evidence is meaningful but conditional approval with monitoring is recommended."),
                (F.col("status") == "MEDIUM", "Multiple visual similarities were detected, but the evidence is insufficient to establish meaningful reuse — enhanced verification recommended."),
                (F.col("evidence_status") == "INSUFFICIENT_EVIDENCE", "One isolated visual similarity was detected, but no corroborating external evidence was found. Further human investigation may be warranted."),
            ],
            "No significant visual anomalies detected. Visual content appears consistent and proprietary to this merchant.",
        ),
    )


def debug_metrics(df: DataFrame) -> DataFrame:
    """I11. Diagnostics of one decision as flat columns, rounded for publication."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = df.select(
        "merchant_id",
        F.coalesce(F.col("image_count"), F.lit(0)).alias("image_count"),
        zero("average_similarity").alias("average_similarity"),
        zero("max_similarity").alias("max_similarity"),
        zero("top_k_similarity").alias("top_k_similarity"),
        F.coalesce(F.col("strong_match_count"), F.lit(0)).alias("strong_match_count"),
        F.coalesce(F.col("moderate_match_count"), F.lit(0)).alias("moderate_match_count"),
        F.col("e1_score"),
        zero("e4_score").alias("e4_score"),
        zero("logo_risk").alias("logo_score"),
        zero("manipulation_score").alias("manipulation_score"),
        F.coalesce(F.col("coherence_score"), F.lit(70.0)).alias("identity_score"),
        F.col("visual_in").alias("visual_score"),
        "final_score",
        F.col("status").alias("final_risk_level"),
        "evidence_status",
    )
    return round_columns(
        out,
        {
            "average_similarity": 4, "max_similarity": 4, "top_k_similarity": 4, "e1_score": 1, "e4_score": 1,
            "logo_score": 1, "manipulation_score": 1, "identity_score": 1, "visual_score": 1,
        },
    )


def structured_evidence(df: DataFrame) -> DataFrame:
    """I12. Five evidence rows per merchant (image reuse only where a candidate exists).

    Needs ``has_top``, ``top_similarity``, ``top_source_type``, ``top_source_domain``,
    ``top_source_url``, ``top_filename`` and the logo, manipulation, synthetic and
    coherence columns. A single ``explode`` of an array of structs: no shuffle.
    """
    none = F.lit(None).cast("string")
    # 1. image reuse
    sim = F.coalesce(F.col("top_similarity"), F.lit(0.0))
    src = F.coalesce(F.col("top_source_type"), F.lit("LOCAL_DEMO"))
    present = lambda c: F.when(F.col(c) != "", F.col(c))
    domain = F.coalesce(
        present("top_source_domain"),
        F.when(src == "LOCAL_DEMO", "archive.merchant-catalog.org").otherwise("public-web-source.com"),
    )
    url = F.coalesce(
        present("top_source_url"),
        text("https://catalog-archive.internal/assets/", F.coalesce(F.col("top_filename"), F.lit("ref_catalog.jpg"))),
    )
    # 2..5
    logo = F.coalesce(F.col("logo_similarity"), F.lit(1.0))
    logo_name = F.coalesce(present("matched_logo"), F.lit("Registered Brand Identity"))
    manip = F.coalesce(F.col("manipulation_score"), F.lit(0.0))
    synth = F.coalesce(F.col("synthetic_score"), F.lit(10.0))
    coherence = F.coalesce(F.col("coherence_score"), F.lit(85.0))

    def bands(first: Column, second: Column, texts: tuple, relations=("CONTRADICTS", "REQUIRES_VERIFICATION", "SUPPORTS"),
              levels=("HIGH", "MEDIUM", "LOW")) -> dict[str, Column]:
        step = lambda values: ladder([(first, values[0]), (second, values[1])], values[2])
        return {"relationship": step(relations), "severity": step(levels), "strength": step(levels), "explanation": step(texts)}

    def row(kind, title, score, pct, b, source_type, source_url, source_domain, reference):
        return F.struct(
            F.lit(kind).alias("evidence_type"),
            F.lit(title).alias("title"),
            score.alias("score"),
            pct.alias("similarity_pct"),
            b["severity"].alias("severity"),
            b["relationship"].alias("relationship"),
            source_type.alias("source_type"),
            source_url.alias("source_url"),
            source_domain.alias("source_domain"),
            reference.alias("matched_reference_name"),
            b["explanation"].alias("explanation"),
            b["strength"].alias("evidence_strength"),
        )

    local = F.lit("LOCAL_DEMO")
    reuse = bands(
        sim >= 0.85, sim >= 0.70,
        (
            text("Merchant product imagery strongly matches a candidate visual found on ", domain, " (", percent(sim), "% ViT similarity)."),
            text("Merchant product imagery exhibits moderate visual commonalities with a candidate on ", domain, " (", percent(sim), "% ViT similarity)."),
            text("No significant visual reuse detected. Product images appear original (", percent(sim), "% highest candidate match)."),
        ),
    )
    brand = bands(
        logo < 0.55, logo < 0.82,
        (
            text("Merchant logo demonstrates low visual consistency (", percent(logo), "%) with verified ", logo_name, " identity."),
            text("Merchant logo exhibits moderate stylistic variance (", percent(logo), "% match) against verified ", logo_name, " identity."),
            text("Merchant logo demonstrates strong visual alignment (", percent(logo), "%) with verified ", logo_name, " identity."),
        ),
    )
    forensic = bands(
        manip >= 60.0, manip >= 35.0,
        (
            text("Manipulation indicators detected (", score_text(manip), "% anomaly score). Localized compression and edge-frequency anomalies observed."),
            text("Moderate forensic anomalies detected (", score_text(manip), "% anomaly score). Minor compression artifacts or multi-layer graphics detected."),
            text("Document visual displays uniform compression and natural pixel distributions (", score_text(manip), "% score)."),
        ),
    )
    high_synth = synth >= 60.0
    synthetic = {
        "relationship": F.when(high_synth, "REQUIRES_VERIFICATION").otherwise("NEUTRAL"),
        "severity": F.when(high_synth, "MEDIUM").otherwise("LOW"),
        "strength": F.when(high_synth, "MEDIUM").otherwise("LOW"),
        "explanation": F.when(
            high_synth,
            text("Elevated synthetic/AI-generation markers detected (", score_text(synth), "%). Supporting signal only."),
        ).otherwise(text("Natural photographic frequency and chromatic signatures observed (", score_text(synth), "% score).")),
    }
    cut = coherence.cast("int")
    identity = bands(
        coherence < 25.0, coherence < 45.0,
        (
            text("Merchant product catalog displays low internal visual consistency (", cut, "% coherence)."),
            text("Merchant product catalog displays moderate internal visual consistency (", cut, "% coherence)."),
            text("Merchant product catalog shows strong internal visual consistency (", cut, "% coherence)."),
        ),
    )
    rows = F.array(
        row("image_reuse", "Product Visual Reuse", sim * F.lit(100.0), percent(sim), reuse, src, url, domain, F.col("top_filename")),
        row("logo_consistency", "Brand Identity Consistency", F.coalesce(F.col("logo_risk"), F.lit(0.0)), percent(logo), brand,
            local, text("https://brand-registry.internal/logos/", logo_name), F.lit("brand-registry.internal"), logo_name),
        row("manipulation", "Document & Visual Manipulation Indicators", manip, whole(manip), forensic, local, none,
            F.lit("forensic-pixel-pipeline"), none),
        row("synthetic_signal", "Synthetic-Image Suspicion (Supporting Signal)", synth, whole(synth), synthetic, local, none,
            F.lit("spectral-frequency-analyzer"), none),
        row("visual_identity", "Catalog Visual Identity Consistency", clip(F.lit(100.0) - coherence, 0.0, 100.0), whole(coherence),
            identity, local, none, F.lit("catalog-coherence-analyzer"), none),
    )
    keep = F.col("has_top") | (F.col("e.evidence_type") != "image_reuse")
    out = df.select("merchant_id", "has_top", F.explode(rows).alias("e")).filter(keep).select("merchant_id", "e.*")
    # the reuse and dispersion scores are published with one decimal, the others as computed
    rounded = out["evidence_type"].isin("image_reuse", "visual_identity")
    return out.withColumn("score", F.when(rounded, exact_round(F.col("score"), 1)).otherwise(F.col("score")))


# Claim dimensions, the evidence type behind each, and what to say without it.
CLAIM_DIMENSIONS = [
    # dimension, claim column, default claim, evidence type, no-evidence text, label with evidence, label without
    ("1. Inventory & Products", "inventory_claim", "Authentic proprietary inventory", "image_reuse",
     "No visual catalog match found.", "ViT Similarity: ", "ViT Similarity: 0%"),
    ("2. Brand Identity & Logo", "brand_claim", "Verified brand trademark", "logo_consistency",
     "Brand mark unverified.", "Logo Consistency: ", "Consistency: 100%"),
    ("3. Document Integrity & Compliance", "compliance_claim", "Statutory incorporation certificate", "manipulation",
     "No forensic anomalies observed.", "Manipulation Score: ", "Manipulation: 0%"),
]

# Claim rows of suspended evaluations.
# status -> (severity, source domain, suffix of the score labels, three (default claim, summary) pairs)
SUSPENDED_CLAIMS = {
    "COMPLIANCE_LIMITED": (
        "LOW", "robots.txt-restricted", " (Compliance Restricted)",
        [
            ("Active storefront — automated crawl restricted", "Automated visual inventory extraction was suspended in compliance with the merchant site's robots.txt policy."),
            ("Brand identity claim", "Brand assets could not be scraped due to robots.txt restrictions. No negative inference."),
            ("Robots.txt compliant site", "Merchant domain actively enforces robots.txt standards. Evaluated as a compliant, well-configured domain."),
        ],
    ),
    "BOT_BLOCKED": (
        "LOW", "anti-bot-protected", " (WAF Protected)",
        [
            ("Active storefront — anti-bot protected", "Automated inventory extraction was blocked by target platform's anti-bot/WAF protection (HTTP 403)."),
            ("Brand identity claim", "Brand assets could not be scraped due to target site's bot protection. No negative inference."),
            ("Anti-bot protected platform", "Target domain deploys active enterprise bot mitigation (Cloudflare / PerimeterX / WAF). Evaluated as a protected legitimate platform."),
        ],
    ),
    "UNVERIFIABLE": (
        "MEDIUM", "unreachable-host", "",
        [
            ("Unreachable website — no content extracted", "Cannot verify inventory or product imagery — website was unreachable or failed DNS/network resolution."),
            ("Unverified brand identity", "Cannot verify brand assets — no logo or visual brand artifacts could be retrieved."),
            ("Compliance disclosures unverifiable", "Statutory disclosures, terms, and contact channels could not be extracted due to connectivity failure."),
        ],
    ),
}

# Conclusion and recommendation of suspended evaluations.
SUSPENDED_CONCLUSIONS = {
    "COMPLIANCE_LIMITED": (
        "Merchant website is live and well-configured, but enforces robots.txt automated access restrictions.",
        "COMPLIANCE-LIMITED → MANUAL REVIEW: Review merchant via manual analyst review or merchant-authorized data sharing.",
    ),
    "BOT_BLOCKED": (
        "Target website anti-bot protection blocked automated access (HTTP 403). This does not indicate risk.",
        "COULD NOT VERIFY → MANUAL REVIEW: Review merchant via manual analyst verification or direct platform integration.",
    ),
    "UNVERIFIABLE": (
        "Merchant website could not be reached or verified. Automated evidence collection was suspended.",
        "UNVERIFIABLE → MANUAL REVIEW: Confirm merchant domain resolution and request manual URL & business verification.",
    ),
}


def claim_matrix(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """I13. Three claim rows per merchant beside the evidence that supports or contradicts them.

    ``claims``: merchant_id, status, inventory_claim, brand_claim, compliance_claim.
    ``evidence``: output of :func:`structured_evidence`. One equi-join on
    (merchant_id, evidence_type); suspended merchants never reach the join keys.
    """
    suspended = F.coalesce(F.col("status").isin(list(SUSPENDED_CLAIMS)), F.lit(False))
    label_heads = ["ViT Similarity: N/A", "Logo Consistency: N/A", "Forensics: N/A"]
    structs = []
    for i, (dimension, column, default, kind, no_evidence, head, tail) in enumerate(CLAIM_DIMENSIONS):
        per_state = lambda pick, other: ladder(
            [(F.col("status") == s, pick(e)) for s, e in SUSPENDED_CLAIMS.items()], other
        )
        structs.append(
            F.struct(
                F.lit(dimension).alias("dimension"),
                F.coalesce(F.col(column), per_state(lambda e: e[3][i][0], default)).alias("claim"),
                F.when(~suspended, F.lit(kind)).alias("evidence_type"),
                per_state(lambda e: e[3][i][1], no_evidence).alias("fallback_summary"),
                per_state(lambda e: "REQUIRES_VERIFICATION", "NEUTRAL").alias("fallback_relationship"),
                per_state(lambda e: e[0], "LOW").alias("fallback_severity"),
                F.lit(head).alias("label_head"),
                # the third label carries no suffix in any suspended state
                per_state(lambda e: label_heads[i] + (e[2] if i < 2 else ""), tail).alias("fallback_label"),
                per_state(lambda e: "ONLINE", "LOCAL_DEMO").alias("fallback_source_type"),
                per_state(lambda e: e[1], F.lit("forensic-pixel-pipeline" if i == 2 else None).cast("string")).alias("fallback_domain"),
            )
        )
    items = claims.select("merchant_id", F.explode(F.array(*structs)).alias("c")).select("merchant_id", "c.*")
    found = evidence.select(
        "merchant_id", "evidence_type", "explanation", "relationship", "severity", "similarity_pct",
        F.col("source_type").alias("ev_source_type"), "source_url", F.col("source_domain").alias("ev_domain"),
    )
    joined = items.join(found, ["merchant_id", "evidence_type"], "left")
    is_document = F.col("evidence_type") == "manipulation"
    return joined.select(
        "merchant_id",
        "dimension",
        "claim",
        F.coalesce("explanation", "fallback_summary").alias("evidence_summary"),
        F.coalesce("relationship", "fallback_relationship").alias("relationship"),
        F.coalesce("severity", "fallback_severity").alias("severity"),
        F.coalesce(
            F.concat("label_head", F.col("similarity_pct").cast("string"), F.lit("%")), F.col("fallback_label")
        ).alias("score_label"),
        F.coalesce("ev_source_type", "fallback_source_type").alias("source_type"),
        F.when(is_document, F.lit(None).cast("string")).otherwise(F.col("source_url")).alias("source_url"),
        F.coalesce("ev_domain", "fallback_domain").alias("source_domain"),
    )


def conclusions(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """I14. Conclusion and recommendation from status and relationship counts."""
    counts = evidence.groupBy("merchant_id").agg(
        *[
            F.count_if(F.col("relationship") == rel).cast("int").alias(name)
            for rel, name in [
                ("CONTRADICTS", "contradictions"), ("REQUIRES_VERIFICATION", "verifications"), ("SUPPORTS", "supports")
            ]
        ]
    )
    joined = decisions.select("merchant_id", "status").join(counts, "merchant_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    suspended = F.coalesce(F.col("status").isin(list(SUSPENDED_CONCLUSIONS)), F.lit(False))
    st, con, ver = F.col("status"), zero("contradictions"), zero("verifications")
    fixed = lambda i: [(st == s, e[i]) for s, e in SUSPENDED_CONCLUSIONS.items()]
    return joined.select(
        "merchant_id",
        "status",
        ladder(
            fixed(0)
            + [
                ((st == "HIGH") & (con >= 2), "Multiple independent visual signals are inconsistent with the merchant's stated identity."),
                (st == "HIGH", "Critical visual evidence conflicts with merchant assertions and requires senior review."),
                ((st == "MEDIUM") & (con >= 1), "Visual evidence displays significant inconsistencies and unverified anomalies relative to merchant claims."),
                ((st == "MEDIUM") & (ver >= 2), "Multiple visual signals require additional verification before merchant onboarding approval."),
                (st == "MEDIUM", "Visual evidence displays moderate anomalies requiring merchant documentation verification."),
                (ver >= 1, "Visual evidence is largely consistent with merchant claims, with isolated low-risk anomalies."),
            ],
            "Visual evidence strongly supports the merchant's stated identity and product claims.",
        ).alias("conclusion"),
        ladder(
            fixed(1)
            + [
                (st == "HIGH", "HIGH → MANUAL REVIEW: Route to Senior Risk Operations for manual visual evidence audit."),
                (st == "MEDIUM", "MEDIUM → ADDITIONAL VERIFICATION: Request merchant brand authorization documentation and high-res inventory proof."),
            ],
            "LOW → NORMAL ONBOARDING: Standard merchant onboarding flow with automated background monitoring.",
        ).alias("final_recommendation"),
        F.when(suspended, 0).otherwise(con).alias("contradiction_count"),
        F.when(suspended, 3).otherwise(ver).alias("verification_count"),
        F.when(suspended, 0).otherwise(zero("supports")).alias("support_count"),
    )


def provenance(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """I15. Images and candidates analysed, distinct evidence sources, extractor used.

    The source set is an aggregate over at most five rows per merchant and at most the
    closed list of source types, so ``collect_set`` stays small whatever the key.
    """
    sources = evidence.groupBy("merchant_id").agg(F.array_sort(F.collect_set("source_type")).alias("found_sources"))
    joined = decisions.join(sources, "merchant_id", "left")
    fallback = F.coalesce(F.col("is_fallback_extractor"), F.lit(False))
    found = F.coalesce(F.col("found_sources"), F.array().cast("array<string>"))
    return joined.select(
        "merchant_id",
        F.when(fallback, "Fallback Color/Texture Extractor").otherwise("Vision Transformer (ViT-B/16)").alias("vision_model"),
        fallback.alias("is_fallback_extractor"),
        (F.col("n_products") + F.when(F.col("has_logo"), 1).otherwise(0) + F.when(F.col("has_document"), 1).otherwise(0)).alias("images_analyzed"),
        F.col("n_candidates").alias("online_evidence_candidates"),
        F.when(F.size(found) == 0, F.array(F.lit("ONLINE"), F.lit("LOCAL DEMO REFERENCE"))).otherwise(found).alias("evidence_sources"),
    )


def _half_up(x: Column) -> Column:
    """Round half towards +infinity, as the dashboard does."""
    return F.floor(x + F.lit(0.5)).cast("int")


def fingerprint(df: DataFrame) -> DataFrame:
    """I16. Six dashboard percentages; a missing input gives NULL, never 0."""
    c = F.col("coherence_score")
    return df.select(
        "merchant_id",
        _half_up(F.when(c <= 1.0, c * F.lit(100.0)).otherwise(c)).alias("image_consistency"),
        F.greatest(F.lit(0), _half_up((F.lit(1.0) - F.col("max_similarity")) * F.lit(100.0))).alias("raw_originality"),
        F.greatest(F.lit(0), _half_up(F.lit(100.0) - F.col("logo_risk"))).alias("raw_logo"),
        _half_up(F.col("reuse_risk_score")).alias("reuse_exposure"),
        _half_up(F.col("manipulation_score")).alias("manipulation_indicators"),
        ladder(
            [
                (F.col("final_score").isNull(), F.lit(None).cast("int")),
                (F.col("is_unverifiable"), 0),
                (F.col("status_tier").isin("HIGH", "CLEAR"), 90),
                (F.col("status_tier") == "MEDIUM", 72),
                (F.col("status_tier") == "LOW", 60),
            ],
            55,
        ).alias("evidence_confidence"),
        F.col("max_similarity").isNull().alias("no_sim"),
        F.col("logo_risk").isNull().alias("no_logo"),
    ).select(
        "merchant_id",
        "image_consistency",
        F.when(~F.col("no_sim"), F.col("raw_originality")).alias("visual_originality"),
        F.when(~F.col("no_logo"), F.col("raw_logo")).alias("logo_consistency"),
        "reuse_exposure",
        "manipulation_indicators",
        "evidence_confidence",
    )


def decision_signals(df: DataFrame) -> DataFrame:
    """I17. Up to four signals per merchant: active, suppressed, severity and context."""
    reuse = F.coalesce(F.col("reuse_risk_score"), F.lit(0.0))
    status = F.coalesce(F.when(F.col("match_status") != "", F.col("match_status")), F.lit("NO_EXTERNAL_MATCH"))
    sim = F.coalesce(F.col("max_similarity"), F.lit(0.0))
    supplier = F.coalesce(F.col("source_type").isin("SUPPLIER_CATALOG", "MARKETPLACE"), F.lit(False))
    reuse_active = (reuse >= 70.0) & ~supplier & (status == "CORROBORATED_EXTERNAL_MATCH")
    logo_risk = F.coalesce(F.col("logo_risk"), F.lit(0.0))
    logo_sim = F.coalesce(F.col("logo_similarity"), F.lit(1.0))
    has_ref = F.coalesce(F.col("matched_logo"), F.lit("")) != ""
    # only the first occurrence is removed or replaced
    short_ref = F.regexp_replace(F.regexp_replace(F.col("matched_logo"), r"^(.*?)verified_brand_", "$1"), r"^(.*?)\.png", "$1")
    first_space = F.regexp_replace(status, r"^([^_]*)_", "$1 ")
    manip = F.coalesce(F.col("manipulation_score"), F.lit(0.0))
    regions = F.coalesce(F.col("region_count"), F.lit(0))
    coherence = F.coalesce(F.col("coherence_score"), F.lit(1.0))
    pct = _half_up(F.when(coherence <= 1.0, coherence * F.lit(100.0)).otherwise(coherence))
    low = pct < 50

    def signal(shown, ident, label, detail, context, active, suppressed, severity, contribution):
        return F.struct(
            shown.alias("shown"),
            F.lit(ident).alias("signal_id"),
            F.lit(label).alias("label"),
            detail.alias("detail"),
            context.alias("context"),
            active.alias("active"),
            suppressed.alias("suppressed"),
            severity.alias("severity"),
            contribution.alias("contribution"),
        )

    rows = F.array(
        signal(
            (sim > 0.3) | (reuse > 10.0),
            "image_reuse",
            "Image Reuse Detection",
            text("ViT cosine similarity: ", _half_up(sim * F.lit(100.0)), "%"),
            ladder(
                [
                    (supplier, "Source classified as supplier/catalog — excluded from severe escalation."),
                    (status.isin("INSUFFICIENT_EVIDENCE", "NO_EXTERNAL_MATCH"), "Single fixture match — insufficient corroboration for escalation."),
                    (status == "CORROBORATED_EXTERNAL_MATCH", "Multi-source corroborated evidence."),
                ],
                text("Evidence status: ", first_space),
            ),
            reuse_active,
            supplier,
            ladder([(reuse_active, "high"), (supplier, "low"), (sim > 0.8, "medium")], "low"),
            ladder([(reuse_active, "Contributed to HIGH escalation"), (supplier, "Excluded — supplier sourcing")], "Insufficient evidence for escalation"),
        ),
        signal(
            has_ref | (logo_risk > 15.0),
            "logo_divergence",
            "Logo / Trademark Divergence",
            text("Brand mark similarity: ", _half_up(logo_sim * F.lit(100.0)), "% (risk: ", _half_up(logo_risk), "%)"),
            F.when(has_ref, text("Compared against verified brand asset: ", short_ref)).otherwise("No registered brand mark matched."),
            logo_risk >= 60.0,
            F.lit(False),
            ladder([(logo_risk >= 60.0, "high"), (logo_risk > 30.0, "medium")], "low"),
            F.when(logo_risk >= 60.0, "Triggered severe signal — logo divergence ≥ 60%").otherwise("Logo within acceptable tolerance"),
        ),
        signal(
            F.lit(True),
            "forensic_manipulation",
            "Forensic ELA Integrity",
            text("Compression anomaly score: ", _half_up(manip), "% — ", F.coalesce(F.col("manipulation_level"), F.lit("LOW")), " risk"),
            F.when(regions > 0, text(regions, " localized gradient anomaly region(s) detected.")).otherwise(
                "Uniform compression coefficient — no localized splicing detected."
            ),
            manip >= 60.0,
            F.lit(False),
            ladder([(manip >= 60.0, "high"), (manip > 20.0, "medium")], "low"),
            F.when(manip >= 60.0, "Tampered document — severe signal").otherwise("No significant manipulation detected"),
        ),
        signal(
            F.lit(True),
            "identity_coherence",
            "Cross-Product Visual Identity",
            text("Catalog coherence: ", pct, "%"),
            F.when(low, "Mixed visual styles suggest possible catalog stitching from multiple unrelated sources.").otherwise(
                "Visual style is consistent across extracted product catalog."
            ),
            F.lit(False),
            F.lit(False),
            F.when(low, "medium").otherwise("low"),
            F.lit("Informational — does not independently drive escalation"),
        ),
    )
    return (
        df.select("merchant_id", F.explode(F.filter(rows, lambda s: s["shown"])).alias("s"))
        .select("merchant_id", "s.*")
        .drop("shown")
    )


def tier_explanation(df: DataFrame) -> DataFrame:
    """I17. Why the tier was reached, from the counts of active and suppressed signals.

    Uses the same conditions as :func:`decision_signals` on the wide row, so no
    regrouping of the long form is needed.
    """
    reuse = F.coalesce(F.col("reuse_risk_score"), F.lit(0.0))
    sim = F.coalesce(F.col("max_similarity"), F.lit(0.0))
    supplier = F.coalesce(F.col("source_type").isin("SUPPLIER_CATALOG", "MARKETPLACE"), F.lit(False))
    shown = (sim > 0.3) | (reuse > 10.0)
    severe = count_true(
        shown & (reuse >= 70.0) & ~supplier & (F.col("match_status") == "CORROBORATED_EXTERNAL_MATCH"),
        F.col("logo_risk") >= 60.0,
        F.col("manipulation_score") >= 60.0,
    )
    suppressed = count_true(shown & supplier)
    df = df.withColumns({"severe_signals": severe, "suppressed_signals": suppressed})
    n, tier = F.col("severe_signals"), F.coalesce(F.col("status_tier"), F.col("status"), F.lit("CLEAR"))
    return df.select(
        "merchant_id",
        "severe_signals",
        "suppressed_signals",
        ladder(
            [
                (F.col("is_unverifiable"), "Domain unreachable. Scoring suspended — no evidence available."),
                (tier == "HIGH", text(n, " independently corroborated severe signals satisfied escalation threshold (≥ 2 required).")),
                (tier == "MEDIUM", text(n, " severe signal detected. Enhanced verification triggered. A 2nd corroborated signal is required for HIGH escalation.")),
                ((tier == "LOW") & (n == 0) & (F.col("suppressed_signals") > 0), "Strong visual matches found, but all originate from supplier/catalog sources — excluded from escalation by safety policy."),
                ((tier == "LOW") & (F.coalesce(F.col("final_score"), F.lit(0.0)) > 20.0), "Visual signals detected but insufficient corroboration for escalation. Single uncorroborated matches are intentionally bounded at LOW to protect legitimate resellers."),
            ],
            "No suspicious visual evidence detected. Merchant approved for standard onboarding.",
        ).alias("tier_explanation"),
    )
