"""Verification of web candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import domains
from ..functions.ladders import ladder, text
from ..functions.rounding import percent, round_columns
from ..functions.urls import index_domain, own_domain_loose
from ..functions.vectors import cosine

STRONG, MODERATE, WEAK = 0.85, 0.70, 0.55


def join_candidates(assets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates beside the asset they were found for, on ``asset_id``."""
    left = assets.select("asset_id", "merchant_domain", F.col("embedding").alias("asset_embedding"))
    return candidates.filter(F.col("embedding").isNotNull()).join(left, "asset_id")


def verify_candidates(pairs: DataFrame) -> DataFrame:
    """F10. Similarity, source class, severity, strength, label and explanation per candidate.

    Needs asset_id, k (search order), candidate_id, source_domain, asset_embedding,
    embedding, merchant_domain; optional source_type, source_url, title. Row-local.
    """
    for c in ("source_type", "source_url", "title", "filename"):
        if c not in pairs.columns:
            pairs = pairs.withColumn(c, F.lit(None).cast("string"))
    df = pairs.withColumns(
        {
            "raw_similarity": cosine(F.col("asset_embedding"), F.col("embedding")),
            "source_domain": F.lower(F.coalesce(F.col("source_domain"), F.lit("public-web-source.com"))),
        }
    ).drop("asset_embedding", "embedding")
    df = df.withColumns(
        {
            "is_self": own_domain_loose(F.col("source_domain"), index_domain(F.col("merchant_domain"))),
            "is_supplier": domains.is_supplier(F.col("source_domain")),
            "is_soft": domains.is_soft_trust(F.col("source_domain")),
            "similarity": F.col("raw_similarity"),
            "similarity_pct": percent(F.col("raw_similarity")),
        }
    )
    df = round_columns(df, {"similarity": 4})
    sim, pct, dom = F.col("raw_similarity"), F.col("similarity_pct"), F.col("source_domain")
    own, sup, soft = F.col("is_self"), F.col("is_supplier"), F.col("is_soft")

    def step(on_own, on_supplier, on_soft, strong, moderate, weak, other):
        return ladder(
            [(own, on_own), (sup, on_supplier), (soft, on_soft), (sim >= STRONG, strong), (sim >= MODERATE, moderate), (sim >= WEAK, weak)],
            other,
        )

    return df.withColumns(
        {
            "severity": step("LOW", "LOW", F.when(sim < STRONG, "LOW").otherwise("MEDIUM"), "HIGH", "MEDIUM", "LOW", "LOW"),
            "evidence_strength": step("LOW", "LOW", "LOW", "HIGH", "MEDIUM", "LOW", "LOW"),
            "match_label": step(
                "Own Domain / Brand Verified", "Supplier / Manufacturer Catalog Asset", "Image Aggregator / Marketplace Match",
                "Potential External Match", "Potential Source Match", "Weak Visual Match", "No Significant Match",
            ),
            "explanation": step(
                text("Verified merchant's own domain asset on ", dom, " (", pct, "% match)."),
                text("Product imagery matches supplier catalog on ", dom, " (", pct, "% match). Common for resellers and distributors — does not indicate visual fraud."),
                text("Visual match on ", dom, " (", pct, "% similarity). This source (marketplace/aggregator/stock) commonly hosts legitimate product imagery — insufficient alone to indicate reuse fraud."),
                text("Strong visual similarity (", pct, "%) detected against ", dom, ". Requires corroboration from additional independent signals."),
                text("Moderate visual similarity (", pct, "%) against ", dom, "."),
                text("Weak visual similarity (", pct, "%) — below threshold for meaningful evidence."),
                text("Low visual similarity (", pct, "%). Candidate does not match merchant image."),
            ),
            "source_type": domains.classify_source(own, sup, soft, F.col("source_type")),
            "title": F.coalesce(F.col("title"), text("Candidate ", dom)),
            "is_soft": soft | sup,
        }
    ).withColumn("is_meaningful", ~F.col("is_soft") & (F.col("similarity") >= WEAK))


def rank_candidates(verified: DataFrame, limit: int | None = None) -> DataFrame:
    """F11. External before own, meaningful before soft, then by similarity and search order.

    All candidates stay; with ``limit`` only the first ones per asset, cut inside the map tasks.
    """
    order = Window.partitionBy("asset_id").orderBy(
        (~F.col("is_self")).desc(), F.col("is_meaningful").desc(), F.col("similarity").desc(), "k"
    )
    ranked = verified.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


_TOP = ["candidate_id", "similarity", "similarity_pct", "source_type", "source_domain", "source_url", "title", "filename",
        "explanation", "evidence_strength", "severity"]


def match_status(assets: DataFrame, verified: DataFrame) -> DataFrame:
    """F12, F13. Match status, top candidate, own-brand flag and evidence score per asset.

    ``assets``: one row per asset_id (those without candidates keep a neutral row).
    One aggregate with map-side combine; the top candidates are ``max_by`` values.
    """
    key = F.struct(F.col("is_meaningful").cast("int"), "similarity", (-F.col("k")).alias("o"))
    external, meaningful = ~F.col("is_self"), ~F.col("is_self") & F.col("is_meaningful")
    top = F.struct(*_TOP)
    per = verified.groupBy("asset_id").agg(
        F.count("*").alias("n_verified"),
        F.max_by(top, F.when(external, key)).alias("top_external"),
        F.max_by(top, F.when(meaningful, key)).alias("top_meaningful"),
        F.max_by(top, F.struct((~F.col("is_self")).cast("int").alias("e"), key.alias("k"))).alias("top_any"),
        F.count_if(meaningful).cast("int").alias("n_meaningful"),
        F.count_if(meaningful & (F.col("similarity") >= STRONG)).cast("int").alias("strong_match_count"),
        F.count_if(meaningful & (F.col("similarity") >= MODERATE)).cast("int").alias("moderate_match_count"),
    )
    df = assets.join(per, "asset_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    df = df.withColumns(
        {
            "strong_match_count": zero("strong_match_count"),
            "moderate_match_count": zero("moderate_match_count"),
            "n_meaningful": zero("n_meaningful"),
            "max_meaningful": F.coalesce(F.col("top_meaningful.similarity"), F.lit(0.0)),
            "max_any": F.coalesce(F.col("top_external.similarity"), F.col("top_any.similarity"), F.lit(0.0)),
        }
    )
    best, strong, moderate = F.col("max_any"), F.col("strong_match_count"), F.col("moderate_match_count")
    corroborated = (strong >= 2) | ((strong >= 1) & (moderate >= 2))
    # which of the statuses, and which wording of the insufficient ones
    df = df.withColumn(
        "case_no",
        ladder([(best < WEAK, 0), (best < MODERATE, 1), (corroborated, 2), (F.col("n_meaningful") == 0, 3), (strong == 1, 4)], 5),
    )
    case = F.col("case_no")
    df = df.withColumns(
        {
            "match_status": ladder(
                [(case == 0, "NO_EXTERNAL_MATCH"), (case == 1, "WEAK_MATCH"), (case == 2, "CORROBORATED_EXTERNAL_MATCH")],
                "INSUFFICIENT_EVIDENCE",
            ),
            "is_own_brand": case <= 1,
            "active": F.when(case == 0, F.col("top_any")).when(case.isin(1, 3), F.col("top_external")).otherwise(F.col("top_meaningful")),
        }
    )
    act = lambda f: F.col(f"active.{f}")
    e4 = ladder(
        [
            (case == 0, 0.0),
            (case == 1, F.least(F.lit(20.0), best * F.lit(30.0))),
            (case == 3, F.least(F.lit(20.0), best * F.lit(20.0))),
            (
                case == 2,
                F.least(
                    F.lit(80.0),
                    F.lit(50.0) + (F.col("max_meaningful") - STRONG) / F.lit(1.0 - STRONG) * F.lit(20.0)
                    + F.least(F.lit(10.0), (strong - 1) * F.lit(5.0)),
                ),
            ),
        ],
        F.least(F.lit(35.0), F.lit(20.0) + (F.col("max_meaningful") - MODERATE) / F.lit(1.0 - MODERATE) * F.lit(15.0)),
    )
    df = df.withColumn("e4_score", e4)
    df = round_columns(df, {"e4_score": 1})
    keep = [c for c in assets.columns]
    return df.select(
        *keep,
        "match_status",
        "is_own_brand",
        "strong_match_count",
        "moderate_match_count",
        F.when(F.col("is_own_brand"), 0.0).otherwise(F.col("max_meaningful")).alias("max_similarity"),
        "e4_score",
        act("candidate_id").alias("top_candidate_id"),
        act("similarity").alias("top_similarity"),
        F.coalesce(act("source_type"), F.lit("NONE")).alias("top_source_type"),
        act("source_domain").alias("top_source_domain"),
        act("source_url").alias("top_source_url"),
        act("filename").alias("top_filename"),
        ladder(
            [(case == 3, "LOW"), (case == 4, "MEDIUM")], F.coalesce(act("evidence_strength"), F.lit("LOW"))
        ).alias("evidence_strength"),
        ladder(
            [
                (F.col("n_verified").isNull(), "No external visual matches discovered online. Visual content appears unique / proprietary to the merchant."),
                (case == 3, text("High visual similarity (", act("similarity_pct"), "%) detected on soft-trust source (", act("source_domain"), "). This source type commonly hosts legitimate product imagery — insufficient evidence alone to conclude malicious reuse.")),
                (case == 4, text("Single strong match (", act("similarity_pct"), "%) on ", act("source_domain"), ". Insufficient corroborating evidence to conclude meaningful reuse.")),
                (case == 5, text("Moderate similarity (", act("similarity_pct"), "%) on ", act("source_domain"), ". Evidence present but not corroborated enough to establish reuse.")),
            ],
            F.coalesce(act("explanation"), F.lit("No external matches verified online (Own-Brand / Unique Content).")),
        ).alias("match_explanation"),
    )


def candidate_list(verified: DataFrame, platform: DataFrame) -> DataFrame:
    """H10. Verified web candidates and platform matches as one long list.

    ``platform``: asset_id, seq, similarity, masked_ids, domain, asset_url; rows below
    0.70 are not listed.
    """
    web = verified.select(
        "asset_id", "candidate_id", "similarity", "similarity_pct", "severity", "source_type", "source_url", "source_domain",
        "title", "evidence_strength", "match_label",
    )
    names = F.array_join("masked_ids", ", ")
    high = F.col("similarity") >= STRONG
    local = platform.filter(F.col("similarity") >= MODERATE).select(
        "asset_id",
        text("platform_vit_", F.col("seq")).alias("candidate_id"),
        "similarity",
        percent(F.col("similarity")).alias("similarity_pct"),
        F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.lit("PLATFORM_VIT").alias("source_type"),
        F.col("asset_url").alias("source_url"),
        F.coalesce(F.col("domain"), F.lit("platform-merchant.internal")).alias("source_domain"),
        text("Previously-scanned merchant (", F.when(names == "", "platform index").otherwise(names), ")").alias("title"),
        F.when(high, "HIGH").otherwise("MEDIUM").alias("evidence_strength"),
        F.lit("Platform ViT Match").alias("match_label"),
    )
    return web.unionByName(local)
