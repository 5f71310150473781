"""Business risk, visual risk, fusion, corroboration gate and tiers.

Every function takes the wide ``signals`` table (one row per merchant) and adds
columns; nothing here shuffles, so the whole family collapses into one code-generated
stage over whatever produced the signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ladders import count_true, ladder, let, text
from ..functions.rounding import clip, round_columns

# Categories that never publish product prices.
NON_RETAIL = ["FINTECH_PAYMENTS", "SAAS_SOFTWARE", "INFORMATIONAL_INSTITUTION"]

# Weights of the five visual dimensions.
WEIGHTS = {
    "image_reuse": 0.40,
    "logo_inconsistency": 0.15,
    "manipulation": 0.25,
    "synthetic_signal": 0.08,
    "identity_dispersion": 0.12,
}

# Tier floors with status, label, recommendation and badge.
TIERS = [
    (80.0, "HIGH", "HIGH", "HIGH — MANUAL REVIEW",
     "Route to Senior Risk Operations for manual visual evidence audit.", "#dc2626"),
    (65.0, "ELEVATED", "MEDIUM", "ELEVATED — CONDITIONAL APPROVAL",
     "Conditional approval with 90-day enhanced risk monitoring and inventory invoice audit.", "#f97316"),
    (50.0, "MEDIUM", "MEDIUM", "MEDIUM — ENHANCED VERIFICATION",
     "Request merchant supplier invoices or distributor authorization documentation.", "#d97706"),
    (30.0, "LOW", "LOW", "LOW — STANDARD ONBOARDING",
     "Standard merchant onboarding; basic statutory identity validation.", "#10b981"),
    (None, "CLEAR", "LOW", "CLEAR — AUTO-APPROVE",
     "Standard merchant onboarding flow; automated real-time transaction monitoring enabled.", "#16a34a"),
]

# Summaries of the business profile.
SUMMARY_OFFLINE = "Standard business profile with policy disclosures and contact channels present."
SUMMARY_GOOD = "Merchant profile displays standard textual compliance and disclosures."
SUMMARY_POOR = "Merchant profile lacks standard business disclosures or contact channels."

SUPPLIER_LIKE = ["SUPPLIER_CATALOG", "MARKETPLACE"]
WEAK_STATUSES = ["INSUFFICIENT_EVIDENCE", "WEAK_MATCH", "NO_EXTERNAL_MATCH"]


def is_non_retail(category: Column) -> Column:
    return F.coalesce(category.isin(NON_RETAIL), F.lit(False))


def crawl_failed() -> Column:
    """A crawl row exists and it did not succeed (or carries an error)."""
    return F.coalesce(
        (F.col("crawl_status") != "SUCCESS") | (F.coalesce(F.col("crawl_error"), F.lit("")) != ""),
        F.lit(False),
    )


def business_risk(df: DataFrame) -> DataFrame:
    """I1. Text/business risk from disclosure flags.

    No crawl row (``crawl_status`` NULL) -> neutral 18.0 with every signal true;
    failed crawl -> NULL score with every signal false. Needs ``crawl_status``,
    ``crawl_error``, ``has_contact/policy/pricing/about``, ``n_social``,
    ``site_category``.
    """
    absent, failed = F.col("crawl_status").isNull(), crawl_failed()
    category = ladder([(absent | failed, None)], F.coalesce(F.col("site_category"), F.lit("GENERAL_WEBSITE")))
    df = df.withColumns({"crawl_absent": absent, "crawl_failed": failed, "eff_category": category})
    flag = lambda c: ladder(
        [(F.col("crawl_absent"), True), (F.col("crawl_failed"), False)], F.coalesce(F.col(c), F.lit(False))
    )
    df = df.withColumns(
        {
            "sig_contact": flag("has_contact"),
            "sig_policy": flag("has_policy"),
            "sig_pricing": flag("has_pricing"),
            "sig_about": flag("has_about"),
            "sig_social": ladder(
                [(F.col("crawl_absent"), True), (F.col("crawl_failed"), False)],
                F.coalesce(F.col("n_social"), F.lit(0)) > 0,
            ),
            "non_retail": is_non_retail(F.col("eff_category")),
        }
    )
    penalty = lambda cond, points: F.when(cond, points).otherwise(0.0)
    raw = (
        F.lit(15.0)
        + penalty(~F.col("sig_contact"), 25.0)
        + penalty(~F.col("sig_policy"), 20.0)
        + penalty(~F.col("sig_pricing") & ~F.col("non_retail"), 15.0)
        + penalty(~F.col("sig_about"), 5.0)
        + penalty(~F.col("sig_social"), 5.0)
    )
    score = ladder([(F.col("crawl_absent"), 18.0), (F.col("crawl_failed"), F.lit(None).cast("double"))], clip(raw, 5.0, 95.0))
    df = df.withColumn("text_risk_score", score)
    return df.withColumn(
        "text_summary",
        ladder(
            [
                (F.col("crawl_absent"), SUMMARY_OFFLINE),
                (
                    F.col("crawl_failed"),
                    text("Unreachable Website: ", F.coalesce(
                        F.when(F.col("crawl_error") != "", F.col("crawl_error")),
                        F.lit("Merchant website could not be reached"))),
                ),
                (F.col("text_risk_score") < 40.0, SUMMARY_GOOD),
            ],
            SUMMARY_POOR,
        ),
    )


def reuse_gate(df: DataFrame) -> DataFrame:
    """I2. Reuse evidence that may enter the visual score, limited by match status."""
    raw = F.coalesce(F.col("reuse_risk_score"), F.lit(0.0))
    status = F.coalesce(F.col("match_status"), F.lit(""))
    return df.withColumn(
        "e1_score",
        ladder(
            [
                (F.coalesce(F.col("is_own_brand"), F.lit(False)) | status.isin("NO_EXTERNAL_MATCH", ""), 0.0),
                (status == "INSUFFICIENT_EVIDENCE", F.least(F.lit(35.0), raw)),
                (status == "WEAK_MATCH", F.least(F.lit(25.0), raw)),
            ],
            raw,
        ),
    )


def visual_risk(df: DataFrame) -> DataFrame:
    """I3. Weighted visual risk, amplified only by two or more strong signals.

    Needs ``e1_score`` (I2), ``e4_score``, ``logo_risk``, ``manipulation_score``,
    ``synthetic_score``, ``coherence_score``.
    """
    df = df.withColumns(
        {
            "reuse_risk": F.greatest(F.col("e1_score"), F.coalesce(F.col("e4_score"), F.lit(0.0))),
            "logo_in": F.coalesce(F.col("logo_risk"), F.lit(0.0)),
            "manip_in": F.coalesce(F.col("manipulation_score"), F.lit(0.0)),
            "synth_in": F.coalesce(F.col("synthetic_score"), F.lit(10.0)),
            "dispersion": clip(F.lit(100.0) - F.coalesce(F.col("coherence_score"), F.lit(85.0)), 0.0, 100.0),
        }
    )
    primary = [F.col("reuse_risk"), F.col("logo_in"), F.col("manip_in")]
    r, l, m = primary
    df = df.withColumns(
        {
            "linear_base": F.lit(WEIGHTS["image_reuse"]) * r
            + F.lit(WEIGHTS["logo_inconsistency"]) * l
            + F.lit(WEIGHTS["manipulation"]) * m
            + F.lit(WEIGHTS["synthetic_signal"]) * F.col("synth_in")
            + F.lit(WEIGHTS["identity_dispersion"]) * F.col("dispersion"),
            "n_severe": count_true(*[p >= 65.0 for p in primary]),
            "n_moderate": count_true(*[p >= 40.0 for p in primary]),
            "top_signal": F.greatest(*primary),
            # the median of three is the second largest
            "second_signal": F.greatest(F.least(r, l), F.least(r, m), F.least(l, m)),
        }
    )

    # bound once: filters pushed through these columns must not multiply their inputs
    def composite(p: Column) -> Column:
        top, second, base = p["top_signal"], p["second_signal"], p["linear_base"]
        return ladder(
            [
                (p["n_severe"] >= 2, F.greatest(base, F.lit(0.55) * top + F.lit(0.35) * second + F.lit(0.10) * base)),
                (
                    (p["n_severe"] == 1) & (p["n_moderate"] >= 2),
                    F.greatest(base, F.lit(0.45) * top + F.lit(0.30) * second + F.lit(0.25) * base),
                ),
            ],
            base,
        )

    inputs = F.struct("top_signal", "second_signal", "linear_base", "n_severe", "n_moderate")
    df = df.withColumn("composite", let(inputs, composite))
    capped = lambda p: F.when((p["reuse_risk"] == 0.0) & (p["logo_in"] < 50.0), F.least(p["composite"], F.lit(38.0))).otherwise(p["composite"])
    df = df.withColumn("visual_risk_score", clip(let(F.struct("reuse_risk", "logo_in", "composite"), capped), 0.0, 100.0))
    df = round_columns(df, {"visual_risk_score": 1})
    return df.withColumns(
        {
            "visual_risk_level": ladder(
                [(F.col("visual_risk_score") >= 70.0, "HIGH"), (F.col("visual_risk_score") >= 40.0, "MEDIUM")], "LOW"
            ),
            "corroboration_active": F.col("n_severe") >= 2,
        }
    )


def visual_breakdown(df: DataFrame) -> DataFrame:
    """I3 (long form). One row per merchant and dimension with its weighted share."""
    parts = [
        ("image_reuse", "reuse_risk"),
        ("logo_inconsistency", "logo_in"),
        ("manipulation", "manip_in"),
        ("synthetic_signal", "synth_in"),
        ("identity_dispersion", "dispersion"),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"),
                F.col(col).alias("score"),
                F.lit(WEIGHTS[name]).alias("weight"),
                (F.col(col) * F.lit(WEIGHTS[name])).alias("contribution"),
            )
            for name, col in parts
        ]
    )
    out = df.select("merchant_id", F.explode(rows).alias("b")).select("merchant_id", "b.*")
    return round_columns(out, {"score": 1, "contribution": 1})


def base_fusion(df: DataFrame) -> DataFrame:
    """I5. Four blending regimes, then a deduction for trust signals, floor 5."""
    t = F.coalesce(F.col("text_risk_score"), F.lit(18.0))
    v = F.coalesce(F.col("visual_risk_score"), F.lit(20.0))
    df = df.withColumns({"text_in": t, "visual_in": v})

    def blend(p: Column) -> Column:
        t, v = p["text_in"], p["visual_in"]
        return ladder(
            [
                (v >= 70.0, F.greatest(v, F.lit(0.15) * t + F.lit(0.85) * v)),
                (v >= 40.0, F.lit(0.30) * t + F.lit(0.70) * v),
                ((t >= 70.0) & ~p["non_retail"], F.greatest(F.lit(45.0), F.lit(0.55) * t + F.lit(0.45) * v)),
            ],
            F.lit(0.35) * t + F.lit(0.65) * v,
        )

    raw = let(F.struct("text_in", "visual_in", "non_retail"), blend)
    deduction = (
        F.when(F.col("sig_contact") & F.col("sig_policy") & F.col("sig_about"), 5.0).otherwise(0.0)
        + F.when(F.col("sig_social"), 3.0).otherwise(0.0)
        + F.when(F.col("non_retail"), 8.0).otherwise(0.0)
    )
    df = df.withColumns({"raw_fusion": raw, "trust_deduction": deduction})
    return df.withColumn("fused_score", F.greatest(F.lit(5.0), F.col("raw_fusion") - F.col("trust_deduction")))


def severe_signals(df: DataFrame) -> DataFrame:
    """I6. How many independent signals are severe enough to corroborate each other."""
    reuse = F.coalesce(F.col("reuse_risk_score"), F.lit(0.0))
    status = F.coalesce(F.col("match_status"), F.lit("NO_DATA"))
    df = df.withColumns(
        {
            "is_supplier": F.coalesce(F.col("source_type").isin(SUPPLIER_LIKE), F.lit(False)),
            "reuse_val": reuse,
            "evidence_status": status,
        }
    )
    return df.withColumn(
        "severe_count",
        count_true(
            (F.col("reuse_val") >= 70.0) & ~F.col("is_supplier") & ~F.col("evidence_status").isin(WEAK_STATUSES),
            F.coalesce(F.col("logo_risk"), F.lit(0.0)) >= 60.0,
            F.coalesce(F.col("manipulation_score"), F.lit(0.0)) >= 60.0,
            (F.col("text_in") >= 65.0) & ~F.col("non_retail"),
        ),
    )


def corroboration_gate(df: DataFrame) -> DataFrame:
    """I7. Escalate only corroborated risk; bound every isolated anomaly."""

    def gate(p: Column) -> Column:
        fused, severe, supplier = p["fused_score"], p["severe_count"], p["is_supplier"]
        return ladder(
            [
                (severe >= 2, F.greatest(F.lit(80.0), fused)),
                (
                    (severe == 1) & (p["reuse_val"] >= 88.0) & ~supplier,
                    F.least(F.lit(74.0), F.greatest(F.lit(55.0), fused)),
                ),
                ((p["reuse_val"] == 0.0) | supplier, F.least(fused, F.when(supplier, 38.0).otherwise(32.0))),
            ],
            F.least(F.lit(64.0), fused),
        )

    gated = let(F.struct("fused_score", "severe_count", "is_supplier", "reuse_val"), gate)
    df = df.withColumn("final_score", clip(gated, 5.0, 100.0))
    return round_columns(df, {"final_score": 1})


def _by_tier(score: Column, field: int) -> Column:
    return ladder([(score >= t[0], t[field]) for t in TIERS[:-1]], TIERS[-1][field])


def tier_columns(score: Column) -> dict[str, Column]:
    """I8. Tier, status, label, recommendation and badge of a final score."""
    return {
        "status_tier": _by_tier(score, 1),
        "status": _by_tier(score, 2),
        "status_label": _by_tier(score, 3),
        "recommendation": _by_tier(score, 4),
        "badge_color": _by_tier(score, 5),
    }


def tiers(df: DataFrame) -> DataFrame:
    """I8 on the ``final_score`` column."""
    return df.withColumns(tier_columns(F.col("final_score")))


def fuse(df: DataFrame) -> DataFrame:
    """I5 -> I8 in order; needs the columns of I1 and I3."""
    return tiers(corroboration_gate(severe_signals(base_fusion(df))))


def decide(df: DataFrame) -> DataFrame:
    """I1 -> I8 for verifiable merchants: the flagship decision columns."""
    return fuse(visual_risk(reuse_gate(business_risk(df))))
