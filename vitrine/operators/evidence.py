"""Evidence normalisation, dual-source fusion and reuse calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import domains
from ..functions.ladders import count_true, ladder, text
from ..functions.rounding import percent, round_columns, whole
from ..functions.urls import clean_domain, extract_domain, own_domain_strict

SHOWN = 5


def _pages(urls: Column) -> Column:
    return F.transform(urls, lambda u: F.struct(u.alias("url"), extract_domain(u).alias("domain")))


def _external(pages: Column) -> Column:
    own = lambda p: own_domain_strict(clean_domain(p["domain"]), clean_domain(F.coalesce(F.col("merchant_domain"), F.lit(""))))
    return F.filter(pages, lambda p: (p["url"] != "") & ~own(p))


def normalise_detections(detections: DataFrame) -> DataFrame:
    """H1. Reuse evidence of one asset from a web-detection payload.

    Needs asset_id, asset_url, asset_type, merchant_domain and the arrays full_images,
    partial_images, page_urls. Own pages and repeats are dropped; without any page the
    matched images stand in. Row-local: a payload is one row.
    """
    images = F.concat("full_images", "partial_images")
    df = detections.withColumns(
        {"images": images, "external_pages": _external(_pages(F.array_distinct(F.col("page_urls"))))}
    )
    stand_in = F.filter(_external(_pages(F.col("images"))), lambda p: p["domain"] != "")
    df = df.withColumn("matched", F.when(F.size("external_pages") > 0, F.col("external_pages")).otherwise(stand_in))
    any_of = lambda test: F.exists("matched", lambda p: test(p["domain"]))
    all_of = lambda test: F.forall("matched", lambda p: test(p["domain"]))
    df = df.withColumns(
        {
            "found": (F.size("matched") > 0) | (F.size("images") > 0),
            "is_marketplace": any_of(domains.is_marketplace),
            "is_stock": any_of(domains.is_stock),
            "names": F.array_join(F.slice(F.array_distinct(F.transform("matched", lambda p: p["domain"])), 1, 3), ", "),
        }
    )
    listed = F.col("is_marketplace") | F.col("is_stock")
    return df.select(
        "asset_id",
        "asset_url",
        "asset_type",
        F.lit("external_image_reuse").alias("signal_type"),
        ladder(
            [
                (~F.col("found"), 0),
                (F.size("full_images") > 0, F.when(listed, 65).otherwise(75)),
                (F.size("partial_images") > 0, F.when(listed, 45).otherwise(55)),
            ],
            30,
        ).alias("score"),
        F.slice("matched", 1, SHOWN).alias("matched_pages"),
        F.slice("images", 1, SHOWN).alias("matched_images"),
        (F.col("is_marketplace") & all_of(domains.is_marketplace)).alias("is_marketplace_only"),
        (F.col("is_stock") & all_of(domains.is_stock)).alias("is_stock_only"),
        ladder(
            [
                (~F.col("found"), text("Unique asset. No external online web matches discovered for this ", F.col("asset_type"), ".")),
                (F.col("is_marketplace"), text("Visual reuse observed across external marketplace/catalog listing(s) (", F.col("names"), "). Evidence of multi-channel listing or catalog reuse.")),
                (F.col("is_stock"), text("Visual asset matches known stock photography repository (", F.col("names"), ").")),
            ],
            text("Potential external visual reuse discovered across third-party site(s) (", F.col("names"), ")."),
        ).alias("explanation"),
    )


def web_tiers(detections: DataFrame) -> DataFrame:
    """H2. Provider result and score of the web side; repeated pages are kept."""
    df = detections.withColumn("pages", _external(_pages(F.col("page_urls")))).withColumns(
        {
            "matched_domains": F.array_distinct(F.transform("pages", lambda p: p["domain"])),
            "n_pages": F.size("pages"),
        }
    )
    market = F.exists("matched_domains", domains.is_marketplace)
    full, partial = F.size("full_images") > 0, (F.size("partial_images") > 0) | (F.col("n_pages") > 0)
    similar = F.size("similar_images") > 0
    return df.withColumns(
        {
            "web_result": ladder([(full, "full_match"), (partial, "partial_match"), (similar, "similar_image")], "none"),
            "web_score": ladder(
                [(full, F.when(market, 60).otherwise(75)), (partial, F.when(market, 45).otherwise(50)), (similar, 30)], 0
            ),
        }
    )


def fuse_sources(tiers: DataFrame) -> DataFrame:
    """H3. Asset evidence from the web side (H2) and the cross-merchant index (F9).

    Needs the columns of :func:`web_tiers` plus ``local_similarity`` and ``masked_ids``.
    """
    sim = F.coalesce(F.col("local_similarity"), F.lit(0.0))
    df = tiers.withColumns({"sim": sim, "local_score": F.when(sim >= 0.82, percent(sim)).otherwise(0)})
    web, local, sim = F.col("web_score"), F.col("local_score"), F.col("sim")
    web_strong = (F.col("web_result") == "full_match") | ((F.col("n_pages") >= 1) & (web >= 50))
    local_strong = sim >= 0.92
    df = df.withColumn(
        "case_no",
        ladder([(web_strong & local_strong, 1), ((web > 0) & (local > 0), 2), (web > 0, 3), (local > 0, 4)], 5),
    ).withColumns({"web_strong": web_strong, "local_strong": local_strong})
    case = F.col("case_no")
    by_case = lambda *values: ladder([(case == i + 1, v) for i, v in enumerate(values[:-1])], values[-1])
    half = F.lit(0.5) * web + F.lit(0.5) * local
    two = F.array_join(F.slice("matched_domains", 1, 2), ", ")
    some = lambda fallback: F.when(F.size("matched_domains") > 0, two).otherwise(fallback)
    strength = lambda c: F.when(F.col(c), "HIGH").otherwise("MEDIUM")
    return df.select(
        "asset_id",
        "asset_url",
        "asset_type",
        by_case("external_image_reuse", "external_image_reuse", "external_image_reuse", "cross_merchant_visual_similarity", "external_image_reuse").alias("signal_type"),
        by_case(
            F.least(F.lit(85), whole(half + F.lit(15.0))), F.least(F.lit(70), whole(half + F.lit(10.0))),
            F.least(F.lit(60), web), F.least(F.lit(58), local), 0,
        ).alias("score"),
        "web_score",
        "local_score",
        "web_result",
        sim.alias("local_similarity"),
        by_case("FUSED", "FUSED", "OPEN_WEB", "LOCAL_INDEX", "FUSED").alias("evidence_source"),
        (case <= 2).alias("corroborated"),
        by_case("HIGH", "MEDIUM", strength("web_strong"), strength("local_strong"), "LOW").alias("confidence"),
        by_case("CORROBORATED_POTENTIAL_REUSE", "CORROBORATED_POTENTIAL_REUSE", "POTENTIAL_REUSE", "POTENTIAL_REUSE", "LOW_EVIDENCE").alias("asset_evidence_level"),
        F.slice("matched_domains", 1, SHOWN).alias("matched_domains"),
        "masked_ids",
        by_case(
            text("This asset has corroborated potential visual reuse evidence across both the open web (", some("external domains"), ") and strong visual similarity (", percent(sim), "%) to visuals from previously scanned merchant(s)."),
            text("Potential visual reuse evidence: partial matches discovered on open web and moderate cross-merchant visual similarity (", percent(sim), "%)."),
            text("Potential visual reuse evidence discovered on open web (", some("third-party pages"), "). No cross-merchant matches found in platform index."),
            text("Visual similarity observed against visual assets from previously scanned merchant (", F.array_join(F.slice("masked_ids", 1, 2), ", "), "). No open-web matches found."),
            F.lit("Unique asset. No open web matches or cross-merchant visual commonalities detected."),
        ).alias("explanation"),
    )


def evidence_risk(evidence: DataFrame, brands: DataFrame) -> DataFrame:
    """H4. Risk score, level and action per merchant from a long evidence list.

    ``brands``: merchant_id, brand_status. Only maxima and any/all flags per merchant
    are needed, so the aggregate combines on the map side whatever a merchant's size.
    """
    reuse = F.col("signal_type").isin("external_image_reuse", "cross_merchant_visual_similarity")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    top = lambda cond: F.coalesce(F.max(F.when(cond, F.col("score"))), F.lit(0))
    per = evidence.groupBy("merchant_id").agg(
        top(reuse).alias("reuse"),
        top(F.col("signal_type") == "potential_logo_mismatch").alias("logo_any"),
        top(F.col("signal_type") == "manipulation").alias("manip"),
        F.coalesce(F.bool_and(F.when(reuse, flag("is_marketplace_only") | flag("is_stock_only"))), F.lit(False)).alias("soft_only"),
        F.coalesce(F.bool_or(F.when(reuse, flag("corroborated") | (F.col("asset_evidence_level") == "CORROBORATED_POTENTIAL_REUSE"))), F.lit(False)).alias("corroborated_reuse"),
    )
    df = brands.select("merchant_id", "brand_status").join(per, "merchant_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    df = df.withColumns(
        {
            "reuse": zero("reuse"),
            "manip": zero("manip"),
            "logo": F.when(F.col("brand_status") == "VERIFIED", zero("logo_any")).otherwise(0),
        }
    )
    parts = [F.col("reuse"), F.col("logo"), F.col("manip")]
    df = df.withColumns(
        {
            "vectors": count_true(*[p >= 40 for p in parts]),
            "n_active": count_true(*[p > 0 for p in parts]),
            "sum_active": sum((F.greatest(p, F.lit(0)) for p in parts), F.lit(0)),
            "peak": F.greatest(*parts).cast("double"),
        }
    )
    base = ladder(
        [
            (F.col("n_active") == 0, 0.0),
            (F.col("vectors") >= 2, F.lit(0.60) * F.col("peak") + F.lit(0.40) * (F.col("sum_active") / F.col("n_active"))),
            (F.col("manip") >= 70, F.col("manip").cast("double")),
            (F.coalesce(F.col("soft_only"), F.lit(False)), F.least(F.lit(55.0), F.col("peak") * F.lit(0.85))),
        ],
        F.least(F.lit(60.0), F.col("peak")),
    )
    df = df.withColumn("risk_score", whole(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base))))
    s = F.col("risk_score")
    return df.select(
        "merchant_id",
        "risk_score",
        ladder([(s >= 70, "HIGH"), (s >= 40, "REVIEW")], "LOW").alias("risk_level"),
        ladder([(s >= 70, "MANUAL_REVIEW"), (s >= 40, "ADDITIONAL_VERIFICATION")], "NORMAL_FLOW").alias("action"),
    )


def unify_similarity(df: DataFrame) -> DataFrame:
    """H6. The index match replaces a weaker web match and clears the own-brand flag.

    Needs ``max_similarity``, ``is_own_brand``, ``local_similarity``.
    """
    web, local = F.coalesce(F.col("max_similarity"), F.lit(0.0)), F.coalesce(F.col("local_similarity"), F.lit(0.0))
    return df.withColumns(
        {
            "max_similarity": F.greatest(web, local),
            "is_own_brand": F.when(local > web, False).otherwise(F.coalesce(F.col("is_own_brand"), F.lit(True))),
        }
    )


def calibrate_reuse(df: DataFrame) -> DataFrame:
    """H5. Reuse score and level from the unified similarity and the kind of source.

    Needs ``max_similarity``, ``is_own_brand``, ``source_type`` (of the web candidate).
    """
    sim, src = F.col("max_similarity"), F.coalesce(F.col("source_type"), F.lit("NONE"))
    counts = ~F.col("is_own_brand") & (sim >= 0.70)
    over = sim - F.lit(0.70)
    df = df.withColumns(
        {
            "reuse_risk_score": ladder(
                [
                    (~counts, 0.0),
                    (src == "SUPPLIER_CATALOG", F.least(F.lit(20.0), F.lit(10.0) + over * F.lit(30.0))),
                    ((src == "MARKETPLACE") & (sim < 0.95), F.least(F.lit(35.0), F.lit(15.0) + over * F.lit(40.0))),
                    (sim >= 0.88, F.least(F.lit(100.0), F.lit(75.0) + (sim - F.lit(0.88)) / F.lit(0.12) * F.lit(25.0))),
                ],
                F.lit(40.0) + over / F.lit(0.18) * F.lit(35.0),
            ),
            "reuse_level": ladder(
                [
                    (~counts | (src == "SUPPLIER_CATALOG") | ((src == "MARKETPLACE") & (sim < 0.95)), "LOW"),
                    (sim >= 0.88, "HIGH"),
                ],
                "MEDIUM",
            ),
        }
    )
    return round_columns(df, {"reuse_risk_score": 1})


def override_with_batch(df: DataFrame, batch: DataFrame) -> DataFrame:
    """H7. Catalogue reuse (F7) replaces score and level where its maximum is larger."""
    b = batch.select(
        "merchant_id", F.col("max_similarity").alias("b_sim"), F.col("reuse_risk_score").alias("b_score"), F.col("risk_level").alias("b_level")
    )
    wins = F.coalesce(F.col("b_sim") > F.col("max_similarity"), F.lit(False))
    joined = df.join(b, "merchant_id", "left").withColumn("wins", wins)
    pick = lambda new, old: F.when(F.col("wins"), F.col(new)).otherwise(F.col(old))
    return joined.withColumns(
        {
            "reuse_risk_score": pick("b_score", "reuse_risk_score"),
            "reuse_level": pick("b_level", "reuse_level"),
            "max_similarity": pick("b_sim", "max_similarity"),
        }
    ).drop("b_sim", "b_score", "b_level", "wins")


def top_flagged(df: DataFrame) -> DataFrame:
    """H8. Best available match: index, else web candidate, else a placeholder.

    Needs max_similarity, local_similarity, masked_ids, local_url, local_domain,
    top_candidate_id, top_similarity, top_source_type, top_source_url,
    top_source_domain, top_explanation, match_explanation, web_source_type, reuse_level.
    """
    local = F.coalesce(F.col("local_similarity"), F.lit(0.0))
    use_local = (local >= 0.70) & (local >= F.col("max_similarity"))
    use_web = F.col("top_candidate_id").isNotNull()
    joined = F.array_join(F.coalesce("masked_ids", F.array().cast("array<string>")), ", ")
    names = F.when(joined == "", "platform merchants").otherwise(joined)
    none = F.lit(None).cast("string")
    pick = lambda a, b, c: F.when(use_local, a).when(use_web, b).otherwise(c)
    return df.withColumns(
        {
            "flag_kind": pick(F.lit("index"), F.lit("web"), F.lit("none")),
            "flag_similarity": pick(local, F.col("top_similarity"), F.col("max_similarity")),
            "flag_source_type": pick(F.lit("LOCAL_INDEX"), F.col("top_source_type"), F.coalesce("web_source_type", F.lit("NONE"))),
            "flag_source_url": pick(F.col("local_url"), F.col("top_source_url"), none),
            "flag_source_domain": pick(F.coalesce("local_domain", F.lit("platform-catalog.internal")), F.col("top_source_domain"), none),
            "flag_explanation": pick(
                text("Visual asset matches previously scanned merchant (", names, ") with ", percent(local), "% ViT similarity."),
                F.col("top_explanation"),
                F.coalesce("match_explanation", F.lit("No external matches found.")),
            ),
        }
    )


def override_status(df: DataFrame) -> DataFrame:
    """H9. CROSS_MERCHANT_REUSE where the index match is the best one."""
    local = F.coalesce(F.col("local_similarity"), F.lit(0.0))
    return df.withColumn(
        "match_status",
        F.when((local >= 0.70) & (local >= F.col("max_similarity")), "CROSS_MERCHANT_REUSE").otherwise(
            F.coalesce("match_status", F.lit("NO_EXTERNAL_MATCH"))
        ),
    )
