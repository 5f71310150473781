"""From crawl tables to one decision per merchant.

Failed crawls are separated before any image work and joined again at the end. Every
intermediate is keyed by merchant_id with at most one row per merchant, except the
selected images (at most ``limit`` per merchant) and their matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls
from ..operators import assets, candidates, crawl, evidence, explain, forensics, logos, pages, scoring, similarity
from ..sources.index import build_index

SELECTED = 5
#: Products that a claim speaks of at most, as the list in a report is cut to so many.
CLAIMED_PRODUCTS = 12


@dataclass(frozen=True)
class ReportInputs:
    """Tables of one analysis run.

    merchants: merchant_id, domain, claimed_brand; attempts: merchant_id, attempt_no,
    error_class, http_status, error_msg, is_root; pages: merchant_id, page_id, url, html;
    fetched: src, asset_hash, width, height, n_bytes, dhash, embedding;
    web: asset_hash, k, candidate_id, source_domain, source_url, embedding;
    index: asset_hash, merchant_id, domain, embedding (A5);
    registry: filename, embedding; blocks: asset_hash, energy; stds: asset_hash,
    local_std; regions: asset_hash, x, y, w, h, area, width, height;
    photos: asset_hash, image_std, gray_std, high_sat_ratio; rings: asset_hash, ring, magnitude.
    Where given, catalogue: filename, embedding of reference images whose reuse replaces a weaker match (H7), and
    documents: merchant_id, asset_id of documents handed in, which are examined instead of the first image (G7).
    """

    merchants: DataFrame
    attempts: DataFrame
    pages: DataFrame
    fetched: DataFrame
    web: DataFrame
    index: DataFrame
    registry: DataFrame
    blocks: DataFrame
    stds: DataFrame
    regions: DataFrame
    photos: DataFrame
    rings: DataFrame
    catalogue: DataFrame | None = None
    documents: DataFrame | None = None


@dataclass(frozen=True)
class MerchantReport:
    """candidates, provenance, fingerprints, signals, tier_explanations: H10, I15-I17 of the same run;
    analysed_assets: what the cross-merchant index takes up once the report stands (A5);
    image_sources: the images (merchant_id, src) that the crawled pages show, for a later refresh.
    """

    decisions: DataFrame
    evidence: DataFrame
    claims: DataFrame
    conclusions: DataFrame
    selected: DataFrame
    candidates: DataFrame
    provenance: DataFrame
    fingerprints: DataFrame
    signals: DataFrame
    tier_explanations: DataFrame
    analysed_assets: DataFrame
    image_sources: DataFrame


def crawl_outcomes(inputs: ReportInputs) -> DataFrame:
    typed = inputs.attempts.withColumn(
        "error_type", crawl.attempt_error(F.col("error_class"), F.col("http_status"), F.col("error_msg"))
    )
    return inputs.merchants.join(crawl.merchant_crawl_status(typed), "merchant_id", "left")


def selected_images(live_pages: DataFrame, fetched: DataFrame, names: DataFrame, limit: int = SELECTED) -> DataFrame:
    """The representative images of each merchant (E1-E12), with their vectors.

    Images are chosen by narrow rows that name their vector (:func:`~vitrine.operators.similarity.vector_key`); the vectors
    themselves are fetched for the chosen ones alone.
    """
    key = similarity.vector_key(F.col("embedding"))
    images = pages.page_images(live_pages).withColumn("img_ord", F.struct("page_id", "pos"))
    wanted = assets.download_candidates(assets.useful_images(images.drop("width", "height")))
    downloaded = assets.size_filter(assets.download_gate(wanted.join(fetched.withColumns(key).drop("embedding"), "src")))
    named = downloaded.join(names, "merchant_id", "left").withColumn("asset_ord", F.col("fetch_no").cast("long")).checkpoint()
    leaders = assets.perceptual_clusters(named, group_limit=None).filter("is_leader")
    chosen = assets.select_representatives(leaders, limit).checkpoint()
    shown = fetched.select("src", "embedding").join(chosen.select("src").distinct(), "src", "left_semi").withColumns(key)
    vectors = shown.groupBy("src", *key).agg(F.any_value("embedding").alias("embedding"))
    return chosen.join(vectors, ["src", *key]).drop(*key).withColumn(
        "asset_key", F.concat_ws("|", F.col("merchant_id").cast("string"), F.col("slot").cast("string"))
    )


def _forensics(targets: DataFrame, inputs: ReportInputs) -> DataFrame:
    """Manipulation and synthetic scores of the distinct target images only.

    Each score is written before the next: joined in one plan, they read the cells nine times and the driver held them all at once.
    """
    wanted = targets.select(F.col("target_asset").alias("asset_hash")).distinct()
    pick = lambda df: df.join(wanted, "asset_hash", "left_semi").withColumnRenamed("asset_hash", "asset_id")
    photos = pick(inputs.photos)
    scores = forensics.manipulation_scores(
        photos.select("asset_id", "image_std"),
        forensics.ela_scores(pick(inputs.blocks)).checkpoint(),
        forensics.gradient_scores(pick(inputs.stds).checkpoint()).checkpoint(),  # percentiles read the cells of the targets several times
        forensics.suspicious_regions(pick(inputs.regions)),
    ).checkpoint()
    synthetic = forensics.synthetic_scores(pick(inputs.rings), photos.select("asset_id", "gray_std", "high_sat_ratio")).checkpoint()
    per_asset = scores.join(synthetic, "asset_id", "left").withColumnRenamed("asset_id", "target_asset")
    return targets.join(per_asset, "target_asset", "left").select(
        "merchant_id",
        F.coalesce("manipulation_score", F.lit(5.0)).alias("manipulation_score"),
        F.coalesce("synthetic_score", F.lit(5.0)).alias("synthetic_score"),
        F.coalesce("manipulation_level", F.lit("LOW")).alias("manipulation_level"),
        F.coalesce("region_count", F.lit(0)).alias("region_count"),
    )


def _index_verdicts(selected: DataFrame, index: DataFrame) -> DataFrame:
    """Cross-merchant verdict of every selected image, with the domain of its best match."""
    keyed = selected.select("asset_key", "asset_hash", "merchant_id", "domain", "embedding", "slot", "src")
    matches = similarity.index_matches(keyed, index, key="asset_key")
    first = matches.filter("match_no = 1").select("asset_key", F.col("member_domain").alias("match_domain"))
    return similarity.index_verdicts(keyed, matches, key="asset_key").join(first, "asset_key", "left")


def _platform_rows(verdicts: DataFrame) -> DataFrame:
    """The images with a cross-merchant match, numbered per merchant in their order, for the list of candidates."""
    order = Window.partitionBy("merchant_id").orderBy("slot")  # a merchant has its few selected images only
    return verdicts.filter(F.col("local_similarity") >= candidates.MODERATE).select(
        F.col("merchant_id").alias("asset_id"), F.row_number().over(order).alias("seq"), F.col("local_similarity").alias("similarity"),
        "masked_ids", F.col("match_domain").alias("domain"), F.col("src").alias("asset_url"),
    )


def _index_part(verdicts: DataFrame) -> DataFrame:
    """Best cross-merchant match per merchant over its selected images."""
    best = F.struct("local_similarity", (-F.col("slot")).alias("o"))
    return verdicts.groupBy("merchant_id").agg(
        F.max("local_similarity").alias("local_similarity"),
        F.max_by(F.struct("masked_ids", F.col("src").alias("local_url")), best).alias("top"),
        F.count_if(F.col("local_similarity") >= 0.70).alias("n_platform"),
    ).select("merchant_id", "local_similarity", "top.masked_ids", "top.local_url", "n_platform")


def _catalogue_reuse(selected: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Batch reuse (F7) of the selected images of each merchant against the catalogue."""
    images = selected.select(F.col("asset_key").alias("asset_id"), "merchant_id", "embedding")
    matches = similarity.catalogue_matches(images, catalogue, 1)
    return similarity.batch_reuse(similarity.catalogue_reuse(images, matches))


def updated_index(index: DataFrame, report: MerchantReport, at: Column) -> DataFrame:
    """The cross-merchant index after the report: its analysed assets written at time ``at``, the last write of a hash wins.

    ``index``: asset_hash, merchant_id, domain, embedding, ts. A merchant's own assets are matched against the index as it
    was before the report, so this comes last.
    """
    fresh = report.analysed_assets.select("asset_hash", F.col("merchant_id").cast(index.schema["merchant_id"].dataType), "domain", "embedding", at.cast(index.schema["ts"].dataType).alias("ts"))
    return build_index(index.select("asset_hash", "merchant_id", "domain", "embedding", "ts").unionByName(fresh))


def build_report(
    inputs: ReportInputs, *, primary_only: bool = True, selected_images_per_merchant: int = SELECTED, max_pages: int = pages.MAX_PAGES
) -> MerchantReport:
    """Decisions, evidence, claims and conclusions of every merchant.

    ``primary_only`` compares web candidates with the first selected image alone, else with each one;
    the other parameters are the images and the pages that a merchant is judged by.
    """
    outcomes = crawl_outcomes(inputs).checkpoint()
    live = outcomes.filter("crawl_status = 'SUCCESS' OR crawl_status IS NULL")  # no crawl row: scored with neutral facts
    # only the keys of the crawled pages are kept; their HTML is read from its table again
    kept = pages.crawled_pages(inputs.pages.select("merchant_id", "page_id").join(live.select("merchant_id"), "merchant_id", "left_semi"), max_pages).drop("page_no").checkpoint()
    live_pages = inputs.pages.join(kept, ["merchant_id", "page_id"], "left_semi")
    facts = pages.crawl_facts(live_pages, max_pages).drop("crawl_status").checkpoint()
    selected = selected_images(live_pages, inputs.fetched, facts.select("merchant_id", "merchant_name", "domain"), selected_images_per_merchant).checkpoint()

    # candidates for the searched images (F10-F13)
    searched = selected.filter("slot = 1") if primary_only else selected
    primary = searched.select(
        F.col("merchant_id").alias("asset_id"), "asset_hash", F.col("domain").alias("merchant_domain"), F.col("embedding").alias("asset_embedding")
    )
    # what the search returned for other images is left out before its vectors travel
    web = inputs.web.join(primary.select("asset_hash").distinct(), "asset_hash", "left_semi")
    pairs = web.filter(F.col("embedding").isNotNull()).join(primary, "asset_hash")
    verified = candidates.verify_candidates(pairs).checkpoint()
    web = candidates.match_status(live.select(F.col("merchant_id").alias("asset_id")), verified).withColumnRenamed("asset_id", "merchant_id")

    verdicts = _index_verdicts(selected, inputs.index).checkpoint()
    local = _index_part(verdicts)
    listed = candidates.candidate_list(verified, _platform_rows(verdicts)).withColumnRenamed("asset_id", "merchant_id").checkpoint()
    n_listed = listed.groupBy("merchant_id").agg(F.count("*").cast("int").alias("n_candidates"))
    coherence = similarity.identity_coherence(selected.select("merchant_id", "embedding"), live).select("merchant_id", "coherence_score").checkpoint()
    logo_images = selected.filter("role = 'logo'").groupBy("merchant_id").agg(F.min_by("embedding", "slot").alias("embedding"))
    brands = live.select("merchant_id", "claimed_brand").join(facts.select("merchant_id", "merchant_name"), "merchant_id", "left")
    brands = brands.withColumn("claimed_brand", F.coalesce("claimed_brand", "merchant_name")).join(logo_images, "merchant_id", "left")
    brands = brands.select("merchant_id", "claimed_brand", "embedding").checkpoint()
    logo = logos.logo_consistency(brands, inputs.registry).select(
        "merchant_id", "logo_similarity", "logo_risk", "matched_logo", "logo_level"
    ).checkpoint()
    documents = None if inputs.documents is None else inputs.documents.join(live.select("merchant_id"), "merchant_id", "left_semi")
    targets = forensics.forensic_targets(selected.withColumn("asset_id", F.col("asset_hash")), documents).select("merchant_id", "target_asset").checkpoint()
    forensic = _forensics(targets, inputs)
    counts = selected.groupBy("merchant_id").agg(F.count("*").cast("int").alias("image_count"), F.bool_or(F.col("role") == "logo").alias("has_logo"))

    fact_columns = ["merchant_id", "merchant_name", "n_products", "n_social", "site_category", "has_contact", "has_policy",
                    "has_pricing", "has_about"]
    wide = live.select("merchant_id", "domain", "crawl_status").withColumn("crawl_error", F.lit(None).cast("string"))
    with_document = live.select("merchant_id").limit(0) if documents is None else documents.select("merchant_id").distinct()
    for part in (with_document.withColumn("has_document", F.lit(True)), facts.select(fact_columns), web, local, coherence, logo, forensic, counts, n_listed):
        wide = wide.join(part, "merchant_id", "left")
    wide = wide.withColumns(
        {
            "manipulation_score": F.coalesce("manipulation_score", F.lit(5.0)),
            "synthetic_score": F.coalesce("synthetic_score", F.lit(5.0)),
            "image_count": F.coalesce("image_count", F.lit(0)),
            "n_candidates": F.coalesce("n_candidates", F.lit(0)),
            "has_document": F.coalesce("has_document", F.lit(False)),
            "source_type": F.col("top_source_type"),
        }
    ).checkpoint()  # one narrow row per merchant; what follows is row-local
    calibrated = evidence.calibrate_reuse(evidence.unify_similarity(wide))
    if inputs.catalogue is not None:
        calibrated = evidence.override_with_batch(calibrated, _catalogue_reuse(selected, inputs.catalogue).checkpoint())
    unified = calibrated.withColumns(
        {
            "local_domain": F.lit("platform-merchants"),
            "top_explanation": F.col("match_explanation"),
            "web_source_type": F.col("top_source_type"),
        }
    )
    flagged = evidence.override_status(evidence.top_flagged(unified)).withColumns(
        {
            "source_type": F.col("flag_source_type"),
            "source_domain": F.col("flag_source_domain"),
            "reference_filename": F.col("top_filename"),
            # a report's reuse result carries no mean and no top-k similarity; their default counts (also after H7)
            "average_similarity": F.lit(0.0),
            "top_k_similarity": F.lit(0.0),
        }
    )
    decided = explain.risk_explanation(explain.reasons(scoring.decide(flagged))).checkpoint()

    web_top = F.col("top_candidate_id").isNotNull()
    evidence_input = decided.withColumns(
        {
            "has_top": F.lit(True),
            "top_similarity": F.when(web_top, F.col("top_similarity")).otherwise(F.col("flag_similarity")),
            "top_source_type": F.when(web_top, F.col("top_source_type")).otherwise(F.col("flag_source_type")),
            "top_source_domain": F.when(web_top, F.col("top_source_domain")).otherwise(F.col("flag_source_domain")),
            "top_source_url": F.when(web_top, F.col("top_source_url")).otherwise(F.col("flag_source_url")),
        }
    )
    found = explain.structured_evidence(evidence_input)

    failed = explain.unverifiable_decision(
        outcomes.filter("crawl_status <> 'SUCCESS'").withColumn("merchant_name", urls.domain_to_name(F.col("domain")))
    )
    columns = ["merchant_id", "merchant_name", "domain", "crawl_status", "final_score", "text_risk_score", "visual_risk_score",
               "status", "status_tier", "status_label", "recommendation", "badge_color", "reasons", "is_unverifiable", "crawl_error"]
    scored = decided.withColumn("is_unverifiable", F.lit(False))
    extra = ["site_category", "has_contact", "has_policy", "has_about", "n_products", "risk_explanation", "match_status",
             "max_similarity", "reuse_risk_score", "e4_score", "logo_risk", "manipulation_score", "coherence_score",
             "severe_count", "image_count"]
    decisions = scored.select(columns + extra).unionByName(failed.select(columns), allowMissingColumns=True)
    claim_rows = crawl.claim_texts(decisions.withColumn("n_products", F.least("n_products", F.lit(CLAIMED_PRODUCTS))))
    claims = explain.claim_matrix(claim_rows, found)
    states = scored.unionByName(failed, allowMissingColumns=True)
    # a failed crawl has looked at nothing
    looked_at = decided.select("merchant_id", F.col("image_count").alias("n_products"), "has_logo", "n_candidates", "has_document")
    looked_at = looked_at.unionByName(failed.select("merchant_id"), allowMissingColumns=True).select(
        "merchant_id", F.coalesce("n_products", F.lit(0)).alias("n_products"), "has_logo",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("has_document", F.lit(False)).alias("has_document"), F.lit(False).alias("is_fallback_extractor"),
    )
    return MerchantReport(
        decisions=decisions,
        evidence=found,
        claims=claims,
        conclusions=explain.conclusions(decisions, found),
        selected=selected,
        candidates=listed,
        provenance=explain.provenance(looked_at, found),
        fingerprints=explain.fingerprint(states),
        signals=explain.decision_signals(decided),
        tier_explanations=explain.tier_explanation(states),
        analysed_assets=selected.select("asset_hash", "merchant_id", "domain", "embedding", "src"),
        image_sources=pages.page_images(live_pages).select("merchant_id", "src").distinct(),
    )
