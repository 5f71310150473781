"""Labelled-case manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ladders import ladder

SCHEMA = """name string, category string, claimed_brand string, ground_truth string, ground_truth_risk_tier string,
 case_type string, expected_evidence_summary string,
 claims struct<inventory_claim:string, brand_claim:string, compliance_claim:string>,
 crawler_data struct<has_contact:boolean, has_policy:boolean, has_pricing:boolean, has_about:boolean, social_links:array<string>>"""

# Claims of a case that states none.
DEFAULT_CLAIMS = ("Self-reported product ownership.", "Claimed brand identity.", "Statutory registration disclosure.")
# The ids of the original evaluation set.
ORIGINAL_CASES = [
    "clean_01_artisanal_terracotta", "clean_02_flora_linen", "clean_03_artisan_leathercraft", "clean_04_aura_glassworks",
    "clean_05_timber_craft_studio", "clean_06_solstice_bespoke_gems", "bord_01_urban_distributor",
    "bord_02_audio_direct_outlet", "bord_03_metro_streetwear", "bord_04_commuter_utility_bags", "bord_05_sports_audio_lab",
    "bord_06_lifestyle_collective", "susp_01_stolen_chronographs", "susp_02_cloned_designer_leather",
    "susp_03_reused_airmax_store", "susp_04_pro_audio_clones", "susp_05_luxury_gold_horology",
    "susp_06_counterfeit_tote_bazaar",
]


def read_case_manifests(spark: SparkSession, root: str, original_only: bool = False) -> DataFrame:
    """Every ``meta.json`` below ``root`` as one case row."""
    raw = (
        spark.read.schema(SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "meta.json")
        .json(root)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    return case_rows(raw, original_only)


def case_rows(manifests: DataFrame, original_only: bool = False) -> DataFrame:
    """A2. Case id, folder category, ground truth (file value over folder default) and
    defaults of the optional fields, from rows with ``path`` and the manifest fields."""
    parts = F.split("path", "/")
    df = manifests.withColumns({"case_id": F.element_at(parts, -2), "folder": F.element_at(parts, -3)})
    df = df.filter(F.col("folder").isin("clean", "borderline", "suspicious"))
    if original_only:
        df = df.filter(F.col("case_id").isin(ORIGINAL_CASES))
    default = ladder([(F.col("folder") == "clean", "LOW"), (F.col("folder") == "borderline", "MEDIUM")], "HIGH")
    df = df.withColumn("ground_truth", F.coalesce("ground_truth", default))
    return df.withColumns(
        {
            "ground_truth_risk_tier": F.coalesce("ground_truth_risk_tier", "ground_truth"),
            "case_type": F.coalesce("case_type", F.lit("unspecified")),
            "expected_evidence_summary": F.coalesce("expected_evidence_summary", F.lit("Standard evaluation case.")),
            "merchant_name": F.coalesce("name", "case_id"),
            "claims": F.coalesce(
                "claims",
                F.struct(
                    F.lit(DEFAULT_CLAIMS[0]).alias("inventory_claim"),
                    F.lit(DEFAULT_CLAIMS[1]).alias("brand_claim"),
                    F.lit(DEFAULT_CLAIMS[2]).alias("compliance_claim"),
                ),
            ),
        }
    ).drop("path", "name")
