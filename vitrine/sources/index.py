"""Cross-merchant index table and catalogue manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ladders import ladder

IMAGE_FILES = r"(?i)\.(jpg|jpeg|png|webp|bmp)$"


def build_index(assets: DataFrame) -> DataFrame:
    """A5. One row per content hash, the last write wins, rows without a hash are left out.

    Needs asset_hash, ts; ties of ``ts`` go to the larger merchant_id. The aggregate
    combines on the map side, so a hash with very many writes stays one row per task.
    """
    rest = [c for c in assets.columns if c not in ("asset_hash",)]
    return (
        assets.filter(F.coalesce(F.col("asset_hash"), F.lit("")) != "")
        .groupBy("asset_hash")
        .agg(F.max_by(F.struct(*rest), F.struct("ts", "merchant_id")).alias("a"))
        .select("asset_hash", "a.*")
    )


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """A6. Added, removed and kept image files between two manifests (column filename)."""
    keep = lambda df: df.filter(F.col("filename").rlike(IMAGE_FILES)).select("filename").distinct()
    a, b = keep(old).withColumn("in_old", F.lit(True)), keep(new).withColumn("in_new", F.lit(True))
    return a.join(b, "filename", "full").select(
        "filename",
        ladder([(F.col("in_old").isNull(), "added"), (F.col("in_new").isNull(), "removed")], "kept").alias("change"),
    )
