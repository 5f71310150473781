"""A report brought up to date for the merchants that a change of the inputs can reach.

Changed rows are found by comparing fingerprints. A changed row of a merchant's own tables reaches that merchant; one of a
shared table reaches the merchants whose images, brands or matches it takes part in. These merchants are reported anew
with the same plan, the others keep their rows.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, functions as F

from ..operators import logos, similarity
from .merchant_report import MerchantReport, ReportInputs, build_report

#: Parts of a report with one or more rows for each merchant.
PARTS = [f.name for f in fields(MerchantReport)]


def changed_rows(old: DataFrame | None, new: DataFrame | None, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` of the rows that only one of two versions of a table has, repeated rows counted.

    Rows are compared by 128 bits, summed in the map tasks, so a hot key costs a row for each of its different rows.
    """
    known = [df for df in (old, new) if df is not None]
    if not known:
        raise ValueError("at least one version of the table is needed")
    columns = sorted(c for c in known[0].columns)

    def side(df: DataFrame | None, sign: int) -> DataFrame:
        df = known[0].limit(0) if df is None else df
        shown = [F.to_json(F.struct(*columns)), F.lit(sign)]
        return df.select(*keys, F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.reverse(shown[0])).alias("_h2"), shown[1].alias("_n"))

    both = side(old, 1).unionByName(side(new, -1))
    return both.groupBy(*keys, "_h1", "_h2").agg(F.sum("_n").alias("_n")).filter("_n <> 0").select(*keys).distinct()


def _versions(old: DataFrame | None, new: DataFrame | None, key: str) -> DataFrame:
    """All rows, of both versions, of the keys that have changed."""
    touched = changed_rows(old, new, [key])
    rows = [df.join(touched, key, "left_semi") for df in (old, new) if df is not None]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def affected_merchants(old: ReportInputs, new: ReportInputs, report: MerchantReport) -> DataFrame:
    """(merchant_id) of the merchants whose report may differ between two versions of the inputs.

    ``report`` is that of ``old``. Index entries reach the merchants with a selected image within the index's threshold of
    an old or new version of them; catalogue files those with an image that is as close to one as to its best file so far;
    registry files those whose brand they belong to. A registry that becomes empty, or stops being so, reaches all.
    """
    own = [changed_rows(a, b, ["merchant_id"]) for a, b in ((old.merchants, new.merchants), (old.attempts, new.attempts), (old.pages, new.pages))]
    if old.documents is not None or new.documents is not None:
        own.append(changed_rows(old.documents, new.documents, ["merchant_id"]))
    own.append(changed_rows(old.fetched, new.fetched, ["src"]).join(report.image_sources, "src").select("merchant_id"))

    shown = report.selected.select("merchant_id", "asset_hash", "asset_key", "domain", "embedding")
    examined = shown.select("merchant_id", "asset_hash")
    if old.documents is not None:
        examined = examined.unionByName(old.documents.select("merchant_id", F.col("asset_id").alias("asset_hash")))
    for name in ("web", "blocks", "stds", "regions", "photos", "rings"):
        own.append(changed_rows(getattr(old, name), getattr(new, name), ["asset_hash"]).join(examined, "asset_hash").select("merchant_id"))

    entries = _versions(old.index, new.index, "asset_hash")
    numbered = entries.withColumn("asset_hash", F.concat_ws("|", "asset_hash", F.lit("entry")))  # an asset may meet its own entry
    met = similarity.index_matches(shown, numbered, 1, "asset_key").select("asset_key")
    own.append(shown.join(met, "asset_key").select("merchant_id"))

    files = _versions(old.registry, new.registry, "filename")
    facts = report.decisions.select("merchant_id", "merchant_name")
    claimed = old.merchants.select("merchant_id", "claimed_brand").unionByName(new.merchants.select("merchant_id", "claimed_brand")).distinct()
    brands = claimed.join(facts, "merchant_id", "left").select("merchant_id", F.coalesce("claimed_brand", "merchant_name").alias("claimed_brand"))
    if old.registry.isEmpty() != new.registry.isEmpty():
        own.append(brands.select("merchant_id"))
    else:
        own.append(brands.join(logos.brand_references(brands, files).select("claimed_brand").distinct(), "claimed_brand").select("merchant_id"))

    if old.catalogue is not None or new.catalogue is not None:
        images = shown.select(F.col("asset_key").alias("asset_id"), "embedding")
        fresh = similarity.catalogue_matches(images, _versions(old.catalogue, new.catalogue, "filename"), 1).select("asset_id", F.col("similarity").alias("fresh"))
        best = fresh.withColumn("best", F.lit(None).cast("double"))
        if old.catalogue is not None:
            best = fresh.join(similarity.catalogue_matches(images, old.catalogue, 1).select("asset_id", F.col("similarity").alias("best")), "asset_id", "left")
        own.append(shown.join(best.filter("fresh >= coalesce(best, 0)").select(F.col("asset_id").alias("asset_key")), "asset_key").select("merchant_id"))

    out = own[0]
    for more in own[1:]:
        out = out.unionByName(more)
    return out.distinct()


@dataclass(frozen=True)
class Refreshed:
    report: MerchantReport
    affected: DataFrame


def refresh_report(old: ReportInputs, new: ReportInputs, report: MerchantReport, **limits) -> Refreshed:
    """The report of ``new``, in which only affected merchants are worked out again.

    ``report`` is the report of ``old``, best read from where it was written; ``limits`` are those of
    :func:`~vitrine.plans.merchant_report.build_report` and have to be the same as then.
    """
    affected = affected_merchants(old, new, report).checkpoint()
    of = lambda df: df.join(affected, "merchant_id", "left_semi")
    part = build_report(replace(new, merchants=of(new.merchants), attempts=of(new.attempts), pages=of(new.pages)), **limits)
    merged = {}
    for name in PARTS:
        kept = getattr(report, name).join(affected, "merchant_id", "left_anti")
        merged[name] = kept.unionByName(getattr(part, name), allowMissingColumns=True)
    return Refreshed(MerchantReport(**merged), affected)
