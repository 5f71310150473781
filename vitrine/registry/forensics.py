"""Queries of the forensic family (SURVEY G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets, forensics
from .core import query, sql_round, sql_text
from .selection import _selection, downloaded

_ELA = """e0 AS (SELECT asset_id, stddev_pop(energy) AS sd, max(energy) AS mx, avg(energy) AS m FROM {src} GROUP BY 1),
ela AS (SELECT asset_id, greatest(0::DOUBLE, least(100::DOUBLE, (sd / greatest(2.5::DOUBLE, m) * 20::DOUBLE + mx / greatest(2.5::DOUBLE, m) * 4.5::DOUBLE) * CASE WHEN sd / (m + 1e-6) < 0.2 THEN 0.15::DOUBLE WHEN sd / (m + 1e-6) < 0.4 THEN 0.5::DOUBLE ELSE 1::DOUBLE END
 * CASE WHEN m < 1.5 THEN m / 1.5::DOUBLE ELSE 1::DOUBLE END)) AS ela_score FROM e0)"""
# energies of three textures: faint, uniform and as delivered
_ENERGY = "en AS (SELECT asset_id, x, y, CASE asset_id % 3 WHEN 0 THEN energy WHEN 1 THEN 4::DOUBLE + energy / 10::DOUBLE ELSE energy / 5::DOUBLE END AS energy FROM v_block)"


def energies(t):
    e = F.when(F.col("asset_id") % 3 == 0, F.col("energy")).when(F.col("asset_id") % 3 == 1, F.lit(4.0) + F.col("energy") / F.lit(10.0)).otherwise(F.col("energy") / F.lit(5.0))
    return t.view("v_block").withColumn("energy", e)


@query("ela_disparity", "G1", f"WITH {_ENERGY}, {_ELA.format(src='en')} SELECT asset_id, round(ela_score, 6) AS ela_score FROM ela")
def _(t):
    return forensics.ela_scores(energies(t)).select("asset_id", F.round("ela_score", 6).alias("ela_score"))


_DIMS = "SELECT s_suppkey AS asset_id, CAST(120 + s_suppkey % 230 AS INT) AS width, CAST(90 + s_suppkey % 320 AS INT) AS height FROM supplier"


def _dims(t):
    return t.table("supplier").select(
        F.col("s_suppkey").alias("asset_id"), (F.lit(120) + F.col("s_suppkey") % 230).cast("int").alias("width"),
        (F.lit(90) + F.col("s_suppkey") % 320).cast("int").alias("height"),
    )


@query("block_energies", "G2", f"""WITH d AS ({_DIMS}), s AS (SELECT *, greatest(16, CAST(floor(least(width, height) / 16) AS INT)) AS side FROM d), p AS (SELECT b.asset_id, floor(y / side) AS byy, floor(x / side) AS bxx, energy, side, width, height FROM v_block b JOIN s USING (asset_id))
SELECT asset_id, CAST(byy AS BIGINT) AS by, CAST(bxx AS BIGINT) AS bx, round(avg(energy), 6) AS energy FROM p WHERE bxx < floor(width / side) AND byy < floor(height / side) GROUP BY 1, 2, 3""")
def _(t):
    return forensics.block_energies(t.view("v_block"), _dims(t)).select("asset_id", "by", "bx", F.round("energy", 6).alias("energy"))


_GRAD = """p95 AS (SELECT asset_id, quantile_cont(local_std, 0.95) AS p FROM gs GROUP BY 1),
grad AS (SELECT g.asset_id, any_value(p) AS p95, greatest(0::DOUBLE, least(100::DOUBLE, count(*) FILTER (local_std > p * 1.5::DOUBLE) / (count(local_std) + 1e-6) * 1800::DOUBLE)) AS gradient_score FROM gs g JOIN p95 USING (asset_id) GROUP BY 1)"""
_STD = "gs AS (SELECT asset_id, CASE WHEN cell % 41 = 0 THEN local_std * 3::DOUBLE ELSE local_std END AS local_std FROM v_block)"


def local_stds(t):
    return t.view("v_block").select(
        "asset_id", F.when(F.col("cell") % 41 == 0, F.col("local_std") * F.lit(3.0)).otherwise(F.col("local_std")).alias("local_std")
    )


@query("gradient_anomaly", "G3", f"WITH {_STD}, {_GRAD} SELECT asset_id, round(p95, 3) AS p95, round(gradient_score, 6) AS gradient_score FROM grad")
def _(t):
    return forensics.gradient_scores(local_stds(t)).select("asset_id", F.round("p95", 3).alias("p95"), F.round("gradient_score", 6).alias("gradient_score"))


_RINGS = """rg AS (SELECT asset_id, CASE WHEN ring <= 3 THEN 'inner' ELSE 'outer' END AS ring, CASE WHEN ring <= 3 THEN ring_value + 0.1::DOUBLE ELSE ring_value * (0.3::DOUBLE + (asset_id % 11) / 10::DOUBLE) END AS magnitude FROM v_block)"""
_SAT = "st AS (SELECT s_suppkey AS asset_id, (s_suppkey % 10) / 10::DOUBLE AS sat, CASE WHEN s_suppkey % 23 = 0 THEN 4::DOUBLE ELSE 30::DOUBLE END AS gstd FROM supplier)"


@query("synthetic_suspicion", "G4", f"""WITH {_RINGS}, {_SAT}, m AS (SELECT asset_id, avg(magnitude) FILTER (ring = 'inner') AS i, avg(magnitude) FILTER (ring = 'outer') AS o FROM rg GROUP BY 1),
r AS (SELECT st.*, coalesce(o, 1::DOUBLE) / (coalesce(i, 1::DOUBLE) + 1e-5) AS ratio FROM st LEFT JOIN m USING (asset_id)),
s AS (SELECT asset_id, gstd, CASE WHEN gstd < 8 THEN 5::DOUBLE ELSE greatest(5::DOUBLE, least(88::DOUBLE, CASE WHEN ratio < 0.35 AND sat > 0.40 THEN 65::DOUBLE + (0.35::DOUBLE - ratio) * 100::DOUBLE WHEN ratio < 0.42 AND sat > 0.25 THEN 40::DOUBLE + (0.42::DOUBLE - ratio) * 60::DOUBLE ELSE greatest(5::DOUBLE, least(30::DOUBLE, sat * 30::DOUBLE)) END)) END AS raw FROM r)
SELECT asset_id, {sql_round('raw', 1)} AS synthetic_score, CASE WHEN gstd < 8 THEN {sql_text(forensics.SYNTH_FLAT)} WHEN raw >= 60 THEN {sql_text(forensics.SYNTH_HIGH)} WHEN raw >= 35 THEN {sql_text(forensics.SYNTH_SOME)} ELSE {sql_text(forensics.SYNTH_NONE)} END AS synthetic_desc FROM s""")
def _(t):
    inner = F.col("ring") <= 3
    rings = t.view("v_block").select(
        "asset_id", F.when(inner, "inner").otherwise("outer").alias("ring"),
        F.when(inner, F.col("ring_value") + F.lit(0.1)).otherwise(F.col("ring_value") * (F.lit(0.3) + (F.col("asset_id") % 11) / F.lit(10.0))).alias("magnitude"),
    )
    images = t.table("supplier").select(
        F.col("s_suppkey").alias("asset_id"), ((F.col("s_suppkey") % 10) / F.lit(10.0)).alias("high_sat_ratio"),
        F.when(F.col("s_suppkey") % 23 == 0, 4.0).otherwise(30.0).alias("gray_std"),
    )
    return forensics.synthetic_scores(rings, images)


_BOXES = """SELECT l_suppkey AS asset_id, l_orderkey * 10 + l_linenumber AS box, CAST(l_partkey % 300 AS INT) AS x, CAST(l_orderkey % 200 AS INT) AS y, CAST(l_quantity AS INT) AS w, CAST(l_linenumber * 20 AS INT) AS h,
 l_quantity * l_linenumber * CASE WHEN l_suppkey % 4 = 0 THEN 10 WHEN l_suppkey % 4 = 1 THEN 0.01e0 ELSE 500 END AS area, CAST(320 AS INT) AS width, CAST(200 AS INT) AS height FROM lineitem"""


def _boxes(t):
    from .core import _bind_tables

    return t.spark.sql(_bind_tables(_BOXES, t.directory))


@query("suspicious_regions", "G5", f"WITH b AS ({_BOXES}) SELECT asset_id, box, x, y, w, h FROM b WHERE area > 64000 * 0.005::DOUBLE AND area < 64000 * 0.40::DOUBLE")
def _(t):
    return forensics.suspicious_regions(_boxes(t)).select("asset_id", "box", "x", "y", "w", "h")


def manipulation(t):
    images = t.table("supplier").select(
        F.col("s_suppkey").alias("asset_id"),
        F.when(F.col("s_suppkey") % 19 == 0, F.lit(None)).when(F.col("s_suppkey") % 17 == 0, 3.0).otherwise(40.0).cast("double").alias("image_std"),
    )
    return forensics.manipulation_scores(images, forensics.ela_scores(energies(t)), forensics.gradient_scores(local_stds(t)), forensics.suspicious_regions(_boxes(t)))


_MANIP = f"""{_ENERGY}, {_ELA.format(src='en')}, {_STD}, {_GRAD}, bx AS ({_BOXES}), rc AS (SELECT asset_id, count(*) AS n FROM bx WHERE area > 64000 * 0.005::DOUBLE AND area < 64000 * 0.40::DOUBLE GROUP BY 1),
im AS (SELECT s_suppkey AS asset_id, CASE WHEN s_suppkey % 19 = 0 THEN NULL WHEN s_suppkey % 17 = 0 THEN 3::DOUBLE ELSE 40::DOUBLE END AS sd FROM supplier),
mx AS (SELECT im.asset_id, sd IS NULL OR sd < 8 AS flat, coalesce(n, 0) AS n, CASE WHEN sd IS NULL OR sd < 8 THEN 5::DOUBLE ELSE greatest(0::DOUBLE, least(100::DOUBLE, 0.55::DOUBLE * coalesce(ela_score, 0) + 0.45::DOUBLE * coalesce(gradient_score, 0) + CASE WHEN n >= 2 THEN 10 WHEN n = 1 THEN 5 ELSE 0 END)) END AS raw
 FROM im LEFT JOIN ela USING (asset_id) LEFT JOIN grad USING (asset_id) LEFT JOIN rc USING (asset_id)),
manip AS (SELECT asset_id, {sql_round('raw', 1)} AS manipulation_score, CAST(CASE WHEN flat THEN 0 ELSE n END AS INT) AS region_count FROM mx)"""


@query("manipulation_scores", "G6", f"WITH {_MANIP} SELECT asset_id, manipulation_score, region_count, CASE WHEN manipulation_score >= 60 THEN 'HIGH' WHEN manipulation_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS manipulation_level FROM manip")
def _(t):
    return manipulation(t).drop("manipulation_explanation")


@query("forensic_evidence", "G8", f"""WITH {_MANIP}, k AS (SELECT asset_id, CASE asset_id % 3 WHEN 0 THEN 'certificate' ELSE 'product_image' END AS kind, CAST(round_even(manipulation_score, 0) AS INT) AS sc FROM manip)
SELECT asset_id, 'extracted_' || kind AS asset_url, kind AS asset_type, sc AS score, CASE WHEN sc >= 35 THEN format('Digital manipulation indicators detected in {{}} (forensic score: {{}}/100). Localized compression anomalies and high-frequency edge splicing identified.', kind, sc) ELSE format('No digital manipulation or splicing anomalies observed on {{}}.', kind) END AS explanation, sc >= 35 AS has_heatmap FROM k""")
def _(t):
    scored = manipulation(t).withColumns(
        {
            "asset_url": F.lit(None).cast("string"),
            "asset_type": F.when(F.col("asset_id") % 3 == 0, "certificate").otherwise("product_image"),
        }
    )
    return forensics.forensic_evidence(scored).drop("signal_type")


@query("forensic_targets", "G7", f"""WITH {_selection(5)}, o AS (SELECT merchant_id, img_ord, row_number() OVER (PARTITION BY merchant_id ORDER BY CASE role WHEN 'logo' THEN 0 WHEN 'certificate' THEN 1 WHEN 'banner' THEN 2 ELSE 3 END, no) AS slot FROM picked),
f AS (SELECT merchant_id, arg_min(img_ord, slot) AS i FROM o GROUP BY 1), d AS (SELECT merchant_id, min(img_ord) AS doc FROM v_image WHERE asset_type = 'certificate' AND merchant_id % 3 = 0 GROUP BY 1)
SELECT coalesce(f.merchant_id, d.merchant_id) AS merchant_id, coalesce(doc, i) AS target_asset, CASE WHEN doc IS NOT NULL THEN 'document' ELSE 'image' END AS target_kind FROM f FULL JOIN d USING (merchant_id)""")
def _(t):
    picked = assets.select_representatives(downloaded(t), limit=5).withColumn("asset_id", F.col("img_ord"))
    docs = t.view("v_image").filter((F.col("asset_type") == "certificate") & (F.col("merchant_id") % 3 == 0)).select("merchant_id", F.col("img_ord").alias("asset_id"))
    return forensics.forensic_targets(picked, docs)
