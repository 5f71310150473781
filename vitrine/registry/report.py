"""The whole workflow over tables that Spark derives from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import pages
from ..plans.merchant_report import MerchantReport, ReportInputs, build_report
from ..session import checkpoint_dir, dropping_shuffles
from .core import Tables, query


def _with_vector(df: DataFrame, t: Tables, seed: str) -> DataFrame:
    """A vector of the embeddings table per row, chosen by a hash of ``seed``."""
    vectors = t.table("embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = F.lit(t.table("embeddings").count())
    return df.withColumn("v", F.pmod(F.xxhash64(seed), n)).join(vectors, "v").drop("v")


def report_inputs(t: Tables) -> ReportInputs:
    checkpoint_dir(t.spark)
    html = t.view("v_html")
    merchants = html.select("merchant_id").distinct().withColumns(
        {
            "domain": F.concat(F.lit("shop"), F.col("merchant_id").cast("string"), F.lit(".example.com")),
            "claimed_brand": F.when(F.col("merchant_id") % 4 == 0, "Luxe Atelier"),
        }
    )
    # the scan of the pages is written, without the vectors: whoever needs some of those joins them to the rows it keeps
    sources = pages.page_images(html).select("src").distinct().checkpoint()
    h = lambda n, salt: F.pmod(F.xxhash64(F.col("src"), F.lit(salt)), F.lit(n))
    fetched = _with_vector(sources, t, "src").select(
        "src", F.sha2("src", 256).alias("asset_hash"), (h(900, 1) + 60).cast("int").alias("width"), (h(700, 2) + 60).cast("int").alias("height"),
        (h(900000, 3) + 2000).alias("n_bytes"), F.xxhash64("src").alias("dhash"), "embedding",
    )
    hashes = fetched.select("asset_hash", F.col("embedding").alias("own"))
    spread = hashes.select("asset_hash", "own", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k"))
    seeded = _with_vector(spread.withColumn("seed", F.concat("asset_hash", F.col("k").cast("string"))), t, "seed")
    close = F.pmod(F.xxhash64("asset_hash"), F.lit(3)) == 0
    web = seeded.select(
        "asset_hash", "k", F.concat(F.lit("c"), F.col("k").cast("string")).alias("candidate_id"),
        F.element_at(F.array(F.lit("rival-one.com"), F.lit("www.pinterest.com"), F.lit("rival-two.org")), F.col("k") + 1).alias("source_domain"),
        F.lit("https://web.example/p").alias("source_url"), F.when(close, F.col("own")).otherwise(F.col("embedding")).alias("embedding"),
    )
    index = t.view("v_asset").select("asset_hash", (F.col("merchant_id") + 100000).alias("merchant_id"), F.concat(F.lit("old"), "domain").alias("domain"), "embedding")
    # every line item is a cell of one image
    n_assets = F.lit(max(1, fetched.count()))
    cells = t.table("lineitem").select(F.pmod(F.xxhash64("l_orderkey"), n_assets).alias("g"), (F.col("l_quantity") / 10).alias("energy"), (F.col("l_extendedprice") / 1000).alias("local_std"), F.col("l_discount").alias("magnitude"), "l_linenumber", "l_partkey")
    grouped = fetched.select("asset_hash", F.pmod(F.xxhash64("asset_hash"), n_assets).alias("g"))
    textured = grouped.join(cells, "g")
    photos = fetched.select("asset_hash", F.lit(40.0).alias("image_std"), F.lit(30.0).alias("gray_std"), (F.pmod(F.xxhash64("asset_hash"), F.lit(10)) / 10).alias("high_sat_ratio"))
    catalogue = t.view("v_asset").filter("batch_no = 0").select(F.concat(F.lit("ref_"), F.col("asset_id").cast("string"), F.lit(".jpg")).alias("filename"), "embedding")
    # every fifth merchant hands in documents
    handed = hashes.select(F.pmod(F.xxhash64("asset_hash"), F.lit(1000)).alias("merchant_id"), F.col("asset_hash").alias("asset_id")).filter("merchant_id % 5 = 0")
    return ReportInputs(
        catalogue=catalogue,
        documents=handed,
        merchants=merchants,
        attempts=t.view("v_attempt"),
        pages=html,
        fetched=fetched,
        web=web,
        index=index,
        registry=t.view("v_logo_registry"),
        blocks=textured.select("asset_hash", "energy"),
        stds=textured.select("asset_hash", "local_std"),
        regions=textured.select("asset_hash", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"), F.lit(900.0).alias("area"), F.lit(320).alias("width"), F.lit(200).alias("height")),
        photos=photos,
        rings=textured.select("asset_hash", F.when(F.col("l_linenumber") <= 3, "inner").otherwise("outer").alias("ring"), "magnitude"),
    )


def merchant_report(t: Tables) -> MerchantReport:
    with dropping_shuffles(t.spark):
        return build_report(report_inputs(t))


@query("merchant_decisions", "I18")
def _(t):
    d = merchant_report(t).decisions
    return d.withColumn("reasons", F.array_join("reasons", " || "))


@query("merchant_claim_reports", "I18")
def _(t):
    r = merchant_report(t)
    return r.claims.join(r.conclusions.select("merchant_id", "conclusion"), "merchant_id")
