"""Known-domain lookups.

The built-in lists are short and fixed, so a lookup is one regular expression per row
inside the code-generated stage. ``match_domain_table`` serves lists that grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ladders import ladder
from .urls import clean_domain

# Multi-vendor marketplaces.
MARKETPLACES = [
    "amazon.com", "amazon.in", "flipkart.com", "aliexpress.com", "ebay.com", "walmart.com", "alibaba.com",
    "etsy.com", "myntra.com", "ajio.com", "target.com", "shopee.com", "lazada.com", "temu.com", "shein.com",
]
# Stock photography sites.
STOCK_SITES = [
    "shutterstock.com", "gettyimages.com", "freepik.com", "istockphoto.com", "unsplash.com", "pexels.com",
    "stock.adobe.com", "pixabay.com", "dreamstime.com",
]
# Image aggregators and social image boards.
IMAGE_AGGREGATORS = [
    "pinterest.com", "pinimg.com", "imgur.com", "googleusercontent.com", "ggpht.com", "wikimedia.org",
    "wikipedia.org", "staticflickr.com", "flickr.com", "instagram.com", "cdninstagram.com", "tumblr.com",
    "reddit.com", "redd.it",
]
# Wholesale and supplier catalogues.
SUPPLIERS = [
    "alibaba.com", "aliexpress.com", "dhgate.com", "made-in-china.com", "1688.com", "taobao.com", "indiamart.com",
    "tradeindia.com", "globalsources.com", "chinabrands.com", "wholesale7.net", "shein.com", "temu.com",
    "catalog-archive.internal", "archive.merchant-catalog.org", "merchant-catalog.org",
    "supplier-catalog.internal", "supplier-catalog.org",
]
# Marketplaces, suppliers and stock sites whose matches carry little weight.
SOFT_TRUST = [
    "amazon.com", "amazon.in", "flipkart.com", "aliexpress.com", "ebay.com", "walmart.com", "alibaba.com",
    "etsy.com", "myntra.com", "ajio.com", "target.com", "shopee.com", "lazada.com", "temu.com", "shein.com",
    "dhgate.com", "made-in-china.com", "indiamart.com", "tradeindia.com", "globalsources.com", "chinabrands.com",
    "wholesale7.net", "shutterstock.com", "gettyimages.com", "freepik.com", "istockphoto.com", "unsplash.com",
    "pexels.com", "stock.adobe.com", "pixabay.com", "dreamstime.com", "catalog-archive.internal",
    "archive.merchant-catalog.org", "merchant-catalog.org", "supplier-catalog.internal", "supplier-catalog.org",
]
# Words that mark a supplier host.
SUPPLIER_WORDS = ["supplier", "wholesale", "distributor"]


def in_list(clean: Column, domains: list[str]) -> Column:
    """``clean`` equals a listed domain or is a subdomain of one."""
    alternatives = "|".join(d.replace(".", r"\.") for d in domains)
    return clean.rlike(rf"(^|\.)({alternatives})$")


def is_marketplace(domain: Column) -> Column:
    """B6."""
    return in_list(clean_domain(domain), MARKETPLACES)


def is_stock(domain: Column) -> Column:
    """B7. Stock sites and image aggregators."""
    return in_list(clean_domain(domain), STOCK_SITES + IMAGE_AGGREGATORS)


def is_image_aggregator(domain: Column) -> Column:
    """B8."""
    return in_list(clean_domain(domain), IMAGE_AGGREGATORS)


def is_supplier(domain: Column) -> Column:
    """B9. Listed supplier catalogue, or a host that says so."""
    clean = clean_domain(domain)
    return in_list(clean, SUPPLIERS) | clean.rlike("|".join(SUPPLIER_WORDS))


def is_soft_trust(domain: Column) -> Column:
    """B10. Marketplace, stock, aggregator or supplier."""
    return in_list(clean_domain(domain), SOFT_TRUST + IMAGE_AGGREGATORS) | is_supplier(domain)


def classify_source(own: Column, supplier: Column, soft: Column, given: Column) -> Column:
    """B11. Own domain, then supplier, then soft trust, else the type as delivered."""
    return ladder(
        [(own, "OWN_DOMAIN"), (supplier, "SUPPLIER_CATALOG"), (soft, "SOFT_TRUST")],
        F.coalesce(given, F.lit("ONLINE")),
    )


def label_suffixes(clean: Column) -> Column:
    """Every label suffix of a host: ``a.b.c`` -> ``a.b.c``, ``b.c``, ``c``."""
    labels = F.split(clean, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def match_domain_table(df: DataFrame, domain_col: str, table: DataFrame, flag: str) -> DataFrame:
    """Lookup in a domain table of any size (column ``listed_domain``).

    Distinct hosts are exploded into label suffixes and equi-joined, so the comparison
    is a hash join, and a host shared by very many rows is looked up once.
    """
    hosts = df.select(clean_domain(F.col(domain_col)).alias("host")).distinct()
    hits = (
        hosts.select("host", F.explode(label_suffixes(F.col("host"))).alias("listed_domain"))
        .join(table.select("listed_domain").distinct(), "listed_domain", "left_semi")
        .select("host")
        .distinct()
        .withColumn(flag, F.lit(True))
    )
    keyed = df.withColumn("host", clean_domain(F.col(domain_col)))
    return keyed.join(hits, "host", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("host")
