"""Search payloads of four providers as one candidate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import markup
from ..functions.ladders import ladder
from ..functions.urls import netloc

PROVIDERS = ["serper", "serpapi", "cse", "html"]  # in order of priority
PROVIDER_LIMIT, WORKFLOW_LIMIT = 4, 5

_ITEMS = {
    "serper": ("organic", "array<struct<link:string,title:string,imageUrl:string,images:array<struct<url:string>>>>"),
    "serpapi": ("organic_results", "array<struct<link:string,title:string,thumbnail:string>>"),
    "cse": ("items", "array<struct<link:string,title:string,pagemap:struct<metatags:array<struct<`og:image`:string,`twitter:image`:string>>>>>"),
}


def _struct(url: Column, title: Column, image: Column) -> Column:
    return F.struct(url.alias("url"), title.alias("title"), image.alias("img_src"))


def _html_results(html: Column) -> Column:
    blocks = F.regexp_extract_all(
        html, F.lit(r"""(?is)(<div\b[^>]*class\s*=\s*"[^"]*result[^"]*"[^>]*>.*?)(?=<div\b[^>]*class\s*=\s*"[^"]*result|$)"""), F.lit(1)
    )
    anchor = r"""(?is)(<a\b[^>]*class\s*=\s*"[^"]*(?:result__url|result__snippet|result__a)[^"]*"[^>]*>)(.*?)</a\s*>"""

    def result(b: Column) -> Column:
        href = markup.attribute(F.regexp_extract(b, anchor, 1), "href")
        target = F.regexp_extract(href, r"[?&]uddg=([^&]*)", 1)
        title = F.trim(markup.unescape(F.regexp_replace(F.regexp_extract(b, anchor, 2), "<[^>]*>", "")))
        image = markup.attribute(F.get(markup.tags(b, "img"), F.lit(0)), "src")
        return _struct(F.when(target != "", F.url_decode(target)).otherwise(href), title, F.nullif(image, F.lit("")))

    return F.filter(F.transform(blocks, result), lambda r: r["url"].startswith("http"))


def provider_results(payloads: DataFrame) -> DataFrame:
    """A3. Raw results in delivered order from (query_id, provider, payload).

    Per query only the provider of highest priority that returned something counts.
    """
    items = {p: F.from_json(F.get_json_object("payload", f"$.{field}"), schema) for p, (field, schema) in _ITEMS.items()}
    mapped = {
        "serper": F.transform(items["serper"], lambda r: _struct(r["link"], r["title"], F.coalesce(F.nullif(r["imageUrl"], F.lit("")), F.get(r["images"], F.lit(0))["url"]))),
        "serpapi": F.transform(items["serpapi"], lambda r: _struct(r["link"], r["title"], r["thumbnail"])),
        "cse": F.transform(
            items["cse"],
            lambda r: _struct(r["link"], r["title"], F.coalesce(
                F.nullif(F.get(r["pagemap"]["metatags"], F.lit(0))["og:image"], F.lit("")), F.get(r["pagemap"]["metatags"], F.lit(0))["twitter:image"])),
        ),
        "html": _html_results(F.col("payload")),
    }
    results = ladder([(F.col("provider") == p, mapped[p]) for p in PROVIDERS], F.lit(None))
    rank = ladder([(F.col("provider") == p, i) for i, p in enumerate(PROVIDERS)], F.lit(None).cast("int"))
    df = payloads.select("query_id", "provider", rank.alias("priority"), results.alias("results")).filter(F.size("results") > 0)
    # one row per query and provider: at most four rows per query meet here
    chosen = df.groupBy("query_id").agg(F.min_by(F.struct("provider", "results"), "priority").alias("c"))
    return chosen.select("query_id", F.col("c.provider").alias("provider"), F.posexplode("c.results").alias("idx", "r")).select(
        "query_id", "provider", "idx", "r.*"
    )


def search_queries(hints: DataFrame, category: str | None = None) -> DataFrame:
    """A4. Queries worth sending: trimmed, at least two characters, category appended."""
    q = F.trim(F.coalesce(F.col("search_hint"), F.lit("")))
    text = q if not category else F.concat(q, F.lit(f" {category}"))
    return hints.filter(F.length(q) >= 2).withColumn("search_query", text)


def web_candidates(results: DataFrame, limit: int = PROVIDER_LIMIT) -> DataFrame:
    """A4. First ``limit`` results per query with a domain and an image.

    Twice the limit is looked at. ``fallback_image`` (an image found on the result
    page) stands in for a missing thumbnail where the column exists.
    """
    if "fallback_image" not in results.columns:
        results = results.withColumn("fallback_image", F.lit(None).cast("string"))
    src = F.when(F.col("img_src").startswith("//"), F.concat(F.lit("https:"), "img_src")).otherwise(F.col("img_src"))
    df = results.filter(F.col("idx") < 2 * limit).withColumns(
        {
            "source_domain": netloc(F.coalesce("url", F.lit(""))),
            "image_url": F.coalesce(F.when(src.startswith("http"), src), "fallback_image"),
        }
    )
    usable = df.filter((F.col("source_domain") != "") & F.col("image_url").isNotNull())
    order = Window.partitionBy("query_id").orderBy("idx")
    return (
        usable.withColumn("k", F.row_number().over(order) - 1)
        .filter(F.col("k") < limit)
        .select(
            "query_id",
            "k",
            F.concat(F.lit("web_"), F.col("idx").cast("string"), F.lit("_"), "source_domain").alias("candidate_id"),
            F.col("url").alias("source_url"),
            "source_domain",
            F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Public web match on "), "source_domain")).alias("title"),
            F.lit("ONLINE").alias("source_type"),
            "image_url",
        )
    )
