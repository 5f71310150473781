"""Queries of the page-extraction family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..functions.urls import crawl_domain
from ..operators import crawl, pages
from .core import query, sql_text

# ---- SQL twins read the same text with their own, simpler expressions ----------------

_UNESC = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_META = lambda k, v: f"trim(regexp_extract(html, '<meta {k}=\"{v}\" content=\"([^\"]*)\">', 1))"
_TITLE = f"CASE WHEN html LIKE '%<title>%' THEN trim({_UNESC(chr(39).join(['regexp_extract(html, ', '<title>(.*?)</title>', ', 1, ', 's', ')']))}) ELSE {_META('property', 'og:title')} END"
_TEXT = (
    "trim(regexp_replace(" + _UNESC(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', ' ', 'gsi'), "
        "'<style[^>]*>.*?</style>', ' ', 'gsi'), '<[!/a-zA-Z][^>]*>', ' ', 'g')"
    ) + ", '\\s+', ' ', 'g'))"
)
_RESOLVE = lambda base, h: (
    f"CASE WHEN {h} LIKE 'http%' THEN {h} WHEN {h} LIKE '//%' THEN 'https:' || {h} WHEN {h} LIKE '/%' THEN regexp_extract({base}, '^([a-z]+://[^/]*)', 1) || {h} "
    f"ELSE regexp_extract(regexp_extract({base}, '^([^?#]*)', 1), '^(.*/)', 1) || {h} END"
)


@query("page_titles", "C1", f"SELECT page_id, {_TITLE} AS title FROM v_html UNION ALL SELECT page_id + 100000000, {_TITLE} FROM v_page")
def _(t):
    own = t.view("v_page").select((F.col("page_id") + 100000000).alias("page_id"), "html")
    both = t.view("v_html").select("page_id", "html").unionByName(own)
    return both.select("page_id", markup.title_text(F.col("html")).alias("title"))


@query("page_descriptions", "C2", f"""SELECT page_id, coalesce(nullif({_META('name', 'description')}, ''), nullif({_META('property', 'og:description')}, ''), nullif({_META('name', 'twitter:description')}, ''), '') AS description FROM v_html""")
def _(t):
    return t.view("v_html").select("page_id", markup.description_text(F.col("html")).alias("description"))


@query("page_visible_text", "C3", f"SELECT page_id, {_TEXT} AS text FROM v_page UNION ALL SELECT page_id + 100000000, {_TEXT} FROM v_html")
def _(t):
    own = t.view("v_html").select((F.col("page_id") + 100000000).alias("page_id"), "html")
    both = t.view("v_page").select("page_id", "html").unionByName(own)
    return both.select("page_id", markup.visible_text(F.col("html")).alias("text"))


def _delim(d: str) -> str:
    return (f"list_filter(list_reverse(list_filter(list_transform(string_split(title, {sql_text(d)}), lambda p: trim(p)), lambda p: p <> '')), "
            "lambda p: length(p) <= 30 AND NOT regexp_matches(lower(p), 'home|official|store|buy|shop|online'))[1]")


_NAME = f"""n0 AS (SELECT merchant_id, page_id, html, url, {_TITLE} AS title, regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\\.', '') AS dom,
 regexp_extract(html, '"@type":"Organization","name":"([^"]*)"', 1) AS org, {_META('property', 'og:site_name')} AS site FROM v_html),
named AS (SELECT merchant_id, page_id, title, {_UNESC("coalesce(nullif(org, ''), nullif(site, ''), " + ", ".join(f"CASE WHEN contains(title, {sql_text(d)}) THEN {_delim(d)} END" for d in pages.TITLE_DELIMITERS) + ", upper(dom[1]) || split_part(dom, '.', 1)[2:])")} AS page_name FROM n0)"""


@query("page_merchant_names", "C4", f"WITH {_NAME} SELECT page_id, page_name FROM named")
def _(t):
    named = t.view("v_html").withColumn("title", markup.title_text(F.col("html")))
    return named.select(
        "page_id",
        pages.merchant_name(F.col("html"), F.col("title"), crawl_domain(F.col("url"))).alias("page_name"),
    )


# images of the storefront template, one SELECT per place in the page
_PN = "CAST(page_id AS VARCHAR)"
_IMAGES = f"""p AS (SELECT p_partkey AS page_id, p_partkey // 50 AS merchant_id, p_name, p_type, p_size, 'https://www.shop' || CAST(p_partkey // 50 AS VARCHAR) || '.example.com' AS o FROM part),
im AS (
 SELECT merchant_id, page_id, 0 AS pos, o || '/assets/mark' || CAST(page_id // 50 AS VARCHAR) || '.png' AS src, 'home' AS alt, '' AS title, 'site-mark' AS img_class, 'logo' AS asset_type, TRUE AS is_logo_candidate, FALSE AS is_product_candidate FROM p
 UNION ALL SELECT merchant_id, page_id, 1, o || '/media/' || CASE WHEN page_id % 9 = 0 THEN 'banner' ELSE 'top' END || CAST(page_id % 90 AS VARCHAR) || '.jpg', 'sale', '', CASE WHEN page_id % 2 = 0 THEN 'hero-slide' ELSE 'wide' END,
   CASE WHEN page_id % 2 = 0 OR page_id % 9 = 0 THEN 'banner' ELSE 'product_image' END, FALSE, NOT (page_id % 2 = 0 OR page_id % 9 = 0) FROM p
 UNION ALL SELECT merchant_id, page_id, 2, o || '/img/' || {_PN} || '.jpg', p_name, p_type, '', 'product_image', FALSE, TRUE FROM p
 UNION ALL SELECT merchant_id, page_id, 3, 'https://cdn.example.com/lazy/' || {_PN} || '.jpg', '', '', 'thumb', 'product_image', FALSE, TRUE FROM p
 UNION ALL SELECT merchant_id, page_id, 4, o || '/set/' || CAST(page_id % 60 AS VARCHAR) || '.jpg', '', '', '', CASE WHEN page_id % 10 = 0 THEN 'logo' ELSE 'product_image' END, page_id % 10 = 0, page_id % 10 <> 0 FROM p
 UNION ALL SELECT merchant_id, page_id, 5, o || '/badges/iso9001.png', 'ISO award', '', '', 'certificate', FALSE, FALSE FROM p WHERE page_id % 4 = 1
 UNION ALL SELECT merchant_id, page_id, -1, o || '/og/' || {_PN} || '.jpg', 'OpenGraph Featured Visual', 'Featured Asset', 'og-image', 'product_image', FALSE, TRUE FROM p WHERE page_id % 6 = 0)"""


@query("page_images", "C5,C6", f"WITH {_IMAGES} SELECT merchant_id, page_id, pos, src, alt, title, img_class, asset_type, is_logo_candidate, is_product_candidate FROM im")
def _(t):
    return pages.page_images(t.view("v_html")).drop("width", "height")


_BRANDED = """SELECT page_id, url, concat('<html><body>', CASE page_id % 4 WHEN 0 THEN concat('<a class="navbar-brand" href="/"><img src="/a/', CAST(page_id AS VARCHAR(20)), '.png"></a>') WHEN 1 THEN concat('<img alt="our LOGO" src="b', CAST(page_id AS VARCHAR(20)), '.png"><img id="brand" src="//cdn.example.com/i.png">')
 WHEN 2 THEN concat('<img class="x header-logo" src="https://cdn.example.com/c', CAST(page_id AS VARCHAR(20)), '.png">') ELSE '<img src="/plain.png">' END, html) AS html FROM v_html"""


@query("logo_candidates", "C7", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN CASE WHEN page_id % 10 = 0 THEN NULL ELSE 'https://www.shop' || CAST(page_id // 50 AS VARCHAR) || '.example.com/a/' || CAST(page_id AS VARCHAR) || '.png' END WHEN 1 THEN 'https://cdn.example.com/i.png'
 WHEN 2 THEN 'https://cdn.example.com/c' || CAST(page_id AS VARCHAR) || '.png' END AS logo_url FROM v_html""")
def _(t):
    from .core import _bind_tables, with_views
    from .views import SPARK_VIEWS

    branded = t.spark.sql(_bind_tables(with_views(_BRANDED, SPARK_VIEWS), t.directory))
    return branded.select("page_id", pages.logo_candidate(F.col("html"), F.col("url")).alias("logo_url"))


_PRODUCTS = f"""pr AS (
 SELECT p_partkey // 50 AS merchant_id, p_partkey AS page_id, 0 AS pos, p_name AS name, 'A ' || p_type || ' item' AS description, CAST(p_size AS VARCHAR) || '.50' AS price, 'https://www.shop' || CAST(p_partkey // 50 AS VARCHAR) || '.example.com/img/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_url FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT p_partkey // 50, p_partkey, 0, p_name, '', CAST(p_size AS VARCHAR), 'https://www.shop' || CAST(p_partkey // 50 AS VARCHAR) || '.example.com/img/a' || CAST(p_partkey AS VARCHAR) || '.jpg' FROM part WHERE p_partkey % 4 = 1
 UNION ALL SELECT p_partkey // 50, p_partkey, 1, p_type || ' bundle', '', '', NULL FROM part WHERE p_partkey % 4 = 1)"""


@query("page_products", "C8", f"WITH {_PRODUCTS} SELECT * FROM pr")
def _(t):
    return pages.page_products(t.view("v_html"))


@query("merchant_products", "C9", f"""WITH {_PRODUCTS}, f AS (SELECT *, row_number() OVER (PARTITION BY merchant_id, name ORDER BY page_id, pos) AS rn FROM pr), g AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY page_id, pos) AS product_no FROM f WHERE rn = 1)
SELECT merchant_id, name, page_id, pos, description, price, image_url, CAST(product_no AS INT) AS product_no FROM g WHERE product_no <= 12""")
def _(t):
    return pages.merchant_products(pages.page_products(t.view("v_html")))


@query("social_links", "C10", """SELECT page_id, 'https://www.facebook.com/' || regexp_extract(html, 'facebook.com/([^"]*)"', 1) AS link FROM v_html""")
def _(t):
    return t.view("v_html").select("page_id", F.explode(pages.social_links(F.col("html"), F.col("url"))).alias("link"))


_HAS = lambda words, x="low": "(" + " OR ".join(f"contains({x}, {sql_text(w)})" for w in words) + ")"
_FOUND = lambda words, x="low": "[" + ", ".join(f"CASE WHEN contains({x}, {sql_text(w)}) THEN {sql_text(w)} END" for w in words) + "]"


@query("disclosure_flags", "C11", f"""WITH a AS (SELECT doc_id AS id, lower(text) AS low, 0 AS n FROM v_doc UNION ALL SELECT page_id + 100000000, lower({_TEXT}), CAST(page_id % 2 AS INT) FROM v_html)
SELECT id, {_HAS(pages.CONTACT_WORDS)} AS has_contact, {_HAS(pages.POLICY_WORDS)} AS has_policy, n > 0 OR {_HAS(pages.PRICING_WORDS)} AS has_pricing, {_HAS(pages.ABOUT_WORDS)} AS has_about FROM a""")
def _(t):
    docs = t.view("v_doc").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("n_products"))
    html = t.view("v_html").select(
        (F.col("page_id") + 100000000).alias("id"), markup.visible_text(F.col("html")).alias("text"),
        (F.col("page_id") % 2).cast("int").alias("n_products"),
    )
    return pages.disclosure_flags(docs.unionByName(html)).drop("text", "n_products")


# documents with category keywords mixed in
_CATEGORY = """SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN '' ELSE concat(text, CASE doc_id % 9 WHEN 0 THEN ' Add to Cart now, free delivery, SKU: 1' WHEN 1 THEN ' payouts and webhooks' WHEN 2 THEN ' book a demo of our cloud platform integrations' WHEN 3 THEN ' faculty campus'
  WHEN 4 THEN ' checkout' WHEN 5 THEN ' university' WHEN 6 THEN ' banking saas' ELSE '' END) END AS text, CASE doc_id % 5 WHEN 0 THEN 'pay.stripe.com' WHEN 1 THEN 'uni.ac.in' ELSE 'shop.example.com' END AS domain,
  CAST(CASE WHEN doc_id % 31 = 0 THEN 3 ELSE 0 END AS INT) AS n_products FROM v_doc"""


@query("site_categories", "C12", f"""WITH a AS ({_CATEGORY}), b AS (SELECT *, lower(text) AS low FROM a),
c AS (SELECT *, list_filter({_FOUND(pages.ECOMMERCE_WORDS)}, lambda x: x IS NOT NULL) AS e, list_filter({_FOUND(pages.FINTECH_WORDS)}, lambda x: x IS NOT NULL) AS f, list_filter({_FOUND(pages.SAAS_WORDS)}, lambda x: x IS NOT NULL) AS s, list_filter({_FOUND(pages.INSTITUTION_WORDS)}, lambda x: x IS NOT NULL) AS i FROM b),
d AS (SELECT *, CASE WHEN text = '' AND n_products = 0 THEN 'UNKNOWN' WHEN n_products > 0 OR len(e) >= 2 THEN 'ECOMMERCE' WHEN len(f) >= 2 OR {_HAS(pages.FINTECH_DOMAINS, 'domain')} THEN 'FINTECH_PAYMENTS' WHEN len(s) >= 2 THEN 'SAAS_SOFTWARE' WHEN len(i) >= 2 OR {_HAS(pages.INSTITUTION_DOMAINS, 'domain')} THEN 'INFORMATIONAL_INSTITUTION' ELSE 'GENERAL_WEBSITE' END AS site_category FROM c)
SELECT doc_id, site_category, array_to_string(CASE site_category WHEN 'ECOMMERCE' THEN list_concat(['Product markup: ' || n_products || ' items'], list_transform(e[1:3], lambda k: 'Keyword: ''' || k || ''''))
 WHEN 'FINTECH_PAYMENTS' THEN list_transform(f[1:3], lambda k: 'Fintech keyword: ''' || k || '''') WHEN 'SAAS_SOFTWARE' THEN list_transform(s[1:3], lambda k: 'SaaS keyword: ''' || k || '''') WHEN 'INFORMATIONAL_INSTITUTION' THEN list_transform(i[1:3], lambda k: 'Institutional keyword: ''' || k || '''') ELSE [] END, '; ') AS indicators FROM d""")
def _(t):
    from .core import _bind_tables, with_views
    from .views import SPARK_VIEWS

    docs = t.spark.sql(_bind_tables(with_views(_CATEGORY, SPARK_VIEWS), t.directory))
    return pages.site_category(docs).select("doc_id", "site_category", F.array_join("indicators", "; ").alias("indicators"))


def _TWO(words):
    return f"len(list_filter({_FOUND(words)}, lambda x: x IS NOT NULL)) >= 2"


@query("merchant_crawl_facts", "C13", f"""WITH {_NAME}, {_PRODUCTS}, k AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY page_id) AS no FROM v_html), kept AS (SELECT * FROM k WHERE no <= 5),
tx AS (SELECT k.merchant_id, k.page_id, k.no, {_TEXT} AS text, n.title, n.page_name FROM kept k JOIN named n USING (page_id)),
g AS (SELECT merchant_id, string_agg(text, ' ' ORDER BY no) AS text, concat('shop', merchant_id, '.example.com') AS domain, arg_min(struct_pack(t := title, n := page_name), CASE WHEN title = '' THEN 1000 - no ELSE no END) AS h FROM tx GROUP BY 1),
np AS (SELECT pr.merchant_id, CAST(count(DISTINCT name) AS INT) AS n_products FROM pr JOIN kept USING (page_id) GROUP BY 1), j AS (SELECT g.*, coalesce(n_products, 0) AS np, lower(text) AS low FROM g LEFT JOIN np USING (merchant_id))
SELECT merchant_id, h.n AS merchant_name, h.t AS title, np AS n_products, CAST(length(text) AS INT) AS text_length, md5(text) AS text_md5, {_HAS(pages.CONTACT_WORDS)} AS has_contact, {_HAS(pages.POLICY_WORDS)} AS has_policy, np > 0 OR {_HAS(pages.PRICING_WORDS)} AS has_pricing, {_HAS(pages.ABOUT_WORDS)} AS has_about,
 CASE WHEN text = '' AND np = 0 THEN 'UNKNOWN' WHEN np > 0 OR {_TWO(pages.ECOMMERCE_WORDS)} THEN 'ECOMMERCE' WHEN {_TWO(pages.FINTECH_WORDS)} OR {_HAS(pages.FINTECH_DOMAINS, 'domain')} THEN 'FINTECH_PAYMENTS' WHEN {_TWO(pages.SAAS_WORDS)} THEN 'SAAS_SOFTWARE'
  WHEN {_TWO(pages.INSTITUTION_WORDS)} OR {_HAS(pages.INSTITUTION_DOMAINS, 'domain')} THEN 'INFORMATIONAL_INSTITUTION' ELSE 'GENERAL_WEBSITE' END AS site_category,
 (SELECT string_agg(url, ' ' ORDER BY no) FROM kept WHERE kept.merchant_id = j.merchant_id) AS pages_crawled FROM j""")
def _(t):
    f = pages.crawl_facts(t.view("v_html"))
    return f.select(
        "merchant_id", "merchant_name", "title", "n_products", F.length("text").alias("text_length"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"), "has_contact", "has_policy", "has_pricing", "has_about",
        "site_category", F.array_join("pages_crawled", " ").alias("pages_crawled"),
    )


@query("certificate_banner_urls", "C14", f"WITH {_IMAGES} SELECT DISTINCT merchant_id, asset_type, src FROM im WHERE asset_type IN ('certificate', 'banner')")
def _(t):
    return pages.asset_urls(pages.page_images(t.view("v_html")))


_LINKS = """lk AS (SELECT merchant_id, page_id, 0 AS pos, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/about-us' AS link FROM v_html
 UNION ALL SELECT merchant_id, page_id, 1, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/contact' FROM v_html
 UNION ALL SELECT merchant_id, page_id, 2, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/products/' || CAST((page_id * 7) % 911 AS VARCHAR) || '/' FROM v_html)"""


@query("priority_links", "B16", f"WITH {_LINKS} SELECT * FROM lk")
def _(t):
    return crawl.priority_links(t.view("v_html"))


@query("crawl_frontier", "B17", f"""WITH {_LINKS}, n AS (SELECT *, regexp_replace(link, '/+$', '') AS norm_url FROM lk), f AS (SELECT *, row_number() OVER (PARTITION BY merchant_id, norm_url ORDER BY page_id, pos) AS rn FROM n),
g AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY page_id, pos) AS visit_no FROM f WHERE rn = 1) SELECT merchant_id, CAST(visit_no AS INT) AS visit_no, norm_url, link FROM g WHERE visit_no <= 5""")
def _(t):
    return crawl.frontier(crawl.priority_links(t.view("v_html")))
