"""Queries of the URL, domain and fetch-policy families."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from ..functions import domains, ipnet, urls
from ..functions.urls import clean_domain
from ..operators import crawl
from .core import query

# domain strings in many spellings, from page URLs and supplier names
_SPELLINGS = """
u AS (SELECT page_id, url,
  CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN regexp_replace(url, '^https?://', '') WHEN 3 THEN concat(' www.shop', CAST(page_id AS VARCHAR(20)), '.example.com:8443/a/b ')
    WHEN 4 THEN concat('HTTP://www.www.store-', CAST(page_id AS VARCHAR(20)), '_x.co.uk:80/p?q=1') ELSE concat('ftp://user@files', CAST(page_id AS VARCHAR(20)), '.example.org') END AS raw
  FROM v_page)"""
_EXTRACT = "regexp_replace(split_part(regexp_extract(CASE WHEN r LIKE 'http://%' OR r LIKE 'https://%' OR r LIKE '%//%' THEN r ELSE 'https://' || r END, '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), ':', 1), '^www\\.', '')"
_CLEAN = lambda x: f"split_part(split_part(trim(replace(CASE WHEN {x} LIKE '%//%' THEN regexp_replace(split_part(regexp_extract({x}, '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), ':', 1), '^www\\.', '') ELSE {x} END, 'www.', '')), '/', 1), ':', 1)"


def _spellings(t):
    from .core import _bind_tables, with_views
    from .views import SPARK_VIEWS

    return t.spark.sql(_bind_tables(with_views(f"WITH {_SPELLINGS} SELECT * FROM u", SPARK_VIEWS), t.directory))


@query("page_corpus_html", "A1", """SELECT merchant_id, attempt_no, content_type FROM v_attempt WHERE lower(content_type) LIKE '%text/html%' OR lower(content_type) LIKE '%application/xhtml%'""")
def _(t):
    return crawl.html_only(t.view("v_attempt")).select("merchant_id", "attempt_no", "content_type")


@query("url_domains", "B1,B2,B3", f"""WITH {_SPELLINGS}, w AS (SELECT *, lower(trim(raw)) AS r FROM u)
SELECT page_id, {_EXTRACT} AS domain, {_CLEAN('r')} AS clean, regexp_replace(lower(regexp_extract(raw, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') AS crawl_key FROM w""")
def _(t):
    raw = F.col("raw")
    return _spellings(t).select(
        "page_id", urls.extract_domain(raw).alias("domain"), clean_domain(raw).alias("clean"),
        urls.crawl_domain(raw).alias("crawl_key"),
    )


@query("domain_names", "B4", f"""WITH {_SPELLINGS}, w AS (SELECT page_id, lower(trim(raw)) AS r FROM u), x AS (SELECT page_id, replace(replace(split_part({_CLEAN('r')}, '.', 1), '-', ' '), '_', ' ') AS label FROM w)
SELECT page_id, array_to_string(list_transform(regexp_extract_all(label, '([a-z]+|[^a-z]+)'), lambda s: upper(s[1]) || s[2:]), '') AS name FROM x""")
def _(t):
    return _spellings(t).select("page_id", urls.domain_to_name(clean_domain(F.col("raw"))).alias("name"))


_OWN_INPUT = """
d AS (SELECT asset_id, k, source_domain, CASE asset_id % 5 WHEN 0 THEN 'example.com' WHEN 1 THEN concat('eu.', merchant_domain) WHEN 2 THEN 'rival.net' ELSE merchant_domain END AS merchant FROM v_candidate)"""


def _own_input(t):
    return t.view("v_candidate").select(
        "asset_id", "k", "source_domain",
        F.expr("CASE asset_id % 5 WHEN 0 THEN 'example.com' WHEN 1 THEN concat('eu.', merchant_domain) WHEN 2 THEN 'rival.net' ELSE merchant_domain END").alias("merchant"),
    )


@query("own_domain_tests", "B5", f"""WITH {_OWN_INPUT}, e AS (SELECT *, replace(source_domain, 'www.', '') AS sd FROM d)
SELECT asset_id, k, sd = merchant OR suffix(sd, '.' || merchant) OR suffix(merchant, '.' || sd) AS own_strict,
 contains(source_domain, merchant) OR contains(merchant, source_domain) OR contains(split_part(source_domain, '.', 1), split_part(merchant, '.', 1)) AS own_loose,
 sd = merchant OR suffix(sd, '.' || merchant) AS own_index FROM e""")
def _(t):
    source, merchant = F.col("source_domain"), F.col("merchant")
    return _own_input(t).select(
        "asset_id", "k",
        urls.own_domain_strict(clean_domain(source), clean_domain(merchant)).alias("own_strict"),
        urls.own_domain_loose(source, merchant).alias("own_loose"),
        urls.own_domain_index(urls.index_domain(source), urls.index_domain(merchant)).alias("own_index"),
    )


# hosts that hit and miss every list, spread over the customers
_HOSTS = ["shop.amazon.com", "notamazon.com", "www.flickr.com", "stock.adobe.com", "adobe.com", "i.pinimg.com", "m.1688.com",
          "best-wholesale-mart.net", "mysupplier.io", "archive.merchant-catalog.org", "temu.com", "www.ebay.com:443/itm", "https://unsplash.com/x", "example.org"]
_HOST_CASE = "CASE c_custkey % 14 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOSTS)) + " END"


def _sql_list(host: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR suffix({host}, '.{d}')" for d in values) + ")"


@query("known_domain_lookups", "B6,B7,B8,B9,B10", f"""WITH h AS (SELECT c_custkey, {_HOST_CASE} AS r FROM customer), x AS (SELECT c_custkey, {_CLEAN('r')} AS c FROM h)
SELECT c_custkey, {_sql_list('c', domains.MARKETPLACES)} AS marketplace, {_sql_list('c', domains.STOCK_SITES + domains.IMAGE_AGGREGATORS)} AS stock,
 {_sql_list('c', domains.IMAGE_AGGREGATORS)} AS aggregator, {_sql_list('c', domains.SUPPLIERS)} OR c LIKE '%supplier%' OR c LIKE '%wholesale%' OR c LIKE '%distributor%' AS supplier,
 {_sql_list('c', domains.SOFT_TRUST + domains.IMAGE_AGGREGATORS + domains.SUPPLIERS)} OR c LIKE '%supplier%' OR c LIKE '%wholesale%' OR c LIKE '%distributor%' AS soft_trust FROM x""")
def _(t):
    host = F.expr(_HOST_CASE)
    return t.table("customer").select(
        "c_custkey", domains.is_marketplace(host).alias("marketplace"), domains.is_stock(host).alias("stock"),
        domains.is_image_aggregator(host).alias("aggregator"), domains.is_supplier(host).alias("supplier"),
        domains.is_soft_trust(host).alias("soft_trust"),
    )


@query("growing_domain_lists", "B6", f"""WITH h AS (SELECT c_custkey, {_HOST_CASE} AS r FROM customer), x AS (SELECT c_custkey, {_CLEAN('r')} AS c FROM h),
l AS (SELECT DISTINCT {_CLEAN('source_domain')} AS listed FROM v_candidate)
SELECT c_custkey, EXISTS (SELECT 1 FROM l WHERE x.c = listed OR suffix(x.c, '.' || listed)) AS listed FROM x""")
def _(t):
    hosts = t.table("customer").select("c_custkey", F.expr(_HOST_CASE).alias("host_text"))
    listed = t.view("v_candidate").select(clean_domain(F.col("source_domain")).alias("listed_domain"))
    return domains.match_domain_table(hosts, "host_text", listed, "listed").select("c_custkey", "listed")


@query("candidate_source_types", "B11", f"""WITH x AS (SELECT asset_id, k, source_domain, merchant_domain, {_CLEAN('source_domain')} AS c FROM v_candidate)
SELECT asset_id, k, CASE WHEN contains(source_domain, merchant_domain) OR contains(merchant_domain, source_domain) OR contains(split_part(source_domain, '.', 1), split_part(merchant_domain, '.', 1)) THEN 'OWN_DOMAIN'
 WHEN {_sql_list('c', domains.SUPPLIERS)} OR regexp_matches(c, 'supplier|wholesale|distributor') THEN 'SUPPLIER_CATALOG'
 WHEN {_sql_list('c', domains.SOFT_TRUST + domains.IMAGE_AGGREGATORS)} THEN 'SOFT_TRUST' ELSE 'ONLINE' END AS source_type FROM x""")
def _(t):
    source = F.col("source_domain")
    return t.view("v_candidate").select(
        "asset_id", "k",
        domains.classify_source(
            urls.own_domain_loose(source, F.col("merchant_domain")), domains.is_supplier(source),
            domains.is_soft_trust(source), F.lit(None).cast("string"),
        ).alias("source_type"),
    )


@query("masked_merchants", "B12", """SELECT merchant_id, CASE WHEN length(CAST(merchant_id AS VARCHAR)) <= 4 THEN 'mch_***' || right(CAST(merchant_id AS VARCHAR), 2) ELSE 'mch_***' || right(CAST(merchant_id AS VARCHAR), 4) END AS masked_id,
 'mch_***' || right(merchant_name, 4) AS masked_name FROM v_merchant""")
def _(t):
    return t.view("v_merchant").select(
        "merchant_id", urls.mask_merchant(F.col("merchant_id")).alias("masked_id"),
        urls.mask_merchant(F.col("merchant_name")).alias("masked_name"),
    )


_UNSAFE = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '' WHEN 2 THEN concat('ftp://host', CAST(page_id AS VARCHAR(20)), '/x') WHEN 3 THEN 'https:///nohost' WHEN 4 THEN 'http://LOCALHOST:8080/admin'
  WHEN 5 THEN 'http://[::1]/' WHEN 6 THEN concat('https://user:pw@metadata.google.internal/', CAST(page_id AS VARCHAR(20))) ELSE concat('shop', CAST(page_id AS VARCHAR(20)), '.example.com') END"""


@query("url_safety", "B13", f"""WITH a AS (SELECT page_id, {_UNSAFE} AS u FROM v_page), b AS (SELECT *, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS sc, regexp_replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS au FROM a),
c AS (SELECT *, lower(CASE WHEN au LIKE '[%' THEN regexp_extract(au, '^\\[([^\\]]*)\\]', 1) ELSE split_part(au, ':', 1) END) AS h FROM b)
SELECT page_id, CASE WHEN u = '' THEN 'URL must be a non-empty string.' WHEN sc NOT IN ('http', 'https') THEN 'Unsupported URL scheme ''' || sc || '''. Only ''http'' and ''https'' are permitted.'
 WHEN h = '' THEN 'URL does not contain a valid hostname.' WHEN h IN ('localhost', '127.0.0.1', '0.0.0.0', '::1', 'metadata.google.internal') THEN 'Access to blocked hostname ''' || h || ''' is prohibited.' END AS reason FROM c""")
def _(t):
    return t.view("v_page").select("page_id", urls.url_safety_reason(F.expr(_UNSAFE)).alias("reason"))


# one host per order, one resolved address per line item
_IPS = """SELECT concat('h', CAST(l_orderkey AS VARCHAR(20)), '.example.com') AS host, (l_partkey * 10 + l_linenumber) * 10000 + l_suppkey AS ord,
  CASE WHEN l_partkey % 50 = 0 THEN 'not-an-ip' WHEN l_partkey % 50 = 1 THEN NULL
  ELSE concat(CAST(CASE l_suppkey % 20 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 100 WHEN 4 THEN 169 WHEN 5 THEN 198 ELSE 20 + l_suppkey % 60 END AS VARCHAR(20)), '.',
    CAST(CASE l_suppkey % 20 WHEN 1 THEN 10 + l_partkey % 40 WHEN 2 THEN 160 + l_partkey % 16 WHEN 3 THEN 50 + l_partkey % 90 WHEN 4 THEN 250 + l_partkey % 6 WHEN 5 THEN 10 + l_partkey % 45 ELSE l_partkey % 256 END AS VARCHAR(20)), '.', CAST(l_orderkey % 256 AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(20))) END AS ip FROM lineitem"""


def _v4_sql(n: str) -> str:

    nets = map(ipaddress.ip_network, ipnet.BLOCKED_V4)
    return "(" + " OR ".join(f"{n} BETWEEN {int(x.network_address)} AND {int(x.broadcast_address)}" for x in nets) + ")"


@query("host_network_safety", "B14", f"""WITH r AS ({_IPS}), p AS (SELECT *, string_split(ip, '.') AS q FROM r),
n AS (SELECT *, CASE WHEN len(q) = 4 THEN q[1]::BIGINT * 16777216 + q[2]::BIGINT * 65536 + q[3]::BIGINT * 256 + q[4]::BIGINT END AS num FROM p),
b AS (SELECT *, ip IS NOT NULL AND (num IS NULL OR {_v4_sql('num')}) AS blk FROM n),
g AS (SELECT host, arg_min(ip, ord) FILTER (ip IS NOT NULL) AS first_ip, arg_min(ip, ord) FILTER (blk) AS bad FROM b GROUP BY host)
SELECT host, bad IS NULL AND first_ip IS NOT NULL AS is_safe, coalesce(bad, first_ip) AS resolved_ip,
 CASE WHEN bad IS NOT NULL THEN 'Resolved IP ''' || bad || ''' for host ''' || host || ''' is in a private or restricted network.' WHEN first_ip IS NULL THEN 'DNS resolution failed for hostname ''' || host || '''.' END AS reason FROM g""")
def _(t):
    from .core import _bind_tables

    return crawl.host_safety(t.spark.sql(_bind_tables(_IPS, t.directory)))


_V6 = """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN concat('fe80::', lower(hex(c_nationkey * 97 + c_custkey))) WHEN 1 THEN concat('2606:4700::', lower(hex((c_custkey * 31 + c_nationkey) % 60000))) WHEN 2 THEN concat('::ffff:', CAST(c_nationkey * 9 AS VARCHAR(20)), '.', CAST(c_custkey % 40 AS VARCHAR(20)), '.0.', CAST(c_custkey % 256 AS VARCHAR(20)))
  WHEN 3 THEN concat(lower(hex(c_nationkey * 2500)), ':', lower(hex(c_custkey % 9000)), '::7') WHEN 4 THEN concat('2001:', lower(hex(c_custkey % 64)), ':', lower(hex(c_nationkey)), '::1') WHEN 5 THEN concat('2001:db8::', lower(hex(c_custkey % 60000)), ':', lower(hex(c_nationkey)))
  ELSE concat(lower(hex(c_custkey * 13 % 65536)), ':0:', lower(hex(c_nationkey)), ':0:0:0:0:8888') END AS ip FROM customer"""
_HEX6 = f"""v6 AS ({_V6}), t6 AS (SELECT *, CASE WHEN contains(ip, '.') THEN regexp_extract(ip, '^(.*:)[^:]*$', 1) || lower(printf('%x', regexp_extract(ip, '([0-9]+)\\.[0-9]+\\.[0-9]+\\.[0-9]+$', 1)::BIGINT * 256 + regexp_extract(ip, '\\.([0-9]+)\\.[0-9]+\\.[0-9]+$', 1)::BIGINT)) || ':' || lower(printf('%x', regexp_extract(ip, '\\.([0-9]+)\\.[0-9]+$', 1)::BIGINT * 256 + regexp_extract(ip, '\\.([0-9]+)$', 1)::BIGINT)) ELSE ip END AS flat FROM v6),
s6 AS (SELECT *, list_filter(string_split(split_part(flat, '::', 1), ':'), lambda x: x <> '') AS l, list_filter(string_split(CASE WHEN contains(flat, '::') THEN split_part(flat, '::', 2) ELSE '' END, ':'), lambda x: x <> '') AS r FROM t6),
h6 AS (SELECT *, array_to_string(list_transform(l || list_transform(range(8 - len(l) - len(r)), lambda i: '0') || r, lambda g: lpad(g, 4, '0')), '') AS h FROM s6)"""


def _hex_ranges(networks):
    """SQL test of the 32 hex digits ``h`` against networks."""
    nets = map(ipaddress.ip_network, networks)
    return "(" + " OR ".join(f"h BETWEEN '{int(n.network_address):032x}' AND '{int(n.broadcast_address):032x}'" for n in nets) + ")"


_MAPPED_V4 = [f"::ffff:{n.split('/')[0]}/{96 + int(n.split('/')[1])}" for n in ipnet.BLOCKED_V4]


@query("ipv6_network_safety", "B14", f"""WITH {_HEX6} SELECT c_custkey, CASE WHEN starts_with(h, '{'0' * 20}ffff') THEN {_hex_ranges(_MAPPED_V4)} ELSE {_hex_ranges(ipnet.BLOCKED_V6)} OR ({_hex_ranges(ipnet.RESERVED_V6)} AND NOT {_hex_ranges(ipnet.GLOBAL_V6)}) END AS is_blocked FROM h6""")
def _(t):
    from .core import _bind_tables

    return ipnet.add_ip_blocked(t.spark.sql(_bind_tables(_V6, t.directory)), "ip", "is_blocked").select("c_custkey", "is_blocked")


# a list of networks that grows with the tables: one of 8 to 28 bits for each part, every fifth of them open
_NETS = """SELECT concat(CAST(p_partkey % 223 + 1 AS VARCHAR(20)), '.', CAST(p_partkey * 7 % 256 AS VARCHAR(20)), '.', CAST(p_size AS VARCHAR(20)), '.0/', CAST(8 + p_partkey % 21 AS VARCHAR(20))) AS cidr, p_partkey % 5 <> 0 AS is_blocked FROM part"""
_ASKED = """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'no address' ELSE concat(CAST(o_orderkey % 223 + 1 AS VARCHAR(20)), '.', CAST(o_custkey * 7 % 256 AS VARCHAR(20)), '.', CAST(o_custkey % 50 AS VARCHAR(20)), '.', CAST(o_orderkey % 256 AS VARCHAR(20))) END AS ip FROM orders"""
_NUM4 = lambda x: f"(split_part({x}, '.', 1)::BIGINT * 16777216 + split_part({x}, '.', 2)::BIGINT * 65536 + split_part({x}, '.', 3)::BIGINT * 256 + split_part({x}, '.', 4)::BIGINT)"


@query("listed_network_safety", "B14", f"""WITH n0 AS ({_NETS}), n AS (SELECT {_NUM4("split_part(cidr, '/', 1)")} >> (32 - split_part(cidr, '/', 2)::INT) AS head, split_part(cidr, '/', 2)::INT AS bits, bool_or(is_blocked) AS blocked FROM n0 GROUP BY 1, 2),
a AS ({_ASKED}), d AS (SELECT DISTINCT ip, {_NUM4('ip')} AS num FROM a WHERE contains(ip, '.')), w AS (SELECT ip, num, unnest(range(8, 29))::INT AS bits FROM d),
v AS (SELECT w.ip, arg_max(n.blocked, n.bits) AS blocked FROM w JOIN n ON n.bits = w.bits AND n.head = w.num >> (32 - w.bits) GROUP BY 1)
SELECT o_orderkey, CASE WHEN contains(a.ip, '.') THEN coalesce(v.blocked, false) ELSE true END AS is_blocked FROM a LEFT JOIN v ON v.ip = a.ip""")
def _(t):
    from .core import _bind_tables

    sql = lambda s: t.spark.sql(_bind_tables(s, t.directory))
    return ipnet.add_ip_listed(sql(_ASKED), "ip", "is_blocked", sql(_NETS)).select("o_orderkey", "is_blocked")


# rules per host from suppliers and nations, fetched paths from orders
_RULES = """SELECT concat('h', CAST(s_suppkey % 23 AS VARCHAR(20))) AS host, s_suppkey AS rule_order,
  CASE s_suppkey % 7 WHEN 0 THEN '/' WHEN 1 THEN '/cart' WHEN 2 THEN '/about' WHEN 3 THEN '' WHEN 4 THEN '/products' WHEN 5 THEN '*' ELSE '/c' END AS path, s_suppkey % 5 = 0 AS allow FROM supplier"""
_PATHS = """SELECT DISTINCT concat('h', CAST(o_custkey % 29 AS VARCHAR(20))) AS host,
  CASE o_orderkey % 6 WHEN 0 THEN '/' WHEN 1 THEN concat('/products/', CAST(o_orderkey % 90 AS VARCHAR(20))) WHEN 2 THEN '/cart/view' WHEN 3 THEN '/about-us' WHEN 4 THEN '' ELSE concat('/contact?x=', CAST(o_orderkey % 70 AS VARCHAR(20))) END AS path FROM orders"""
_VERDICT = """(SELECT arg_min(allow OR path = '', rule_order) FROM r WHERE r.host = {a}.host AND (r.path = '*' OR starts_with(CASE WHEN {a}.path = '' THEN '/' ELSE {a}.path END, r.path)))"""


@query("robots_verdicts", "B15", f"""WITH r AS ({_RULES}), p AS ({_PATHS}) SELECT host, path, coalesce({_VERDICT.format(a='p')}, TRUE) AS is_allowed FROM p""")
def _(t):
    from .core import _bind_tables

    sql = lambda s: t.spark.sql(_bind_tables(s, t.directory))
    return crawl.robots_verdicts(sql(_PATHS), sql(_RULES))


@query("robots_entry_points", "B15", f"""WITH r AS ({_RULES}), roots AS (SELECT DISTINCT host, 'https' AS scheme, '/' AS path FROM ({_PATHS})),
alt AS (SELECT unnest({crawl.ALTERNATIVE_PATHS}) AS path, generate_subscripts({crawl.ALTERNATIVE_PATHS}, 1) AS ord),
o AS (SELECT host, scheme, 0 AS ord, path FROM roots UNION ALL SELECT host, scheme, alt.ord, alt.path FROM roots CROSS JOIN alt),
v AS (SELECT *, coalesce({_VERDICT.format(a='o')}, TRUE) AS ok FROM o), f AS (SELECT *, min(ord) OVER (PARTITION BY host) AS lo FROM v WHERE ok)
SELECT roots.host, CAST(coalesce(f.ord, 0) AS INT) AS ord, 'https://' || roots.host || f.path AS url, CASE WHEN f.host IS NULL THEN 'ROBOTS_DISALLOWED' ELSE 'ALLOWED' END AS robots_status
FROM roots LEFT JOIN f ON f.host = roots.host AND (lo > 0 OR f.ord = 0)""")
def _(t):
    from .core import _bind_tables

    sql = lambda s: t.spark.sql(_bind_tables(s, t.directory))
    roots = sql(_PATHS).select("host").distinct().select("host", F.lit("https").alias("scheme"), F.lit("/").alias("path"))
    return crawl.robots_entry_points(roots, sql(_RULES))


_MESSAGES = """CASE attempt_no % 5 WHEN 0 THEN concat('DNS resolution failed for hostname ', CAST(merchant_id AS VARCHAR(20))) WHEN 1 THEN 'Access to blocked hostname' WHEN 2 THEN 'is in a private or restricted network' WHEN 3 THEN 'Unsupported URL scheme' ELSE NULL END"""


@query("validation_error_types", "D1", f"""SELECT attempt_no, CASE WHEN m LIKE '%DNS resolution failed%' OR m LIKE '%Could not resolve DNS%' THEN 'DNS_RESOLUTION_FAILED' WHEN m LIKE '%Security validation%' OR m LIKE '%restricted%' OR m LIKE '%blocked%' THEN 'SSRF_BLOCKED' ELSE 'UNREACHABLE' END AS error_type
FROM (SELECT attempt_no, {_MESSAGES} AS m FROM v_attempt)""")
def _(t):
    return t.view("v_attempt").select("attempt_no", crawl.validation_error(F.expr(_MESSAGES)).alias("error_type"))


_TYPED = """ty AS (SELECT *, CASE WHEN error_class = 'OK' THEN NULL WHEN error_class = 'SsrfBlocked' THEN 'SSRF_BLOCKED' WHEN error_class = 'RobotsDisallowed' THEN 'ROBOTS_DISALLOWED' WHEN error_class = 'SSLError' THEN 'SSL_ERROR'
 WHEN error_class = 'Timeout' THEN 'TIMEOUT' WHEN error_class = 'ConnectionError' THEN CASE WHEN lower(error_msg) LIKE '%getaddrinfo%' THEN 'DNS_RESOLUTION_FAILED' WHEN lower(error_msg) LIKE '%refused%' THEN 'CONNECTION_REFUSED' ELSE 'CONNECTION_FAILED' END
 WHEN error_class = 'HTTPError' THEN CASE WHEN http_status IN (403, 429) THEN 'BOT_BLOCKED' WHEN http_status IS NULL THEN 'HTTP_ERROR' ELSE 'HTTP_' || http_status END
 WHEN error_class = 'TooManyRedirects' THEN 'REDIRECT_LIMIT_EXCEEDED' ELSE 'CRAWL_FAILED' END AS error_type FROM v_attempt)"""


def typed_attempts(t):
    return t.view("v_attempt").withColumn(
        "error_type", crawl.attempt_error(F.col("error_class"), F.col("http_status"), F.col("error_msg"))
    )


@query("attempt_error_types", "D2", f"WITH {_TYPED} SELECT merchant_id, attempt_no, error_type FROM ty")
def _(t):
    return typed_attempts(t).select("merchant_id", "attempt_no", "error_type")


@query("merchant_crawl_status", "D3", f"""WITH {_TYPED}, g AS (SELECT merchant_id, count(*) FILTER (error_type IS NULL) AS pages_fetched, max(attempt_no) AS ln, max(attempt_no) FILTER (error_type = 'ROBOTS_DISALLOWED') AS lr,
 arg_max(error_type, attempt_no) FILTER (error_type IS NOT NULL AND (error_type <> 'ROBOTS_DISALLOWED' OR is_root)) AS le FROM ty GROUP BY 1)
SELECT merchant_id, pages_fetched, CASE WHEN pages_fetched > 0 THEN 'SUCCESS' WHEN ln = lr THEN 'ROBOTS_DISALLOWED' ELSE coalesce(le, 'CRAWL_FAILED') END AS crawl_status FROM g""")
def _(t):
    # the fixture attempts of a merchant are grouped by quarter so that failures occur
    return crawl.merchant_crawl_status(typed_attempts(t)).select("merchant_id", "pages_fetched", "crawl_status")


@query("order_crawl_status", "D3", f"""WITH {_TYPED}, k AS (SELECT *, merchant_id * 40 + attempt_no % 40 AS grp FROM ty), g AS (SELECT grp AS merchant_id, count(*) FILTER (error_type IS NULL) AS pages_fetched, max(attempt_no) AS ln, max(attempt_no) FILTER (error_type = 'ROBOTS_DISALLOWED') AS lr,
 arg_max(error_type, attempt_no) FILTER (error_type IS NOT NULL AND (error_type <> 'ROBOTS_DISALLOWED' OR is_root)) AS le FROM k GROUP BY 1)
SELECT merchant_id, pages_fetched, CASE WHEN pages_fetched > 0 THEN 'SUCCESS' WHEN ln = lr THEN 'ROBOTS_DISALLOWED' ELSE coalesce(le, 'CRAWL_FAILED') END AS crawl_status FROM g""")
def _(t):
    finer = typed_attempts(t).withColumn("merchant_id", F.col("merchant_id") * 40 + F.col("attempt_no") % 40)
    return crawl.merchant_crawl_status(finer).select("merchant_id", "pages_fetched", "crawl_status")


_HOPS = """SELECT l_orderkey AS fetch_id, CAST(l_linenumber - 1 AS INT) AS hop_no, concat('https://r', CAST(l_suppkey AS VARCHAR(20)), '.example.com/', CAST(l_partkey AS VARCHAR(20))) AS url,
 CAST(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 301 + l_partkey % 2 END AS INT) AS status_code FROM lineitem"""


@query("redirect_chains", "D4", f"""WITH h AS ({_HOPS}), s AS (SELECT fetch_id, hop_no, min(url || ' (status: ' || coalesce(CAST(status_code AS VARCHAR), 'None') || ')') AS step FROM h WHERE hop_no <= 4 GROUP BY 1, 2)
SELECT fetch_id, max(hop_no) AS redirects, max(hop_no) > 3 AS limit_exceeded, string_agg(step, ' -> ' ORDER BY hop_no) AS chain FROM s GROUP BY 1""")
def _(t):
    from .core import _bind_tables

    return crawl.redirect_chains(t.spark.sql(_bind_tables(_HOPS, t.directory)))


_SHOWN = " || ".join(f"'{label} ' || CASE WHEN {c} THEN 'Present' ELSE 'Missing' END" for label, c in [("Contact", "has_contact"), (", Policy", "has_policy"), (", About", "has_about")])


@query("merchant_claims", "D5", f"""SELECT merchant_id,
 CASE WHEN crawl_status = 'SUCCESS' THEN CASE site_category WHEN 'ECOMMERCE' THEN 'E-commerce product catalog from ' || domain || CASE WHEN n_products > 0 THEN ' (' || n_products || ' product listings discovered)' ELSE '' END
   WHEN 'FINTECH_PAYMENTS' THEN 'Financial technology & payment services platform from ' || domain || ' — non-retail storefront' WHEN 'SAAS_SOFTWARE' THEN 'Software / SaaS platform from ' || domain || ' — could not confirm e-commerce retail catalog structure'
   WHEN 'INFORMATIONAL_INSTITUTION' THEN 'Educational / institutional portal from ' || domain || ' — could not confirm e-commerce catalog structure' ELSE 'Website content from ' || domain || ' — could not confirm e-commerce catalog structure' END
  WHEN crawl_status = 'ROBOTS_DISALLOWED' THEN 'Website content from ' || domain || ' — could not retrieve catalog (robots.txt restricts automated access)' WHEN crawl_status = 'BOT_BLOCKED' THEN 'Website content from ' || domain || ' — could not retrieve catalog (site blocked automated access)'
  WHEN crawl_status = 'REDIRECT_LIMIT_EXCEEDED' THEN 'Website content from ' || domain || ' — could not retrieve catalog (site exceeded maximum allowed redirect hops, possible redirect loop or geo/consent wall)'
  ELSE 'Website content from ' || domain || ' — could not retrieve catalog (unreachable domain or connection error)' END AS inventory_claim,
 CASE WHEN crawl_status = 'SUCCESS' THEN CASE site_category WHEN 'FINTECH_PAYMENTS' THEN 'Corporate brand' WHEN 'INFORMATIONAL_INSTITUTION' THEN 'Institutional' ELSE 'Brand' END || ' identity claimed as ' || merchant_name
  ELSE 'Brand identity claimed as ' || merchant_name || CASE crawl_status WHEN 'ROBOTS_DISALLOWED' THEN ' (automated extraction restricted by robots.txt)' WHEN 'BOT_BLOCKED' THEN ' (automated access blocked by anti-bot WAF)' WHEN 'REDIRECT_LIMIT_EXCEEDED' THEN ' (unverified — redirect limit exceeded)' ELSE ' (unverified — site unreachable)' END END AS brand_claim,
 CASE WHEN crawl_status = 'SUCCESS' THEN CASE WHEN site_category IN ('FINTECH_PAYMENTS', 'SAAS_SOFTWARE') THEN 'Platform disclosures: ' WHEN site_category = 'INFORMATIONAL_INSTITUTION' THEN 'Disclosures: ' ELSE 'Website disclosures: ' END || {_SHOWN}
  WHEN crawl_status = 'ROBOTS_DISALLOWED' THEN 'Compliance policy: Merchant enforces robots.txt crawler access restrictions' WHEN crawl_status = 'BOT_BLOCKED' THEN 'Protection policy: Target site deploys active anti-bot protection (HTTP 403)'
  WHEN crawl_status = 'REDIRECT_LIMIT_EXCEEDED' THEN 'Crawl diagnostic: redirect chain exceeded safety limit of 3 hops during automated SSRF-validated crawl' ELSE 'Compliance unverifiable: ' || coalesce(crawl_error, 'Crawl failed') END AS compliance_claim
FROM v_crawl""")
def _(t):
    return crawl.claim_texts(t.view("v_crawl")).select("merchant_id", "inventory_claim", "brand_claim", "compliance_claim")
