"""Queries of the source and sink family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import index, search_payloads, sinks
from .core import query
from .evaluation import spark_sql
from .scoring import FUSED, decided

# one search per part; the provider's payload is built from the part itself
_PAYLOAD = """
SELECT p_partkey AS query_id, CASE p_partkey % 5 WHEN 0 THEN 'serper' WHEN 1 THEN 'serpapi' WHEN 2 THEN 'cse' WHEN 3 THEN 'html' ELSE 'serper' END AS provider,
 CASE p_partkey % 5
  WHEN 0 THEN concat('{"organic":[{"link":"https://a', CAST(p_partkey AS VARCHAR(20)), '.com/x","title":"', p_name, '","imageUrl":"//img.a.com/', CAST(p_partkey AS VARCHAR(20)), '.jpg"},{"link":"https://b.org/y","title":"second","images":[{"url":"https://b.org/i.jpg"}]},{"link":"https://c.net/z","title":"no image"}]}')
  WHEN 1 THEN concat('{"organic_results":[{"link":"https://s', CAST(p_partkey % 77 AS VARCHAR(20)), '.io/p","title":"', p_type, '","thumbnail":"http://t.io/1.png"},{"link":"nodomain","title":"bad","thumbnail":"http://t.io/2.png"}]}')
  WHEN 2 THEN concat('{"items":[{"link":"https://www.g', CAST(p_partkey % 33 AS VARCHAR(20)), '.com/q","title":"","pagemap":{"metatags":[{"og:image":"https://g.com/o.jpg"}]}},{"link":"https://h.com/r","title":"tw","pagemap":{"metatags":[{"twitter:image":"https://h.com/t.jpg"}]}}]}')
  WHEN 3 THEN concat('<html><div class="result results_links"><a class="result__a" href="//duck.example/l/?uddg=https%3A%2F%2Fr', CAST(p_partkey % 41 AS VARCHAR(20)), '.com%2Fp%3Fa%3D1&amp;rut=9"><b>', p_name, '</b> &amp; more</a><img src="//i.example/1.jpg"></div><div class="result"><a class="result__url" href="https://plain.example/2">Plain</a></div><div class="result"><a class="result__a" href="/relative">rel</a></div></html>')
  ELSE '{"organic":[]}' END AS payload FROM part"""
_FALLBACK = """
UNION ALL SELECT p_partkey, 'html', concat('<div class="result"><a class="result__a" href="https://fb', CAST(p_partkey % 13 AS VARCHAR(20)), '.example/">Fallback</a><img src="https://fb.example/i.png"></div>') FROM part WHERE p_partkey % 5 = 4 OR p_partkey % 10 = 0"""

_ROWS = """p AS (SELECT p_partkey AS q, p_partkey % 5 AS m, p_name, p_type FROM part),
r AS (SELECT q, 'serper' AS provider, 0 AS idx, 'https://a' || q || '.com/x' AS url, p_name AS title, '//img.a.com/' || q || '.jpg' AS img_src FROM p WHERE m = 0 UNION ALL SELECT q, 'serper', 1, 'https://b.org/y', 'second', 'https://b.org/i.jpg' FROM p WHERE m = 0 UNION ALL SELECT q, 'serper', 2, 'https://c.net/z', 'no image', NULL FROM p WHERE m = 0
 UNION ALL SELECT q, 'serpapi', 0, 'https://s' || (q % 77) || '.io/p', p_type, 'http://t.io/1.png' FROM p WHERE m = 1 UNION ALL SELECT q, 'serpapi', 1, 'nodomain', 'bad', 'http://t.io/2.png' FROM p WHERE m = 1
 UNION ALL SELECT q, 'cse', 0, 'https://www.g' || (q % 33) || '.com/q', '', 'https://g.com/o.jpg' FROM p WHERE m = 2 UNION ALL SELECT q, 'cse', 1, 'https://h.com/r', 'tw', 'https://h.com/t.jpg' FROM p WHERE m = 2
 UNION ALL SELECT q, 'html', 0, 'https://r' || (q % 41) || '.com/p?a=1', p_name || ' & more', '//i.example/1.jpg' FROM p WHERE m = 3 UNION ALL SELECT q, 'html', 1, 'https://plain.example/2', 'Plain', NULL FROM p WHERE m = 3
 UNION ALL SELECT q, 'html', 0, 'https://fb' || (q % 13) || '.example/', 'Fallback', 'https://fb.example/i.png' FROM p WHERE m = 4)"""


@query("search_results", "A3", f"WITH {_ROWS} SELECT q AS query_id, provider, idx, url, title, img_src FROM r")
def _(t):
    return search_payloads.provider_results(spark_sql(t, _PAYLOAD + _FALLBACK))


@query("web_candidates", "A4", f"""WITH {_ROWS}, d AS (SELECT *, regexp_extract(url, '^https?://([^/]*)', 1) AS dom, CASE WHEN img_src LIKE '//%' THEN 'https:' || img_src ELSE img_src END AS image_url FROM r WHERE idx < 8),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY idx) - 1 AS k FROM d WHERE dom <> '' AND image_url IS NOT NULL)
SELECT q AS query_id, CAST(k AS INT) AS k, 'web_' || idx || '_' || dom AS candidate_id, url AS source_url, dom AS source_domain, coalesce(nullif(title, ''), 'Public web match on ' || dom) AS title, 'ONLINE' AS source_type, image_url FROM k WHERE k < 4""")
def _(t):
    return search_payloads.web_candidates(search_payloads.provider_results(spark_sql(t, _PAYLOAD + _FALLBACK)))


@query("search_queries", "A4", "SELECT p_partkey, trim(CASE WHEN p_partkey % 5 = 0 THEN ' x ' ELSE p_name END) || ' shoes' AS search_query FROM part WHERE p_partkey % 5 <> 0 AND length(trim(p_name)) >= 2")
def _(t):
    hints = t.table("part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, " x ").otherwise(F.col("p_name")).alias("search_hint"))
    return search_payloads.search_queries(hints, "shoes").select("p_partkey", "search_query")


_WRITES = """SELECT CASE WHEN l_partkey % 50 = 0 THEN '' ELSE concat('h', CAST(l_partkey AS VARCHAR(20))) END AS asset_hash, l_suppkey AS merchant_id, concat('shop', CAST(l_suppkey AS VARCHAR(20)), '.example.com') AS domain, l_orderkey * 10 + l_linenumber AS ts FROM lineitem"""


@query("cross_merchant_index", "A5", f"""WITH w AS ({_WRITES}), r AS (SELECT *, row_number() OVER (PARTITION BY asset_hash ORDER BY ts DESC, merchant_id DESC) AS n FROM w WHERE asset_hash <> '') SELECT asset_hash, merchant_id, domain, ts FROM r WHERE n = 1""")
def _(t):
    return index.build_index(spark_sql(t, _WRITES)).select("asset_hash", "merchant_id", "domain", "ts")


_FILES = """SELECT p_partkey, concat(replace(p_name, ' ', '_'), CAST(p_partkey AS VARCHAR(20)), CASE p_partkey % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.webp' WHEN 3 THEN '.bmp' WHEN 4 THEN '.jpeg' ELSE '.txt' END) AS filename FROM part"""


@query("catalogue_manifest_changes", "A6", f"""WITH f AS ({_FILES}), o AS (SELECT filename FROM f WHERE p_partkey % 4 <> 0), n AS (SELECT filename FROM f WHERE p_partkey % 4 <> 1) SELECT coalesce(o.filename, n.filename) AS filename, CASE WHEN o.filename IS NULL THEN 'added' WHEN n.filename IS NULL THEN 'removed' ELSE 'kept' END AS change FROM o FULL JOIN n USING (filename)
WHERE regexp_matches(lower(coalesce(o.filename, n.filename)), '\\.(jpg|jpeg|png|webp|bmp)$')""")
def _(t):
    files = spark_sql(t, _FILES)
    return index.manifest_changes(files.filter("p_partkey % 4 <> 0"), files.filter("p_partkey % 4 <> 1"))


@query("response_rows", "A8", f"""WITH {FUSED} SELECT merchant_id, CAST(to_json(struct_pack(merchant_id := merchant_id, final_score := final_score, status := status, source_domain := source_domain, is_supplier := is_supplier, severe_count := severe_count)) AS VARCHAR) AS response FROM fused""")
def _(t):
    wide = decided(t).select("merchant_id", "final_score", "status", "source_domain", "is_supplier", "severe_count", F.lit(b"pixels").alias("image"))
    return sinks.response_rows(wide)
