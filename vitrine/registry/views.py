"""Merchant-risk views over the given star-schema tables.

One SQL text serves both engines wherever the dialects agree; vector views have one
text per engine. Every view covers whole tables, so its size grows with them.
"""

from __future__ import annotations

COMMON = {
    "v_merchant": """
SELECT s_suppkey AS merchant_id, s_name AS merchant_name,
  concat('shop', CAST(s_suppkey AS VARCHAR(20)), '.example.com') AS domain,
  CASE s_suppkey % 4 WHEN 0 THEN 'Luxe Atelier' WHEN 1 THEN 'Apex Brands' ELSE s_name END AS claimed_brand
FROM supplier""",
    "v_crawl": """
SELECT s_suppkey AS merchant_id, s_name AS merchant_name,
  concat('shop', CAST(s_suppkey AS VARCHAR(20)), '.example.com') AS domain,
  CASE WHEN s_suppkey % 19 = 0 THEN 'BOT_BLOCKED' WHEN s_suppkey % 23 = 0 THEN 'ROBOTS_DISALLOWED'
       WHEN s_suppkey % 29 = 0 THEN 'REDIRECT_LIMIT_EXCEEDED' WHEN s_suppkey % 31 = 0 THEN 'TIMEOUT'
       WHEN s_suppkey % 37 = 0 THEN NULL ELSE 'SUCCESS' END AS crawl_status,
  CASE WHEN s_suppkey % 38 = 0 THEN 'HTTP 403 returned' WHEN s_suppkey % 31 = 0 AND s_suppkey % 2 = 1 THEN 'connect timed out' END AS crawl_error,
  s_suppkey % 2 = 0 AS has_contact, s_suppkey % 3 <> 0 AS has_policy, s_suppkey % 5 <> 0 AS has_pricing,
  s_suppkey % 7 <> 0 AS has_about, CAST(s_suppkey % 4 AS INT) AS n_social,
  CASE s_suppkey % 6 WHEN 0 THEN 'FINTECH_PAYMENTS' WHEN 1 THEN 'SAAS_SOFTWARE' WHEN 2 THEN 'GENERAL_WEBSITE'
    WHEN 3 THEN 'INFORMATIONAL_INSTITUTION' ELSE 'ECOMMERCE' END AS site_category,
  CAST(s_suppkey % 13 AS INT) AS n_products
FROM supplier""",
    "v_signal": """
SELECT s_suppkey AS merchant_id,
  CAST((s_suppkey * 37) % 101 AS DOUBLE) AS reuse_risk_score, CAST((s_suppkey * 53) % 101 AS DOUBLE) AS logo_risk,
  CAST((s_suppkey * 71) % 101 AS DOUBLE) AS manipulation_score, CAST((s_suppkey * 29) % 89 AS DOUBLE) AS synthetic_score,
  CAST((s_suppkey * 43) % 101 AS DOUBLE) AS coherence_score, CAST((s_suppkey * 17) % 81 AS DOUBLE) AS e4_score,
  CAST((s_suppkey * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS max_similarity,
  CASE s_suppkey % 5 WHEN 0 THEN 'NO_EXTERNAL_MATCH' WHEN 1 THEN 'WEAK_MATCH' WHEN 2 THEN 'INSUFFICIENT_EVIDENCE'
       WHEN 3 THEN 'CORROBORATED_EXTERNAL_MATCH' ELSE 'CROSS_MERCHANT_REUSE' END AS match_status,
  s_suppkey % 5 < 2 AS is_own_brand,
  CASE s_suppkey % 7 WHEN 0 THEN 'SUPPLIER_CATALOG' WHEN 1 THEN 'SOFT_TRUST' WHEN 2 THEN 'MARKETPLACE' ELSE 'ONLINE' END AS source_type,
  CASE WHEN s_suppkey % 11 <> 0 THEN concat('rival', CAST(s_suppkey % 9 AS VARCHAR(20)), '.org') END AS source_domain,
  CASE WHEN s_suppkey % 13 = 0 THEN concat('ref_', CAST(s_suppkey AS VARCHAR(20)), '.jpg') END AS reference_filename,
  CASE WHEN s_suppkey % 17 = 0 THEN concat('mch_***', CAST(s_suppkey AS VARCHAR(20))) END AS masked_one,
  CAST((s_suppkey * 61) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS logo_similarity,
  CASE WHEN s_suppkey % 3 <> 2 THEN concat('verified_brand_', CAST(s_suppkey % 12 AS VARCHAR(20)), '.png') END AS matched_logo,
  CAST(s_suppkey % 6 AS INT) AS image_count, CAST((s_suppkey * 31) % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS average_similarity,
  CAST((s_suppkey * 23) % 89 AS DOUBLE) / CAST(89 AS DOUBLE) AS top_k_similarity,
  CAST(s_suppkey % 3 AS INT) AS strong_match_count, CAST(s_suppkey % 4 AS INT) AS moderate_match_count,
  CASE WHEN (s_suppkey * 71) % 101 >= 60 THEN 'HIGH' WHEN (s_suppkey * 71) % 101 >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS manipulation_level,
  CAST(s_suppkey % 3 AS INT) AS region_count,
  CAST((s_suppkey * 41) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS local_similarity
FROM supplier""",
    "v_image": """
SELECT p_partkey AS img_ord, p_partkey % 50 AS merchant_id,
  concat('https://cdn.example.com/', p_type, '/', replace(p_name, ' ', '-'), '-', CAST(p_partkey % 700 AS VARCHAR(20)),
    CASE p_partkey % 11 WHEN 0 THEN '.svg' WHEN 1 THEN '-icon.png' WHEN 2 THEN '-1x1.gif' ELSE '.jpg' END) AS src,
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN concat('photo of ', p_name) ELSE p_name END AS alt,
  CASE WHEN p_partkey % 6 = 0 THEN concat('title ', p_name) ELSE '' END AS title,
  CASE WHEN p_partkey % 13 = 0 THEN 'site-logo' ELSE 'card' END AS img_class,
  CASE WHEN p_partkey % 13 = 0 THEN 'logo' WHEN p_partkey % 17 = 0 THEN 'certificate' WHEN p_partkey % 19 = 0 THEN 'banner' ELSE 'product_image' END AS asset_type,
  p_partkey % 13 = 0 OR p_partkey % 34 = 0 AS is_logo_candidate, CAST(p_size * 20 AS INT) AS width, CAST((p_partkey % 40) * 15 + 10 AS INT) AS height,
  CAST((p_partkey * 7919) % 12000000 AS BIGINT) AS n_bytes
FROM part""",
    "v_hash": """
SELECT p_partkey AS asset_ord, p_partkey % 50 AS merchant_id,
  (((p_partkey % 50) * 7919 + CAST(floor(p_partkey / CAST(500 AS DOUBLE)) AS BIGINT) * 104729) % 65536) * 4294967296 + CAST(p_size % 8 AS BIGINT) AS dhash
FROM part""",
    "v_attempt": """
SELECT o_custkey AS merchant_id, o_orderkey AS attempt_no,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'HTTPError' WHEN '2-HIGH' THEN 'Timeout' WHEN '3-MEDIUM' THEN 'ConnectionError'
       WHEN '4-NOT SPECIFIED' THEN 'TooManyRedirects'
       ELSE CASE o_orderkey % 7 WHEN 0 THEN 'SSLError' WHEN 1 THEN 'RobotsDisallowed' WHEN 2 THEN 'SsrfBlocked' WHEN 3 THEN 'Other' ELSE 'OK' END END AS error_class,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 500 END AS INT) AS http_status,
  CASE o_orderkey % 3 WHEN 0 THEN 'getaddrinfo failed' WHEN 1 THEN 'Connection refused' ELSE 'reset by peer' END AS error_msg,
  o_orderkey % 9 = 0 AS is_root,
  CASE o_orderkey % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/xhtml+xml' WHEN 2 THEN 'Text/HTML' ELSE 'image/png' END AS content_type
FROM orders""",
    "v_block": """
SELECT l_suppkey AS asset_id, l_orderkey AS cell, l_quantity / CAST(10 AS DOUBLE) AS energy, l_extendedprice / CAST(1000 AS DOUBLE) AS local_std,
  l_discount AS ring_value, CAST(l_linenumber AS INT) AS ring, CAST(l_partkey % 320 AS INT) AS x, CAST(l_orderkey % 200 AS INT) AS y
FROM lineitem""",
    "v_event": """
SELECT user_id AS job_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'crawl'
    WHEN 'view' THEN CASE event_id % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'extract' WHEN 2 THEN 'prioritize' WHEN 3 THEN 'candidates' ELSE 'vit' END
    WHEN 'click' THEN CASE event_id % 6 WHEN 0 THEN 'fusion' WHEN 1 THEN 'logo' WHEN 2 THEN 'reuse' WHEN 3 THEN 'manipulation' WHEN 4 THEN 'identity' ELSE 'audit' END
    WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS step,
  concat('event ', CAST(event_id AS VARCHAR(20))) AS message,
  value AS latency_ms FROM events""",
    "v_eval": """
SELECT l.doc_id AS case_id, CASE WHEN l.toxic = 1 THEN 'HIGH' WHEN l.quality = 0 THEN 'MEDIUM' ELSE 'LOW' END AS ground_truth,
  CASE l.doc_id % 13 WHEN 0 THEN 'legitimate_merchant' WHEN 1 THEN 'ambiguous_insufficient_evidence' WHEN 2 THEN 'supplier_catalog_reuse'
    WHEN 3 THEN 'stock_image_reuse' WHEN 4 THEN 'cross_merchant_reuse' WHEN 5 THEN 'suspicious_external_match' WHEN 6 THEN 'fake_distorted_logo'
    WHEN 7 THEN 'manipulated_document' WHEN 8 THEN 'manipulated_product_image' WHEN 9 THEN 'mixed_legitimate_suspicious' ELSE 'unspecified' END AS case_type,
  CASE WHEN d.n_chars > 3000 THEN 'HIGH' WHEN d.n_chars > 800 THEN 'MEDIUM' ELSE 'LOW' END AS pred_a,
  CASE d.lang WHEN 'en' THEN 'LOW' WHEN 'fr' THEN 'MEDIUM' ELSE 'HIGH' END AS pred_b,
  CASE WHEN d.n_chars > 3000 OR d.lang NOT IN ('en', 'fr') THEN 'HIGH' WHEN d.n_chars > 800 OR d.lang = 'fr' THEN 'MEDIUM' ELSE 'LOW' END AS pred_c,
  CASE WHEN d.n_chars > 3000 AND d.lang = 'en' THEN 'MEDIUM' ELSE 'LOW' END AS pred_d,
  CAST(d.n_chars % 1000 AS DOUBLE) / CAST(10 AS DOUBLE) AS score_d
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_prediction": """
SELECT case_id, ground_truth, case_type, 'dhash' AS method, pred_a AS pred FROM v_eval
UNION ALL SELECT case_id, ground_truth, case_type, 'cosine' AS method, pred_b AS pred FROM v_eval
UNION ALL SELECT case_id, ground_truth, case_type, 'cosine_dhash' AS method, pred_c AS pred FROM v_eval
UNION ALL SELECT case_id, ground_truth, case_type, 'full_system' AS method, pred_d AS pred FROM v_eval""",
    # web-detection payloads, one per part; lists are '|'-separated text
    "v_web": """
SELECT p_partkey AS asset_id, concat('https://shop', CAST(p_partkey % 50 AS VARCHAR(20)), '.example.com/i/', CAST(p_partkey AS VARCHAR(20)), '.jpg') AS asset_url,
  CASE WHEN p_partkey % 5 = 0 THEN 'certificate' ELSE 'product_image' END AS asset_type,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('shop', CAST(p_partkey % 50 AS VARCHAR(20)), '.example.com') END AS merchant_domain,
  CASE WHEN p_partkey % 4 = 0 THEN concat('https://m.amazon.com/i/', CAST(p_partkey AS VARCHAR(20)), '|https://cdn.shop', CAST(p_partkey % 50 AS VARCHAR(20)), '.example.com/x.jpg') ELSE '' END AS full_urls,
  CASE WHEN p_partkey % 6 = 1 THEN concat('https://rival', CAST(p_partkey % 9 AS VARCHAR(20)), '.org/p.jpg|https://rival', CAST(p_partkey % 9 AS VARCHAR(20)), '.org/p.jpg') ELSE '' END AS partial_urls,
  CASE WHEN p_partkey % 7 = 2 THEN 'https://pin.example.net/s.jpg' ELSE '' END AS similar_urls,
  CASE p_partkey % 8 WHEN 1 THEN concat('https://www.ebay.com/itm/', CAST(p_partkey AS VARCHAR(20)), '|https://www.ebay.com/itm/', CAST(p_partkey AS VARCHAR(20)), '|https://blog', CAST(p_partkey % 5 AS VARCHAR(20)), '.net/a')
    WHEN 2 THEN concat('https://shop', CAST(p_partkey % 50 AS VARCHAR(20)), '.example.com/self') WHEN 3 THEN 'https://www.pexels.com/photo/1|https://unsplash.com/2' WHEN 4 THEN concat('http://a.net/1|http://b.net/2|http://c.net/3|http://d.net/4|http://e.net/5|http://f.net/', CAST(p_partkey AS VARCHAR(20)))
    WHEN 5 THEN 'https://etsy.com/listing/7' ELSE '' END AS page_urls
FROM part""",
    "v_evidence": """
SELECT l_suppkey * 200 + l_orderkey % 200 AS merchant_id, l_orderkey * 10 + l_linenumber AS item,
  CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 'external_image_reuse' WHEN 1 THEN 'potential_logo_mismatch' WHEN 2 THEN 'manipulation' ELSE 'cross_merchant_visual_similarity' END AS signal_type,
  CAST(CASE WHEN l_orderkey % 3 = 0 THEN (l_partkey * 7) % 101 ELSE (l_partkey * 3) % 45 END AS INT) AS score,
  l_orderkey % 5 < 4 AS is_marketplace_only, l_orderkey % 11 = 0 AS is_stock_only, l_orderkey % 13 = 0 AS corroborated, 'POTENTIAL_REUSE' AS asset_evidence_level
FROM lineitem""",
    "v_page": "SELECT page_id, page_id % 25 AS merchant_id, url, html FROM pages",
    "v_doc": "SELECT doc_id, doc_id % 40 AS merchant_id, text, lang, source FROM documents",
    # one storefront page per part: header with logo, gallery, badges, structured data
    "v_html": """
SELECT p_partkey AS page_id, CAST(floor(p_partkey / CAST(50 AS DOUBLE)) AS BIGINT) AS merchant_id,
  concat('https://www.shop', CAST(CAST(floor(p_partkey / CAST(50 AS DOUBLE)) AS BIGINT) AS VARCHAR(20)), '.example.com/products/', CAST(p_partkey AS VARCHAR(20)), '/') AS url,
  concat('<!DOCTYPE html><html><head>',
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('<title>', p_name, CASE p_partkey % 4 WHEN 0 THEN ' | Official Store | ' WHEN 1 THEN ' - ' WHEN 2 THEN ' — Shop — ' ELSE ' : ' END, p_brand, ' &amp; Co</title>') END,
    '<meta property="og:title" content="', p_brand, ' featured">',
    CASE p_partkey % 3 WHEN 0 THEN concat('<meta name="description" content=" Buy ', p_name, ' now ">') WHEN 1 THEN concat('<meta property="og:description" content="', p_type, ' goods">') ELSE concat('<meta name="twitter:description" content="tweet ', p_name, '">') END,
    CASE WHEN p_partkey % 7 = 0 THEN concat('<meta property="og:site_name" content="', p_brand, ' House">') ELSE '' END,
    CASE WHEN p_partkey % 6 = 0 THEN concat('<meta property="og:image" content="/og/', CAST(p_partkey AS VARCHAR(20)), '.jpg">') ELSE '' END,
    CASE WHEN p_partkey % 8 = 0 THEN concat('<script type="application/ld+json">{"@type":"Organization","name":"', p_brand, ' Org"}</script>') ELSE '' END,
    '<script type="application/ld+json">',
    CASE p_partkey % 4
      WHEN 0 THEN concat('{"@type":"Product","name":"', p_name, '","description":"A ', p_type, ' item","image":"/img/', CAST(p_partkey AS VARCHAR(20)), '.jpg","offers":{"price":"', CAST(p_size AS VARCHAR(20)), '.50"}}')
      WHEN 1 THEN concat('[{"@type":"Product","name":"', p_name, '","image":["/img/a', CAST(p_partkey AS VARCHAR(20)), '.jpg","/img/b.jpg"],"offers":{"price":"', CAST(p_size AS VARCHAR(20)), '"}},{"@type":"Product","name":"', p_type, ' bundle","offers":[{"price":"1"}]},{"@type":"Thing","name":"x"}]')
      WHEN 2 THEN concat('{"@type":"Product","name":"","image":"/img/none.jpg"}')
      ELSE '{"@type":"WebSite","url":"https://example.com"}' END,
    '</script><style>.a{color:red}</style></head><body><header><a class="navbar" href="/"><img class="site-mark" src="/assets/mark', CAST(CAST(floor(p_partkey / CAST(50 AS DOUBLE)) AS BIGINT) AS VARCHAR(20)), '.png" alt="home"></a></header>',
    '<nav><a href="/about-us">About</a><a href="/contact">Contact</a><a href="https://www.facebook.com/', replace(p_brand, '#', ''), '">fb</a><a href="https://other.example.org/shop">ext</a><a href="/blog/', CAST(p_partkey AS VARCHAR(20)), '">Blog</a><a href="/products/', CAST((p_partkey * 7) % 911 AS VARCHAR(20)), '/">More</a></nav>',
    '<div class="hero"><img class="', CASE WHEN p_partkey % 2 = 0 THEN 'hero-slide' ELSE 'wide' END, '" src="/media/', CASE WHEN p_partkey % 9 = 0 THEN 'banner' ELSE 'top' END, CAST(p_partkey % 90 AS VARCHAR(20)), '.jpg" alt="sale"></div>',
    '<main><details><img src="/img/', CAST(p_partkey AS VARCHAR(20)), '.jpg" alt="', p_name, '" title="', p_type, '" width="', CAST(p_size * 20 AS VARCHAR(20)), '" height="300"></details>',
    '<img data-src="https://cdn.example.com/lazy/', CAST(p_partkey AS VARCHAR(20)), '.jpg" class="thumb">',
    '<img srcset="/set/', CAST(p_partkey % 60 AS VARCHAR(20)), '.jpg 2x, /set/big.jpg 3x" id="', CASE WHEN p_partkey % 10 = 0 THEN 'brand-wall' ELSE 'pic' END, '">',
    CASE WHEN p_partkey % 4 = 1 THEN '<img src="/badges/iso9001.png" alt="ISO award">' ELSE '' END,
    '<img src="data:image/png;base64,AAAA"><img src="/img/', CAST(p_partkey AS VARCHAR(20)), '.jpg"></main>',
    '<p>', p_name, ' by ', p_brand, '. Price: $', CAST(p_size AS VARCHAR(20)), CASE p_partkey % 3 WHEN 0 THEN '. Add to cart or buy now. Read our return policy.' WHEN 1 THEN '. Contact us by phone.' ELSE '. Our story and about us page.' END, '</p>',
    '<script>var x = "<b>";</script><!-- hidden note --></body></html>') AS html
FROM part""",
}

_SPARK_VECTORS = {
    # base vectors, an exact copy of each and a blend of each with another vector
    "v_asset": """
SELECT vec_id AS asset_id, vec_id % 50 AS merchant_id, CAST(embedding AS ARRAY<DOUBLE>) AS embedding,
  concat('shop', CAST(vec_id % 50 AS VARCHAR(20)), '.example.com') AS domain, concat('hash', CAST(vec_id AS VARCHAR(20))) AS asset_hash, CAST(0 AS INT) AS batch_no FROM embeddings
UNION ALL
SELECT vec_id + 1000000, (vec_id + 7) % 50, CAST(embedding AS ARRAY<DOUBLE>),
  concat(CASE WHEN vec_id % 3 = 0 THEN 'www.' ELSE '' END, 'shop', CAST((vec_id + 7) % 50 AS VARCHAR(20)), '.example.com'), concat('hash', CAST(vec_id + 1000000 AS VARCHAR(20))), CAST(1 AS INT) FROM embeddings
UNION ALL
SELECT a.vec_id + 2000000, (a.vec_id + 3) % 50,
  zip_with(a.embedding, b.embedding, (x, y) -> a.w * CAST(x AS DOUBLE) + sqrt(1 - a.w * a.w) * CAST(y AS DOUBLE)),
  concat(CASE WHEN a.vec_id % 4 = 0 THEN 'cdn.' ELSE '' END, 'shop', CAST((a.vec_id + 3) % 50 AS VARCHAR(20)), '.example.com'), concat('hash', CAST(a.vec_id + 2000000 AS VARCHAR(20))), CAST(2 AS INT)
FROM (SELECT vec_id, embedding, (vec_id + 100) % (SELECT count(*) FROM embeddings) AS other,
        CAST(CASE vec_id % 4 WHEN 0 THEN 0.97 WHEN 1 THEN 0.89 WHEN 2 THEN 0.76 ELSE 0.61 END AS DOUBLE) AS w
      FROM embeddings) a
JOIN embeddings b ON b.vec_id = a.other""",
    "v_candidate": """
SELECT c.asset_id, c.k, concat('cand_', CAST(c.asset_id AS VARCHAR(20)), '_', CAST(c.k AS VARCHAR(20))) AS candidate_id,
  CASE c.d WHEN 0 THEN 'www.alibaba.com' WHEN 1 THEN 'www.pinterest.com' WHEN 2 THEN 'rival-one.com' WHEN 3 THEN 'rival-two.org'
    WHEN 4 THEN concat('shop', CAST(c.asset_id % 20 AS VARCHAR(20)), '.example.com') WHEN 5 THEN 'stock.adobe.com' ELSE 'best-wholesale-mart.net' END AS source_domain,
  concat('shop', CAST(c.asset_id % 20 AS VARCHAR(20)), '.example.com') AS merchant_domain,
  CAST(a.embedding AS ARRAY<DOUBLE>) AS asset_embedding,
  zip_with(a.embedding, b.embedding, (x, y) -> c.w * CAST(x AS DOUBLE) + sqrt(1 - c.w * c.w) * CAST(y AS DOUBLE)) AS embedding
FROM (SELECT t.vec_id AS asset_id, k, n,
        CASE WHEN CAST(floor(t.vec_id / CAST(5 AS DOUBLE)) AS BIGINT) % 7 < 3 THEN 2 + CAST(floor(t.vec_id / CAST(5 AS DOUBLE)) AS BIGINT) % 2 ELSE (t.vec_id + k) % 7 END AS d,
        CAST(CASE WHEN t.vec_id % 8 = 7 THEN 0.3 ELSE CASE (t.vec_id * (1 + k)) % 5 WHEN 0 THEN 0.98 WHEN 1 THEN 0.9 WHEN 2 THEN 0.78 WHEN 3 THEN 0.62 ELSE 0.3 END END AS DOUBLE) AS w
      FROM (SELECT vec_id, (SELECT count(*) FROM embeddings) AS n, explode(array(0, 1, 2, 3)) AS k FROM embeddings) t) c
JOIN embeddings a ON a.vec_id = c.asset_id JOIN embeddings b ON b.vec_id = (c.asset_id + 100 + c.k) % c.n""",
    # registry of verified logos: every third one bears its merchant's brand, two are shared brands, the rest match no name
    "v_logo_registry": """
SELECT CASE s_suppkey WHEN 1 THEN 'verified_brand_luxe-atelier.png' WHEN 2 THEN 'verified_brand_apex-brands.png'
    ELSE concat('verified_brand_', lower(replace(s_name, 'Supplier#', CASE WHEN s_suppkey % 3 = 0 THEN 'maison' ELSE 'archive' END)), CASE WHEN s_suppkey % 2 = 0 THEN '.png' ELSE '.jpg' END) END AS filename,
  CAST(e.embedding AS ARRAY<DOUBLE>) AS embedding
FROM (SELECT s_suppkey, s_name, s_suppkey % (SELECT count(*) FROM embeddings) AS vec FROM supplier) s
JOIN embeddings e ON e.vec_id = s.vec""",
    "v_logo": """
SELECT m.merchant_id, m.claimed_brand, zip_with(a.embedding, b.embedding, (x, y) -> m.w * CAST(x AS DOUBLE) + sqrt(1 - m.w * m.w) * CAST(y AS DOUBLE)) AS embedding
FROM (SELECT s_suppkey AS merchant_id,
        CASE s_suppkey % 4 WHEN 0 THEN 'Luxe Atelier' WHEN 1 THEN 'Apex Brands' ELSE replace(s_name, 'Supplier#', 'Maison') END AS claimed_brand,
        CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE s_suppkey % n END AS va, (s_suppkey + 50) % n AS vb,
        CAST(CASE CAST(floor(s_suppkey / CAST(4 AS DOUBLE)) AS BIGINT) % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 WHEN 3 THEN 0.6 ELSE 0.2 END AS DOUBLE) AS w
      FROM (SELECT s_suppkey, s_name, (SELECT count(*) FROM embeddings) AS n FROM supplier) s) m
JOIN embeddings a ON a.vec_id = m.va JOIN embeddings b ON b.vec_id = m.vb""",
}


def _duck(sql: str) -> str:
    import re

    sql = re.sub(
        r"zip_with\((\w+)\.embedding, (\w+)\.embedding, \(x, y\) -> (\w)\.w \* CAST\(x AS DOUBLE\) \+ sqrt\(1 - \w\.w \* \w\.w\) \* CAST\(y AS DOUBLE\)\)",
        r"list_transform(list_zip(\1.embedding, \2.embedding), lambda p: \3.w * CAST(p[1] AS DOUBLE) + sqrt(1 - \3.w * \3.w) * CAST(p[2] AS DOUBLE))",
        sql,
    )
    sql = sql.replace("ARRAY<DOUBLE>", "DOUBLE[]")
    return sql.replace("explode(array(0, 1, 2, 3))", "unnest([0, 1, 2, 3])")


SPARK_VIEWS = {**COMMON, **_SPARK_VECTORS}
DUCK_VIEWS = {**COMMON, **{k: _duck(v) for k, v in _SPARK_VECTORS.items()}}
