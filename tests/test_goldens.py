"""Worked examples with known results."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions import urls
from vitrine.functions.ipnet import add_ip_blocked
from vitrine.operators import assets, candidates, crawl, evaluation, evidence, explain, pages, scoring
from vitrine.sources import search_payloads

# case, disclosure flags (contact, policy, pricing, about, social), text risk, visual risk, logo risk, final, ground
# truth, case type, predictions of the four methods
CASES = [
    ("clean_01_artisanal_terracotta", "11111", 15, 3.6, 15.0, 5.0, "LOW", "legitimate_merchant", "MEDIUM LOW MEDIUM LOW"),
    ("clean_02_flora_linen", "11111", 15, 3.6, 15.0, 5.0, "LOW", "no_external_evidence", "LOW LOW LOW LOW"),
    ("clean_03_artisan_leathercraft", "11111", 15, 17.6, 15.0, 8.7, "LOW", "ambiguous_insufficient_evidence", "HIGH HIGH HIGH LOW"),
    ("clean_04_aura_glassworks", "11111", 15, 3.6, 15.0, 5.0, "LOW", "legitimate_merchant", "MEDIUM LOW MEDIUM LOW"),
    ("clean_05_timber_craft_studio", "11111", 15, 8.9, 15.0, 5.0, "LOW", "legitimate_merchant", "MEDIUM LOW MEDIUM LOW"),
    ("clean_06_solstice_bespoke_gems", "11111", 15, 8.5, 15.0, 5.0, "LOW", "no_external_evidence", "MEDIUM LOW MEDIUM LOW"),
    ("bord_01_urban_distributor", "10100", 45, 24.3, 15.0, 31.5, "MEDIUM", "supplier_catalog_reuse", "HIGH HIGH HIGH LOW"),
    ("bord_02_audio_direct_outlet", "11000", 40, 20.6, 15.0, 27.4, "MEDIUM", "supplier_catalog_reuse", "HIGH HIGH HIGH LOW"),
    ("bord_03_metro_streetwear", "01100", 50, 20.6, 15.0, 30.9, "MEDIUM", "supplier_catalog_reuse", "HIGH HIGH HIGH LOW"),
    ("bord_04_commuter_utility_bags", "10100", 45, 20.6, 15.0, 29.1, "MEDIUM", "supplier_catalog_reuse", "HIGH HIGH HIGH LOW"),
    ("bord_05_sports_audio_lab", "11100", 25, 20.6, 15.0, 22.1, "MEDIUM", "supplier_catalog_reuse", "HIGH HIGH HIGH LOW"),
    ("bord_06_lifestyle_collective", "10010", 55, 20.6, 15.0, 32.6, "MEDIUM", "supplier_catalog_reuse", "HIGH HIGH HIGH LOW"),
    ("cross_01_duplicated_apparel_store", "11100", 25, 6.6, 15.0, 13.0, "MEDIUM", "cross_merchant_reuse", "LOW LOW LOW LOW"),
    ("stock_01_modern_home_decor", "11101", 20, 21.2, 15.0, 17.8, "MEDIUM", "stock_image_reuse", "HIGH HIGH HIGH LOW"),
    ("susp_01_stolen_chronographs", "11111", 15, 23.5, 57.4, 12.5, "HIGH", "suspicious_external_match", "HIGH HIGH HIGH LOW"),
    ("susp_02_cloned_designer_leather", "11110", 20, 24.3, 62.9, 55.0, "HIGH", "fake_distorted_logo", "HIGH HIGH HIGH MEDIUM"),
    ("susp_03_reused_airmax_store", "11110", 20, 23.2, 55.5, 17.1, "HIGH", "suspicious_external_match", "HIGH HIGH HIGH LOW"),
    ("susp_04_pro_audio_clones", "11110", 20, 23.2, 55.9, 17.1, "HIGH", "suspicious_external_match", "HIGH HIGH HIGH LOW"),
    ("susp_05_luxury_gold_horology", "11110", 20, 23.5, 57.4, 17.3, "HIGH", "suspicious_external_match", "HIGH HIGH HIGH LOW"),
    ("susp_06_counterfeit_tote_bazaar", "11110", 20, 25.5, 70.8, 55.0, "HIGH", "fake_distorted_logo", "HIGH HIGH HIGH MEDIUM"),
    ("susp_07_tampered_incorporation_cert", "10100", 45, 6.6, 15.0, 20.0, "HIGH", "manipulated_document", "MEDIUM LOW MEDIUM LOW"),
    ("susp_08_spliced_luxury_watch", "11100", 25, 27.0, 15.0, 26.3, "HIGH", "manipulated_product_image", "HIGH HIGH HIGH LOW"),
    ("susp_09_hybrid_boutique_counterfeit", "11110", 20, 16.4, 70.6, 12.7, "HIGH", "mixed_legitimate_suspicious", "HIGH HIGH HIGH LOW"),
]
# cases whose reuse score stays at or above the near-duplicate bound
NEAR_DUPLICATE = {"susp_02_cloned_designer_leather", "susp_06_counterfeit_tote_bazaar"}


def test_published_final_scores(spark):
    rows = [
        (c[0], *[f == "1" for f in c[1][:4]], int(c[1][4]), c[3], c[4], 92.0 if c[0] in NEAR_DUPLICATE else 50.0) for c in CASES
    ]
    df = spark.createDataFrame(
        rows, "merchant_id string, has_contact boolean, has_policy boolean, has_pricing boolean, has_about boolean, n_social int,"
        " visual_risk_score double, logo_risk double, reuse_risk_score double"
    ).withColumns(
        {
            "crawl_status": F.lit("SUCCESS"), "crawl_error": F.lit(None).cast("string"), "site_category": F.lit("GENERAL_WEBSITE"),
            "match_status": F.lit("INSUFFICIENT_EVIDENCE"), "source_type": F.lit("ONLINE"), "manipulation_score": F.lit(5.0),
        }
    )
    got = {r["merchant_id"]: r for r in scoring.fuse(scoring.business_risk(df)).collect()}
    for c in CASES:
        assert got[c[0]]["text_risk_score"] == c[2], c[0]
        assert got[c[0]]["final_score"] == c[5], (c[0], got[c[0]]["final_score"])


def test_published_method_metrics(spark):
    names = ["dhash", "cosine", "cosine_dhash", "full_system"]
    rows = [(c[0], c[6], c[7], m, p) for c in CASES for m, p in zip(names, c[8].split())]
    preds = spark.createDataFrame(rows, "case_id string, ground_truth string, case_type string, method string, pred string")
    got = {r["method"]: r for r in evaluation.method_metrics(preds).collect()}
    want = {
        # accuracy, macro P/R/F1, weighted P/F1, FPR %, FNR %
        "dhash": (0.3913, 0.3333, 0.3519, 0.2967, 0.3261, 0.3157, 83.33, 0.0),
        "cosine": (0.5652, 0.4048, 0.5741, 0.4697, 0.382, 0.4511, 16.67, 11.11),
        "cosine_dhash": (0.3913, 0.3333, 0.3519, 0.2967, 0.3261, 0.3157, 83.33, 0.0),
        "full_system": (0.2609, 0.0952, 0.3333, 0.1481, 0.0745, 0.1159, 0.0, 77.78),
    }
    for m, w in want.items():
        r = got[m]
        assert (r.accuracy, r.precision_macro, r.recall_macro, r.f1_macro, r.precision_weighted, r.f1_weighted,
                r.false_positive_rate_pct, r.false_negative_rate_pct) == w
    cells = {(r.actual, r.predicted): r.n for r in evaluation.confusion_matrix(preds).filter("method = 'full_system'").collect()}
    assert [cells["LOW", p] for p in evaluation.LABELS] == [6, 0, 0]
    assert [cells["HIGH", p] for p in evaluation.LABELS] == [7, 2, 0]
    coverage = {r.case_type: r.cases for r in evaluation.case_coverage(preds.filter("method = 'dhash'")).collect()}
    assert [coverage[a] for a in evaluation.ARCHETYPES] == [3, 1, 6, 1, 1, 4, 2, 1, 1, 2 - 1, 2]


BASE = dict(
    crawl_status="SUCCESS", crawl_error=None, has_contact=True, has_policy=True, has_pricing=True, has_about=True, n_social=1,
    site_category="GENERAL_WEBSITE", reuse_risk_score=0.0, e4_score=0.0, max_similarity=0.0, match_status="NO_EXTERNAL_MATCH",
    is_own_brand=True, source_type="NONE", logo_risk=10.0, manipulation_score=10.0, synthetic_score=10.0, coherence_score=85.0,
)
SCHEMA = (
    "crawl_status string, crawl_error string, has_contact boolean, has_policy boolean, has_pricing boolean, has_about boolean, n_social int,"
    " site_category string, reuse_risk_score double, e4_score double, max_similarity double, match_status string, is_own_brand boolean,"
    " source_type string, logo_risk double, manipulation_score double, synthetic_score double, coherence_score double"
)


def decide(spark, **over):
    row = {**BASE, **over}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return scoring.decide(spark.createDataFrame([tuple(row[n] for n in names)], SCHEMA)).first()


@pytest.mark.parametrize(
    "over, visual, final, status",
    [
        (dict(reuse_risk_score=64.0, match_status="INSUFFICIENT_EVIDENCE", is_own_brand=False, logo_risk=15.0, coherence_score=80.0), 21.9, None, "LOW"),
        (dict(reuse_risk_score=88.0, e4_score=75.0, match_status="CORROBORATED_EXTERNAL_MATCH", is_own_brand=False, logo_risk=75.0,
              manipulation_score=65.0, synthetic_score=20.0, coherence_score=50.0), 81.7, None, "HIGH"),
        (dict(manipulation_score=25.0), None, 5.0, "LOW"),
        (dict(e4_score=20.0, match_status="INSUFFICIENT_EVIDENCE", is_own_brand=False, synthetic_score=5.0, coherence_score=80.0), 14.8, None, "LOW"),
        (dict(reuse_risk_score=91.7, match_status="CORROBORATED_EXTERNAL_MATCH", is_own_brand=False, logo_risk=75.0,
              manipulation_score=70.0, synthetic_score=25.0, coherence_score=30.0), 84.3, None, "HIGH"),
        (dict(reuse_risk_score=18.0, match_status="CORROBORATED_EXTERNAL_MATCH", is_own_brand=False, source_type="SUPPLIER_CATALOG"), None, None, "LOW"),
    ],
)
def test_calibration(spark, over, visual, final, status):
    r = decide(spark, **over)
    if visual is not None:
        assert r.visual_risk_score == visual
    if final is not None:
        assert r.final_score == final
    assert r.status == status


@pytest.mark.parametrize(
    "text, visual, reuse, logo, manip, source, final, status",
    [
        (15.0, 84.3, 91.7, 75.0, 70.0, "ONLINE", 84.3, "HIGH"),
        (40.0, 89.4, 94.0, 85.0, 75.0, "ONLINE", 89.4, "HIGH"),
        (75.0, 90.0, 95.0, 85.0, 80.0, "ONLINE", 90.0, "HIGH"),
        (15.0, 25.0, 18.0, 10.0, 10.0, "SUPPLIER_CATALOG", 21.5, "LOW"),
    ],
)
def test_fusion_without_trust_signals(spark, text, visual, reuse, logo, manip, source, final, status):
    df = spark.createDataFrame(
        [(text, visual, reuse, logo, manip, source)],
        "text_risk_score double, visual_risk_score double, reuse_risk_score double, logo_risk double, manipulation_score double, source_type string",
    ).withColumn("match_status", F.lit("CORROBORATED_EXTERNAL_MATCH"))
    flags = {f"sig_{f}": F.lit(False) for f in ("contact", "policy", "about", "social")}
    r = scoring.fuse(df.withColumns({**flags, "non_retail": F.lit(False)})).first()
    assert (r.final_score, r.status) == (final, status)


def test_scores_stay_in_bounds(spark, tables):
    from vitrine.registry.scoring import decided

    bad = decided(tables).filter(
        (F.col("final_score") < 5) | (F.col("final_score") > 100)
        | ((F.col("severe_count") < 2) & (F.col("final_score") >= 80))
        | (F.col("is_supplier") & (F.col("severe_count") < 2) & (F.col("final_score") > 38))
    )
    assert bad.count() == 0


@pytest.mark.parametrize(
    "items, brand, score, action",
    [
        ([("external_image_reuse", 65, True, False)], "UNAVAILABLE", 55, "ADDITIONAL_VERIFICATION"),
        ([("external_image_reuse", 80, False, False), ("potential_logo_mismatch", 85, False, False)], "VERIFIED", 84, "MANUAL_REVIEW"),
        ([("manipulation", 90, False, False)], "UNAVAILABLE", 90, "MANUAL_REVIEW"),
        ([("cross_merchant_visual_similarity", 58, False, False)], "UNAVAILABLE", 58, "ADDITIONAL_VERIFICATION"),
        ([("external_image_reuse", 85, False, True), ("potential_logo_mismatch", 80, False, False)], "VERIFIED", 84, "MANUAL_REVIEW"),
        ([], "UNAVAILABLE", 0, "NORMAL_FLOW"),
    ],
)
def test_evidence_list_risk(spark, items, brand, score, action):
    schema = "merchant_id long, signal_type string, score int, is_marketplace_only boolean, corroborated boolean"
    rows = spark.createDataFrame([(1, *i) for i in items], schema).withColumns(
        {"is_stock_only": F.lit(False), "asset_evidence_level": F.lit("POTENTIAL_REUSE")}
    )
    r = evidence.evidence_risk(rows, spark.createDataFrame([(1, brand)], "merchant_id long, brand_status string")).first()
    assert (r.risk_score, r.action) == (score, action)


@pytest.mark.parametrize(
    "cands, status, e4",
    [
        ([("www.amazon.com", 1.0)], "INSUFFICIENT_EVIDENCE", 20.0),
        ([("unknown-rival.com", 1.0)], "INSUFFICIENT_EVIDENCE", 35.0),
        ([("third-party.org", 1.0), ("third-party.org", 1.0)], "CORROBORATED_EXTERNAL_MATCH", 75.0),
        ([], "NO_EXTERNAL_MATCH", 0.0),
        ([("www.pinterest.com", 1.0)], "INSUFFICIENT_EVIDENCE", 20.0),
        ([("rival.net", 0.60), ("www.pinterest.com", 0.95)], "WEAK_MATCH", 18.0),
    ],
)
def test_match_status(spark, cands, status, e4):
    rows = [(1, i, f"c{i}", d, "shop1.example.com", [1.0, 0.0], [s, (1 - s * s) ** 0.5]) for i, (d, s) in enumerate(cands)]
    schema = "asset_id long, k int, candidate_id string, source_domain string, merchant_domain string, asset_embedding array<double>, embedding array<double>"
    verified = candidates.verify_candidates(spark.createDataFrame(rows, schema))
    r = candidates.match_status(spark.createDataFrame([(1,)], "asset_id long"), verified).first()
    assert (r.match_status, r.e4_score) == (status, e4)
    assert r.is_own_brand == (status in ("NO_EXTERNAL_MATCH", "WEAK_MATCH"))


def test_masking_and_addresses(spark):
    ids = spark.createDataFrame([("merchant_001",), ("M1",), ("",), (None,)], "m string")
    assert [r[0] for r in ids.select(urls.mask_merchant(F.col("m"))).collect()] == ["mch_***_001", "mch_***M1", "mch_***", "mch_***"]
    blocked = ["10.0.0.1", "127.0.0.1", "169.254.169.254", "192.168.1.1", "::1", "fe80::1", "::ffff:10.1.1.1", "fd00::1", "bad", "1.2.3", "01.2.3.4", "2001:db8::5"]
    public = ["8.8.8.8", "2606:4700::1111", "1.1.1.1", "2001:4860:4860::8888", "::ffff:8.8.8.8"]
    df = add_ip_blocked(spark.createDataFrame([(a,) for a in blocked + public], "ip string"), "ip", "b")
    got = {r.ip: r.b for r in df.collect()}
    assert all(got[a] for a in blocked) and not any(got[a] for a in public), got


HTML = """<html><head><title>Home | Official Store | Loom &amp; Thread</title>
<script type="application/ld+json">{"@type": "Store", "name": "Loom &amp; Thread"}</script>
<script type="application/ld+json">[{"@type":"Product","name":"Scarf","image":["/s.jpg"],"offers":{"price":12.5}}]</script></head>
<body><header><img src="/logo.png" class="site-logo" alt="Loom logo"></header>
<div class="hero"><img src="/assets/hero-banner.jpg" class="hero-banner"></div>
<img src="/docs/iso-certificate.png" alt="ISO certificate"><img src="/p/scarf.jpg" alt="Wool scarf">
<!-- <img src="/hidden.jpg"> --><script>document.write('<img src="/no.jpg">')</script>
<p>Contact us &eacute; Price: 10</p></body></html>"""


def test_page_extraction(spark):
    page = spark.createDataFrame([(1, 1, "https://www.loom.example/a/", HTML)], "merchant_id long, page_id long, url string, html string")
    images = {r.src.rsplit("/", 1)[1]: r for r in pages.page_images(page).collect()}
    assert {k: r.asset_type for k, r in images.items()} == {
        "logo.png": "logo", "hero-banner.jpg": "banner", "iso-certificate.png": "certificate", "scarf.jpg": "product_image"
    }
    assert images["logo.png"].is_logo_candidate
    facts = pages.crawl_facts(page).first()
    assert facts.merchant_name == "Loom & Thread"
    assert facts.title == "Home | Official Store | Loom & Thread"
    assert facts.logo_url == "https://www.loom.example/logo.png"
    assert facts.n_products == 1 and facts.site_category == "ECOMMERCE" and facts.has_contact
    assert "Contact us é" in facts.raw_text and "hidden" not in facts.raw_text
    product = pages.page_products(page).first()
    assert (product.name, product.price, product.image_url) == ("Scarf", "12.5", "https://www.loom.example/s.jpg")


def test_title_without_structured_data(spark):
    html = "<title>Buy now - Acme Tools - Online shop</title>"
    page = spark.createDataFrame([(1, 1, "https://acme-tools.example/", html)], "merchant_id long, page_id long, url string, html string")
    assert pages.crawl_facts(page).first().merchant_name == "Acme Tools"
    plain = spark.createDataFrame([(1, 1, "https://acme-tools2go.example/", "<p>x</p>")], "merchant_id long, page_id long, url string, html string")
    assert pages.crawl_facts(plain).first().merchant_name == "Acme Tools2Go"


def test_interface_images(spark):
    rows = [("https://a.com/pixel.gif", "", False), ("https://a.com/icons/facebook.svg", "", False), ("https://a.com/leather_bag.jpg", "", False), ("https://a.com/brand.svg", "", True)]
    df = spark.createDataFrame(rows, "src string, c string, l boolean")
    got = [r[0] for r in df.select(assets.is_interface_image(F.col("src"), F.col("c"), F.col("l"))).collect()]
    assert got == [True, True, False, False]


def test_unverifiable_states(spark):
    rows = [(1, "ROBOTS_DISALLOWED", "a.com"), (2, "BOT_BLOCKED", "b.com"), (3, "REDIRECT_LIMIT_EXCEEDED", "c.com"), (4, "TIMEOUT", "d.com")]
    df = spark.createDataFrame(rows, "merchant_id long, crawl_status string, domain string").withColumn("crawl_error", F.lit(None).cast("string"))
    got = {r.merchant_id: r for r in explain.unverifiable_decision(df).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["COMPLIANCE_LIMITED", "BOT_BLOCKED", "REDIRECT_LIMIT_EXCEEDED", "UNVERIFIABLE"]
    assert all(got[i].final_score is None and got[i].visual_risk_score is None for i in got)
    assert got[4].crawl_error is None and got[2].crawl_error.startswith("Anti-bot")
    assert got[3].reasons[0].endswith("on c.com.")


def test_robots_rules_in_file_order(spark):
    rules = [("h", 1, "/shop/public", True), ("h", 2, "/shop", False), ("h", 3, "", False), ("all", 1, "*", False), ("root", 1, "/$", False)]
    paths = [("h", "/shop/public/1"), ("h", "/shop/x"), ("h", "/other"), ("all", "/a"), ("none", "/a")]
    got = crawl.robots_verdicts(
        spark.createDataFrame(paths, "host string, path string"), spark.createDataFrame(rules, "host string, rule_order int, path string, allow boolean")
    )
    assert {(r.host, r.path): r.is_allowed for r in got.collect()} == {
        ("h", "/shop/public/1"): True, ("h", "/shop/x"): False, ("h", "/other"): True, ("all", "/a"): False, ("none", "/a"): True
    }


def test_serper_payload(spark):
    payload = '{"organic":[{"link":"https://x.com/1","title":"One","imageUrl":"https://x.com/1.jpg"},{"link":"https://y.com/2","title":"Two"}]}'
    df = spark.createDataFrame([(1, "serper", payload), (1, "serpapi", '{"organic_results":[{"link":"https://z.com"}]}'), (2, "serper", "{}")], "query_id long, provider string, payload string")
    got = search_payloads.provider_results(df).orderBy("idx").collect()
    assert [(r.provider, r.url, r.img_src) for r in got] == [("serper", "https://x.com/1", "https://x.com/1.jpg"), ("serper", "https://y.com/2", None)]
    assert [r.candidate_id for r in search_payloads.web_candidates(search_payloads.provider_results(df)).collect()] == ["web_0_x.com"]
