"""Queries of the evaluation family (SURVEY J) and its manifests and sinks (A2, A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation
from ..sources import manifests, sinks
from .core import _bind_tables, query, sql_round, sql_text, with_views
from .similarity import _COS
from .views import SPARK_VIEWS


def spark_sql(t, sql: str):
    return t.spark.sql(_bind_tables(with_views(sql, SPARK_VIEWS), t.directory))


_HASHED = """SELECT asset_id, merchant_id * 10 + asset_id % 10 AS case_id, embedding, batch_no,
 {xor}((asset_id % 1000000) * 1103515245 + 12345, CASE WHEN batch_no = 2 THEN {shift}(CAST(1 AS BIGINT), CAST(asset_id % 30 AS INT)) - 1 ELSE 0 END) AS dhash FROM v_asset"""
_HASHED_SPARK = _HASHED.replace("{xor}((asset_id % 1000000) * 1103515245 + 12345, CASE", "(((asset_id % 1000000) * 1103515245 + 12345) ^ CASE").replace("{shift}", "shiftleft")
_HASHED_DUCK = _HASHED.replace("{xor}", "xor").replace("{shift}(CAST(1 AS BIGINT), CAST(asset_id % 30 AS INT))", "(CAST(1 AS BIGINT) << CAST(asset_id % 30 AS INT))")


@query("baseline_predictions", "J1", f"""WITH h AS ({_HASHED_DUCK}), i AS (SELECT * FROM h WHERE batch_no > 0), r AS (SELECT * FROM h WHERE batch_no = 0), c AS (SELECT DISTINCT case_id FROM h WHERE batch_no > 0),
p AS (SELECT i.case_id, 1::DOUBLE - bit_count(xor(i.dhash, r.dhash)) / 64::DOUBLE AS hs, {_COS('i.embedding', 'r.embedding')} AS cs FROM i CROSS JOIN r), q AS (SELECT case_id, hs, {sql_round('cs', 4)} AS c4 FROM p),
b AS (SELECT c.case_id, coalesce(max(hs), 0) AS hs, coalesce(max(c4), 0) AS cs FROM c LEFT JOIN q USING (case_id) GROUP BY 1), x AS (SELECT *, greatest(hs, cs) AS both_s, hs * 100::DOUBLE AS h100, cs * 100::DOUBLE AS c100, greatest(hs, cs) * 100::DOUBLE AS b100 FROM b)
SELECT case_id, hs AS dhash_sim, cs AS cosine_sim, both_s AS both_sim, CASE WHEN hs >= 0.85 THEN 'HIGH' WHEN hs >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS dhash_pred, CASE WHEN cs >= 0.85 THEN 'HIGH' WHEN cs >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS cosine_pred,
 CASE WHEN both_s >= 0.85 THEN 'HIGH' WHEN both_s >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS cosine_dhash_pred, {sql_round('h100', 1)} AS dhash_score, {sql_round('c100', 1)} AS cosine_score, {sql_round('b100', 1)} AS cosine_dhash_score FROM x""")
def _(t):
    hashed = spark_sql(t, _HASHED_SPARK)
    images = hashed.filter("batch_no > 0")
    refs = hashed.filter("batch_no = 0").withColumn("filename", F.col("asset_id").cast("string"))
    return evaluation.baseline_predictions(hashed.filter("batch_no > 0").select("case_id").distinct(), images, refs)


@query("confusion_matrix", "J2", """WITH l AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH']) AS c), m AS (SELECT DISTINCT method FROM v_prediction)
SELECT m.method, a.c AS actual, p.c AS predicted, count(v.case_id) AS n FROM m CROSS JOIN l a CROSS JOIN l p LEFT JOIN v_prediction v ON v.method = m.method AND v.ground_truth = a.c AND v.pred = p.c GROUP BY 1, 2, 3""")
def _(t):
    return evaluation.confusion_matrix(t.view("v_prediction"))


_CLASS = """l AS (SELECT unnest(['LOW', 'MEDIUM', 'HIGH']) AS label), cnt AS (SELECT method, label, count(*) FILTER (pred = label AND ground_truth = label)::DOUBLE AS tp, count(*) FILTER (pred = label)::DOUBLE AS pp, count(*) FILTER (ground_truth = label)::DOUBLE AS tt FROM v_prediction CROSS JOIN l GROUP BY 1, 2),
cls AS (SELECT method, label, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN tt > 0 THEN tp / tt ELSE 0 END AS r, CASE WHEN pp + tt > 0 THEN 2 * tp / (pp + tt) ELSE 0 END AS f, tt FROM cnt)"""


@query("class_metrics", "J3", f"WITH {_CLASS} SELECT method, label, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, CAST(tt AS BIGINT) AS support FROM cls")
def _(t):
    m = evaluation.class_metrics(t.view("v_prediction"))
    return m.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_OVERALL = f"""{_CLASS}, mac AS (SELECT method, avg(p) AS pm, avg(r) AS rm, avg(f) AS fm, sum(p * tt) / sum(tt) AS pw, sum(r * tt) / sum(tt) AS rw, sum(f * tt) / sum(tt) AS fw FROM cls GROUP BY 1),
ov AS (SELECT method, count(*) AS n, count(*) FILTER (pred = ground_truth) AS ok, count(*) FILTER (ground_truth = 'LOW' AND pred <> 'LOW') AS fp, count(*) FILTER (ground_truth = 'LOW') AS nl, count(*) FILTER (ground_truth = 'HIGH' AND pred = 'LOW') AS fn, count(*) FILTER (ground_truth = 'HIGH') AS nh FROM v_prediction GROUP BY 1)"""


@query("method_metrics", "J4,J5", f"""WITH {_OVERALL} SELECT method, n AS total_cases, ok AS correct_cases, round(ok / n::DOUBLE, 4) AS accuracy, round(ok / n::DOUBLE * 100, 2) AS accuracy_pct, round(pm, 4) AS precision_macro, round(rm, 4) AS recall_macro, round(fm, 4) AS f1_macro,
 round(pw, 4) AS precision_weighted, round(rw, 4) AS recall_weighted, round(fw, 4) AS f1_weighted, round(fp / nl::DOUBLE, 4) AS false_positive_rate, round(fp / nl::DOUBLE * 100, 2) AS false_positive_rate_pct, fp AS clean_fp_count, nl AS clean_total,
 round(fn / nh::DOUBLE, 4) AS false_negative_rate, round(fn / nh::DOUBLE * 100, 2) AS false_negative_rate_pct, fn AS suspicious_fn_count, nh AS suspicious_total FROM ov JOIN mac USING (method)""")
def _(t):
    return evaluation.method_metrics(t.view("v_prediction"))


@query("method_comparison", "J6", f"""WITH u AS (SELECT method, case_type, count(*) AS cases, count(*) FILTER (pred = ground_truth) AS correct, count(*) FILTER (pred = ground_truth) / count(*)::DOUBLE AS a, GROUPING(method, case_type) AS level FROM v_prediction GROUP BY ROLLUP (method, case_type))
SELECT method, case_type, cases, correct, {sql_round('a', 4)} AS accuracy, level FROM u""")
def _(t):
    return evaluation.method_comparison(t.view("v_prediction"))


_ARCH = f"(SELECT unnest({evaluation.ARCHETYPES}) AS case_type, CAST(generate_subscripts({evaluation.ARCHETYPES}, 1) - 1 AS INT) AS ord)"


@query("case_coverage", "J7", f"SELECT ord, a.case_type, count(v.case_id) AS cases FROM {_ARCH} a LEFT JOIN v_eval v ON v.case_type = a.case_type GROUP BY 1, 2")
def _(t):
    return evaluation.case_coverage(t.view("v_eval"))


METHODS = ["dhash", "cosine", "cosine_dhash", "full_system"]


@query("case_comparison", "J8", """SELECT case_id, ground_truth, case_type, pred_a AS dhash, pred_b AS cosine, pred_c AS cosine_dhash, pred_d AS full_system, pred_a = ground_truth AS dhash_correct, pred_b = ground_truth AS cosine_correct, pred_c = ground_truth AS cosine_dhash_correct, pred_d = ground_truth AS full_system_correct, score_d AS final_score FROM v_eval""")
def _(t):
    final = t.view("v_eval").select("case_id", F.col("score_d").alias("final_score"))
    return evaluation.case_comparison(t.view("v_prediction"), METHODS, final)


@query("latency_summary", "J9", """SELECT step, count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean_ms, max(latency_ms) AS max_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM v_event GROUP BY 1""")
def _(t):
    s = evaluation.latency_summary(t.view("v_event"), "step")
    return s.withColumns({c: F.round(c, 6) for c in ("mean_ms", "p50_ms", "p95_ms")})


_MANIFEST = """SELECT concat('file:/data/eval_set/', CASE doc_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'borderline' WHEN 2 THEN 'suspicious' ELSE 'drafts' END, '/', CASE WHEN doc_id % 100 = 0 THEN 'clean_02_flora_linen' ELSE concat('case_', CAST(doc_id AS VARCHAR(20))) END, '/meta.json') AS path,
 doc_id, CASE WHEN doc_id % 3 = 0 THEN 'HIGH' END AS ground_truth, CASE WHEN doc_id % 5 = 0 THEN source END AS case_type, CASE WHEN doc_id % 7 <> 0 THEN concat('Shop ', lang) END AS name FROM v_doc"""


@query("case_manifests", "A2", f"""WITH m AS ({_MANIFEST}), s AS (SELECT *, string_split(path, '/') AS q FROM m), u AS (SELECT *, q[5] AS case_id, q[4] AS folder FROM s WHERE q[4] <> 'drafts')
SELECT doc_id, case_id, folder, coalesce(ground_truth, CASE folder WHEN 'clean' THEN 'LOW' WHEN 'borderline' THEN 'MEDIUM' ELSE 'HIGH' END) AS ground_truth, coalesce(case_type, 'unspecified') AS case_type, coalesce(name, case_id) AS merchant_name, case_id IN ({', '.join(sql_text(c) for c in manifests.ORIGINAL_CASES)}) AS is_original FROM u""")
def _(t):
    none = F.lit(None)
    raw = spark_sql(t, _MANIFEST).withColumns(
        {
            "ground_truth_risk_tier": none.cast("string"),
            "expected_evidence_summary": none.cast("string"),
            "claims": none.cast("struct<inventory_claim:string,brand_claim:string,compliance_claim:string>"),
        }
    )
    return manifests.case_rows(raw).select(
        "doc_id", "case_id", "folder", "ground_truth", "case_type", "merchant_name", F.col("case_id").isin(manifests.ORIGINAL_CASES).alias("is_original")
    )


@query("report_lines", "A7", f"""WITH {_OVERALL} SELECT method, '| **' || method || '** | **' || printf('%.1f', round(ok / n::DOUBLE * 100, 2)) || '%** (' || ok || '/' || n || ') | ' || printf('%.3f', round(pm, 4)) || ' | ' || printf('%.3f', round(rm, 4)) || ' | ' || printf('%.3f', round(fm, 4)) || ' | **' || printf('%.1f', round(fp / nl::DOUBLE * 100, 2)) || '%** (' || fp || '/' || nl || ') | ' || printf('%.1f', round(fn / nh::DOUBLE * 100, 2)) || '% (' || fn || '/' || nh || ') |' AS line FROM ov JOIN mac USING (method)""")
def _(t):
    return sinks.metric_lines(evaluation.method_metrics(t.view("v_prediction")))


@query("case_report_lines", "A7", """SELECT case_id, '| `' || case_id || '` | `' || ground_truth || '` | `' || case_type || '` | `' || pred_a || '` | `' || pred_b || '` | `' || pred_c || '` | `' || pred_d || '` (' || printf('%.1f', score_d) || ') | ' || CASE WHEN pred_d = ground_truth THEN '✓' ELSE '~' END || ' ' || pred_d || ' |' AS line FROM v_eval""")
def _(t):
    final = t.view("v_eval").select("case_id", F.col("score_d").alias("final_score"), F.col("pred_d").alias("status_tier"))
    return sinks.case_lines(evaluation.case_comparison(t.view("v_prediction"), METHODS, final), METHODS, "full_system")
