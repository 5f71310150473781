"""Baselines, classification metrics and coverage on labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ladders import ladder
from ..functions.rounding import round_columns
from .similarity import best_matches, catalogue_matches, with_vectors

LABELS = ["LOW", "MEDIUM", "HIGH"]

# The eleven case archetypes.
ARCHETYPES = [
    "legitimate_merchant", "ambiguous_insufficient_evidence", "supplier_catalog_reuse", "stock_image_reuse",
    "cross_merchant_reuse", "suspicious_external_match", "fake_distorted_logo", "manipulated_document",
    "manipulated_product_image", "mixed_legitimate_suspicious", "no_external_evidence",
]


def tier_of(similarity: Column) -> Column:
    """Threshold classifier of the similarity baselines."""
    return ladder([(similarity >= 0.85, "HIGH"), (similarity >= 0.70, "MEDIUM")], "LOW")


def hash_vector(dhash: Column) -> Column:
    """A 64-bit hash as a vector of 64 signs and one 8.0: the cosine of two of them is ``1 - distance / 64``."""
    sign = lambda i: (F.call_function("shiftright", dhash, i).bitwiseAND(F.lit(1).cast("long")) * 2 - 1).cast("float")
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(63)), sign), F.array(F.lit(8.0).cast("float")))


def nearest_hashes(images: DataFrame, references: DataFrame, leaf: int | None = None) -> DataFrame:
    """Highest hash similarity of each distinct image hash to any reference hash, exact.

    Distinct hashes meet as vectors, so an image meets only the references that may beat those near it.
    """
    side = lambda df, name: with_vectors(
        df.filter(F.col("dhash").isNotNull()).select("dhash").distinct().select(F.col("dhash").cast("string").alias(name), F.lit("").alias("owner"), F.lit("").alias("domain"), hash_vector(F.col("dhash")).alias("embedding"))
    )
    found = best_matches(side(images, "row_id"), side(references, "member"), 1, None, False, leaf)
    distance = F.round((F.lit(1.0) - F.col("raw_similarity")) * 64)
    return found.select(F.col("row_id").cast("long").alias("dhash"), (F.lit(1.0) - distance / F.lit(64.0)).alias("hash_similarity"))


def baseline_predictions(cases: DataFrame, images: DataFrame, references: DataFrame) -> DataFrame:
    """J1. Three baselines per case: best hash, best cosine, and the better of both.

    ``images``: case_id, asset_id, dhash, embedding; ``references``: filename, dhash,
    embedding. Cases without images score 0.
    """
    hashes = nearest_hashes(images, references)
    cosines = catalogue_matches(images.select("asset_id", "embedding"), references.select("filename", "embedding"), 1)
    best = (
        images.select("case_id", "asset_id", "dhash")
        .join(hashes, "dhash", "left")
        .join(cosines.select("asset_id", "similarity"), "asset_id", "left")
        .groupBy("case_id")
        .agg(F.max("hash_similarity").alias("dhash_sim"), F.max("similarity").alias("cosine_sim"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = cases.select("case_id").join(best, "case_id", "left").withColumns({"dhash_sim": zero("dhash_sim"), "cosine_sim": zero("cosine_sim")})
    df = df.withColumn("both_sim", F.greatest("dhash_sim", "cosine_sim"))
    names = {"dhash": "dhash_sim", "cosine": "cosine_sim", "cosine_dhash": "both_sim"}
    df = df.withColumns({f"{m}_pred": tier_of(F.col(c)) for m, c in names.items()})
    df = df.withColumns({f"{m}_score": F.col(c) * F.lit(100.0) for m, c in names.items()})
    return round_columns(df, {f"{m}_score": 1 for m in names})


def _pairs_count(actual: str, predicted: str) -> Column:
    return F.count_if((F.col("ground_truth") == actual) & (F.col("pred") == predicted))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """J2. 3x3 matrix per method in fixed order, zeros included (method, actual, predicted, n).

    One aggregate row per method; the nine cells are columns that are then exploded.
    """
    cells = [(a, p) for a in LABELS for p in LABELS]
    wide = predictions.groupBy("method").agg(*[_pairs_count(a, p).alias(f"{a}_{p}") for a, p in cells])
    rows = F.array(
        *[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"{a}_{p}").alias("n")) for a, p in cells]
    )
    return wide.select("method", F.explode(rows).alias("c")).select("method", "c.*")


def _class_counts(predictions: DataFrame) -> DataFrame:
    aggs = [F.count("*").alias("total")]
    for c in LABELS:
        aggs += [
            _pairs_count(c, c).alias(f"tp_{c}"),
            F.count_if(F.col("pred") == c).alias(f"pred_{c}"),
            F.count_if(F.col("ground_truth") == c).alias(f"true_{c}"),
        ]
    aggs += [
        F.count_if((F.col("ground_truth") == "LOW") & F.col("pred").isin("MEDIUM", "HIGH")).alias("clean_fp"),
        F.count_if((F.col("ground_truth") == "HIGH") & (F.col("pred") == "LOW")).alias("suspicious_fn"),
    ]
    return predictions.groupBy("method").agg(*aggs)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(predictions: DataFrame) -> DataFrame:
    """J3. Precision, recall, F1 and support per method and class; 0 where undefined."""
    counts = _class_counts(predictions)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                _ratio(F.col(f"tp_{c}"), F.col(f"pred_{c}")).alias("precision"),
                _ratio(F.col(f"tp_{c}"), F.col(f"true_{c}")).alias("recall"),
                _ratio(F.lit(2.0) * F.col(f"tp_{c}"), F.col(f"pred_{c}") + F.col(f"true_{c}")).alias("f1"),
                F.col(f"true_{c}").alias("support"),
            )
            for c in LABELS
        ]
    )
    return counts.select("method", F.explode(rows).alias("m")).select("method", "m.*")


def method_metrics(predictions: DataFrame) -> DataFrame:
    """J4, J5. Accuracy, macro and weighted scores, clean FPR and suspicious FNR per method."""
    df = _class_counts(predictions)
    n = F.col("total")
    p = {c: _ratio(F.col(f"tp_{c}"), F.col(f"pred_{c}")) for c in LABELS}
    r = {c: _ratio(F.col(f"tp_{c}"), F.col(f"true_{c}")) for c in LABELS}
    f = {c: _ratio(F.lit(2.0) * F.col(f"tp_{c}"), F.col(f"pred_{c}") + F.col(f"true_{c}")) for c in LABELS}
    macro = lambda m: sum((m[c] for c in LABELS), F.lit(0.0)) / F.lit(3.0)
    weighted = lambda m: sum((m[c] * F.col(f"true_{c}") for c in LABELS), F.lit(0.0)) / n
    correct = sum((F.col(f"tp_{c}") for c in LABELS), F.lit(0))
    fpr, fnr = _ratio(F.col("clean_fp"), F.col("true_LOW")), _ratio(F.col("suspicious_fn"), F.col("true_HIGH"))
    out = df.select(
        "method",
        n.alias("total_cases"),
        correct.alias("correct_cases"),
        (correct / n).alias("accuracy"),
        (correct / n * F.lit(100.0)).alias("accuracy_pct"),
        macro(p).alias("precision_macro"),
        macro(r).alias("recall_macro"),
        macro(f).alias("f1_macro"),
        weighted(p).alias("precision_weighted"),
        weighted(r).alias("recall_weighted"),
        weighted(f).alias("f1_weighted"),
        fpr.alias("false_positive_rate"),
        (fpr * F.lit(100.0)).alias("false_positive_rate_pct"),
        F.col("clean_fp").alias("clean_fp_count"),
        F.col("true_LOW").alias("clean_total"),
        fnr.alias("false_negative_rate"),
        (fnr * F.lit(100.0)).alias("false_negative_rate_pct"),
        F.col("suspicious_fn").alias("suspicious_fn_count"),
        F.col("true_HIGH").alias("suspicious_total"),
    )
    four = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted",
            "false_positive_rate", "false_negative_rate"]
    two = ["accuracy_pct", "false_positive_rate_pct", "false_negative_rate_pct"]
    return round_columns(out, {**{c: 4 for c in four}, **{c: 2 for c in two}})


def method_comparison(predictions: DataFrame) -> DataFrame:
    """J6. Correct and total cases per method and case type with sub-totals (ROLLUP)."""
    hit = F.col("pred") == F.col("ground_truth")
    out = predictions.rollup("method", "case_type").agg(
        F.count("*").alias("cases"), F.count_if(hit).alias("correct"), F.grouping_id().alias("level")
    )
    out = out.withColumn("accuracy", F.col("correct") / F.col("cases"))
    return round_columns(out, {"accuracy": 4})


def case_coverage(cases: DataFrame) -> DataFrame:
    """J7. Number of cases per archetype, zeros kept."""
    spark = cases.sparkSession
    archetypes = spark.createDataFrame([(i, a) for i, a in enumerate(ARCHETYPES)], "ord int, case_type string")
    counts = cases.groupBy("case_type").agg(F.count("*").alias("n"))
    return archetypes.join(counts, "case_type", "left").select("ord", "case_type", F.coalesce("n", F.lit(0)).alias("cases"))


def case_comparison(predictions: DataFrame, methods: list[str], final: DataFrame | None = None) -> DataFrame:
    """J8. One row per case: each method's prediction with a correctness flag, and the
    sub-scores of the final system where given (case_id, ...)."""
    wide = predictions.groupBy("case_id", "ground_truth", "case_type").pivot("method", methods).agg(F.max("pred"))
    wide = wide.withColumns({f"{m}_correct": F.coalesce(F.col(m) == F.col("ground_truth"), F.lit(False)) for m in methods})
    return wide if final is None else wide.join(final, "case_id", "left")


def latency_summary(latencies: DataFrame, by: str) -> DataFrame:
    """J9. Count, mean, median, 95th percentile and maximum of ``latency_ms``."""
    from .quantiles import group_percentile

    base = latencies.groupBy(by).agg(
        F.count("latency_ms").alias("n"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms")
    )
    for q, name in ((0.5, "p50_ms"), (0.95, "p95_ms")):
        base = base.join(group_percentile(latencies, by, "latency_ms", q).select(by, F.col("percentile").alias(name)), by)
    return base
