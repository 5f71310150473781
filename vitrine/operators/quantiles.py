"""Exact per-group percentiles that survive a group holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Size of a sketch, and how far from a wanted rank its quantile may lie (three times its usual error), as a share of n.
SKETCH = 4096


def _margin(size: int) -> float:
    return 3.0 * 2.3 / size**0.9


def group_percentile(df: DataFrame, group: str, value: str, q: float, sketch: int = SKETCH) -> DataFrame:
    """(group, n, percentile) with linear interpolation, exact.

    A quantile sketch of each group, merged from those of the map tasks, brackets the wanted ranks; one counted pass
    takes the number of values below the bracket and the distinct values inside it, a fixed small share of the group, and
    these decide. Should a bracket miss its ranks, which a sketch does with a chance of some 1e-9, Spark's ``percentile``
    answers for that group. Null values do not count; a group without values gives no row.
    """
    rows = df.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    decided = _bracketed(rows, group, q, sketch)
    missed = rows.join(decided.filter("NOT hit").select(group), group, "left_semi")
    exact = missed.groupBy(group).agg(F.count("*").alias("n"), F.percentile("v", q).alias("percentile"))
    return decided.filter("hit").select(group, "n", "percentile").unionByName(exact)


def _bracketed(rows: DataFrame, group: str, q: float, sketch: int) -> DataFrame:
    """(group, n, percentile, hit): the percentile, where the bracket of the group's sketch holds its ranks."""
    n = F.col("n")
    pos = F.lit(q) * (n - 1)
    margin = _margin(sketch)
    quantile = lambda rank: F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, rank))))
    edge = lambda rank, end: F.when(n * F.lit(margin) < 2, quantile(end)).otherwise(quantile(rank))  # one rank is more than the margin of a few rows
    sketched = F.when(F.isnan("v"), F.lit(float("inf"))).otherwise(F.col("v"))  # sketches leave NaN, the largest value, out
    edges = rows.groupBy(group).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(sketched, F.lit(sketch)).alias("s")).select(
        group, "n", edge(q - margin, 0.0).alias("low"), edge(q + margin, 1.0).alias("high"),
    ).withColumn("high", F.when(F.col("high") == float("inf"), F.lit(float("nan"))).otherwise(F.col("high")))
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))  # null: below the bracket
    counted = rows.join(edges, group).filter(F.col("v") <= F.col("high")).groupBy(group, "n", inside.alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy(F.col("v").asc_nulls_first()))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    ranked = counted.withColumn("upto", upto).groupBy(group, "n").agg(
        at(F.floor(pos)).alias("a"), at(F.ceil(pos)).alias("b"), F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"),
    )
    mixed: Column = (F.ceil(pos) - pos) * F.col("a") + (pos - F.floor(pos)) * F.col("b")
    return ranked.select(
        group, "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(mixed).alias("percentile"),
        (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("below") <= F.floor(pos))).alias("hit"),
    )
