"""Vector expressions for single rows. Joins of vectors use
:mod:`vitrine.operators.similarity`, which multiplies blocks instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ladders import let


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """F1. Cosine similarity in [0, 1]; the longer vector is cut, a zero vector gives 0."""
    n = F.least(F.size(a), F.size(b))
    wide = lambda v: F.transform(F.slice(v, F.lit(1), n), lambda x: x.cast("double"))

    def value(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        parts = F.struct(_dot(x, y).alias("xy"), F.sqrt(_dot(x, x)).alias("nx"), F.sqrt(_dot(y, y)).alias("ny"))
        return let(
            parts,
            lambda p: F.when((p["nx"] == 0.0) | (p["ny"] == 0.0), 0.0).otherwise(
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["xy"] / (p["nx"] * p["ny"])))
            ),
        )

    return let(F.struct(wide(a).alias("x"), wide(b).alias("y")), value)


def l2_normalise(v: Column) -> Column:
    """F2. Unit vector; a zero vector stays as it is."""
    wide = F.transform(v, lambda x: x.cast("double"))
    return let(
        wide,
        lambda w: let(F.sqrt(_dot(w, w)), lambda n: F.transform(w, lambda x: F.when(n > 0.0, x / n).otherwise(x))),
    )


def colour_histograms(pixels: DataFrame) -> DataFrame:
    """F3. 8x8x8 colour histogram per asset as a unit vector, from (asset_id, r, g, b).

    Pixels are counted per (asset, bin) on the map side; a group then holds at most
    512 rows, so the final array is built from a bounded set.
    """
    level = lambda c: F.least(F.lit(7), F.floor(F.col(c) / F.lit(255.0) * F.lit(8.0)).cast("int"))
    counts = (
        pixels.withColumn("bin", level("r") * 64 + level("g") * 8 + level("b"))
        .groupBy("asset_id", "bin")
        .agg(F.count("*").cast("double").alias("n"))
    )
    rolled = counts.groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"),
        F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"),
    )
    # runs of zeros between the occupied bins, then the zeros after the last one
    before = F.concat(F.array(F.lit(-1)), F.transform(F.slice("bins", 1, F.size("bins") - 1), lambda b: b["bin"]))
    runs = F.zip_with(
        "bins", before,
        lambda b, p: F.concat(F.array_repeat(F.lit(0.0), b["bin"] - p - 1), F.array(b["n"] / (F.col("norm") + F.lit(1e-9)))),
    )
    tail = F.array_repeat(F.lit(0.0), F.lit(511) - F.element_at("bins", -1)["bin"])
    return rolled.select("asset_id", F.concat(F.flatten(runs), tail).alias("embedding"))
