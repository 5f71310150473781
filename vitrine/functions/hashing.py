"""Perceptual-hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def difference_hash(grid: Column, brighter_left: bool = True) -> Column:
    """E7. 64-bit difference hash of an 8x9 luminance grid in row order, first bit highest.

    ``brighter_left`` compares left > right (crawl form); otherwise right > left
    (evaluation form). Hashes of the two forms must not be compared.
    """
    left = lambda i: F.get(grid, F.floor(i / F.lit(8)).cast("int") * F.lit(9) + i % F.lit(8))
    right = lambda i: F.get(grid, F.floor(i / F.lit(8)).cast("int") * F.lit(9) + i % F.lit(8) + F.lit(1))
    bit = lambda i: (left(i) > right(i)) if brighter_left else (right(i) > left(i))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.when(bit(i), F.lit(1)).otherwise(F.lit(0)).cast("long")),
    )


def hamming(a: Column, b: Column) -> Column:
    """E8. Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    """E8. ``1 - distance / 64``."""
    return F.lit(1.0) - hamming(a, b) / F.lit(64.0)
