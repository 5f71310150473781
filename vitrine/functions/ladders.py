"""Small helpers for ordered CASE ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def ladder(branches: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First branch whose condition holds; conditions that are NULL do not match."""
    cond, value = branches[0]
    out = F.when(cond, _col(value))
    for cond, value in branches[1:]:
        out = out.when(cond, _col(value))
    return out.otherwise(_col(default))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(*parts: object) -> Column:
    """Concatenate literals and columns; the result is NULL only if a column is."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def count_true(*conditions: Column) -> Column:
    """How many conditions hold (NULL counts as not holding)."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.when(c, 1).otherwise(0)
    return total


def score_text(x: Column) -> Column:
    """A one-decimal score as printed in explanations ('12.0', '7.5')."""
    return x.cast("string")
