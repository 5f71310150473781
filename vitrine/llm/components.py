"""Connected components of a link table, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; the component is the smallest id reachable.

    Each round gives an id the smallest label among its neighbours and then that label's own label, so the number
    of rounds grows with the logarithm of the longest path. Every round is staged in the shared folder. Hot ids are
    partly aggregated before the shuffle; an empty table gives no rows.
    """
    pairs = links.select(F.col(a).alias("id"), F.col(b).alias("other")).where("id <> other")
    both = staged(pairs.union(pairs.select(F.col("other"), F.col("id"))).distinct(), "links")
    labels = staged(both.groupBy("id").agg(F.min("other").alias("low")).select("id", F.least("id", "low").alias("component")), "labels")
    while True:
        offered = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("offer")), "other").groupBy("id").agg(F.min("offer").alias("offer"))
        lower = labels.join(offered, "id").select("id", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        lower = staged(lower.join(jump, "component").select("id", "was", F.least("component", "root").alias("component")), "labels")
        changed = lower.where("component <> was").limit(1).count()
        labels = lower.select("id", "component")
        if not changed:
            return labels
