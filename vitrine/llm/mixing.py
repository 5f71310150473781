"""Mixing sources to target weights along a curriculum (DataFrame functions only).

Each source has a weight and a schedule of that weight over training time. The integral of the schedule,
scaled to the source's target, is its cumulative demand for words; a document covers an interval of that
demand and starts where the inverse of the integral puts it. Sorting by that time gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import keep_columns, ready, staged, words

WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight at equally spaced times for each of the weights above: heavy sources fade in, light ones fade out.
SCHEDULES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))
SHARE, CAP = 1.5, 2.0
#: Buckets per source for the distributed running sum; more for sources of over about 10**9 documents.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source_size, weight, schedule, target.

    Sources go by code point, null last, and take the weights in turn. Targets are shares of ``share`` times
    all words by weight; none exceeds ``cap`` times its source's size and the excess goes to the others by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy(F.lit(1))  # the few rows of the source table
    nth = (F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    table = by_source.withColumn("nth", nth).select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), F.col("nth") + 1).alias("weight"),
        F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in schedules]), F.col("nth") + 1).alias("schedule"),
    )
    # the sources that reach their cap are those with the least cap per weight
    ranked = everyone.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everyone) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("rank", F.row_number().over(ranked)).withColumn("level", left / open_weight)
    free = F.when(F.col("level") * F.col("weight") < cap * F.col("source_size"), F.struct("rank", "level"))
    level = F.min(free).over(everyone)["level"]  # of the first source below its cap
    limit = cap * F.col("source_size")
    table = table.withColumn("level", level).select(
        "source", "source_size", "weight", "schedule",
        F.coalesce(F.least(F.col("level") * F.col("weight"), limit), limit).cast("double").alias("target"),
    )
    return table


def time_of(demand: Column, schedule: Column) -> Column:
    """Inverse of the normalised integral of a piecewise linear schedule at ``demand`` in [0, 1]."""
    n = F.size(schedule) - 1
    area = F.transform(  # trapezoids up to each knot
        F.sequence(F.lit(0), n),
        lambda i: F.aggregate(F.slice(schedule, 1, i + 1), F.lit(0.0), lambda a, x: a + x)
        - (F.element_at(schedule, F.lit(1)) + F.element_at(schedule, i + 1)) / 2.0,
    )
    wanted = demand * F.element_at(area, -1)
    segment = F.least(F.greatest(F.size(F.filter(area, lambda a: a <= wanted)), F.lit(1)), n)
    k0, k1 = F.element_at(schedule, segment), F.element_at(schedule, segment + 1)
    rest = wanted - F.element_at(area, segment)
    root = F.sqrt(F.greatest(k0 * k0 + 2.0 * (k1 - k0) * rest, F.lit(0.0)))
    inside = F.when(rest <= 0, 0.0).otherwise(2.0 * rest / (k0 + root))
    return F.least((segment - 1 + inside) / n, F.lit(1.0))


def mix_sources(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, cap: float = CAP, buckets: int = BUCKETS) -> DataFrame:
    """Input rows with size, source_size, target, taken, position and repeat_position, in training order.

    ``size`` counts the text's words (null: 0), ``taken`` the words that the mix uses, repeats counted; each
    source gives exactly its rounded target by going through its documents in an order fixed by the ids, as
    often as needed, and the document at the border is used in part. ``position`` and ``repeat_position`` are the
    times in [0, 1] at which the first and the second use begin (null: not used). Rows come range-sorted by
    position. Repeated rows are separate documents, null sources one source, empty texts take nothing, an
    empty table gives no rows; columns of the names above are
    replaced, others stay (names that begin with ``__v_`` are reserved). Texts are shuffled by source and
    bucket and by the final sort; a source of any share of the rows is summed in ``buckets`` parts. Texts of any length are
    counted whole.
    """
    made = ("size", "source_size", "target", "taken", "position", "repeat_position")
    ready(docs.sparkSession)
    docs = keep_columns(docs, made)
    sized = docs.withColumn("size", words(F.col("text")))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = sized.withColumn("__v_order", order).withColumn("__v_bucket", F.conv(F.substring("__v_order", 1, 4), 16, 10).cast("int") % buckets)
    spans = staged(sized.groupBy("source", "__v_bucket").agg(F.sum("size").alias("size")), "spans")
    targets = source_targets(spans, weights, schedules, share, cap)
    earlier = Window.partitionBy("source").orderBy("__v_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("source").alias("__v_source"), F.col("__v_bucket").alias("__v_part"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("__v_base"))
    spans = spans.join(
        targets.select(F.col("source").alias("__v_of"), "source_size", "target", F.col("schedule").alias("__v_schedule")), F.col("__v_source").eqNullSafe(F.col("__v_of"))
    ).drop("__v_of")
    within = Window.partitionBy("source", "__v_bucket").orderBy("__v_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__v_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        spans, F.col("source").eqNullSafe(F.col("__v_source")) & (F.col("__v_bucket") == F.col("__v_part"))
    )
    size, whole = F.col("size"), F.col("source_size")
    goal = F.round("target").cast("long")
    start = F.col("__v_base") + F.col("__v_before")
    times = F.when(whole > 0, F.floor(goal / whole)).otherwise(0).cast("long")
    rest = goal - times * whole
    partial = F.greatest(F.least(rest - start, size), F.lit(0))
    placed = placed.withColumn("taken", times * size + partial)
    share_at = lambda use: F.when(F.col("taken") > use * size, time_of((start + use * whole) / goal.cast("double"), F.col("__v_schedule")))
    placed = placed.withColumn("position", share_at(0)).withColumn("repeat_position", share_at(1))
    return placed.orderBy(F.col("position").asc_nulls_last(), "source", "__v_order", "doc_id").select(*docs.columns, *made)
