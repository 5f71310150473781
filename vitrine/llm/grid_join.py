"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are sorted by their grid cells (width: the distance that the wanted cosine stands for) on leading
principal dimensions. Intervals of that order are joined recursively; two intervals whose bounding boxes are farther
apart than the distance are skipped, which loses nothing since projections never lengthen distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .near_duplicates import _groups
from .staging import ready, staged

LEADING = 12
#: Vectors that the principal directions are fitted on at most; they steer the work, not the result.
FIT_ROWS = 4096
#: Distinct vectors of one block, and about the blocks of one sorted range; both hold for tables of any size.
BLOCK, RANGE_BLOCKS = 4096, 8
LEAF = 128


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length one; rows whose squares leave the range of a double are scaled first."""
    values = values.astype(np.float64)
    with np.errstate(over="ignore"):
        squares = (values * values).sum(1, keepdims=True)
    far = ~(np.isfinite(squares) & (squares > 1e-280))
    if far.any():
        values = np.where(far, values / np.abs(values).max(1, keepdims=True), values)
        squares = (values * values).sum(1, keepdims=True)
    return values / np.sqrt(squares)


def principal_axes(units: np.ndarray, n: int = LEADING) -> np.ndarray:
    """The leading principal directions (columns)."""
    vectors = np.linalg.eigh(np.atleast_2d(np.cov(units, rowvar=False)) if len(units) > 1 else np.eye(units.shape[1]))[1]
    return np.ascontiguousarray(vectors[:, ::-1][:, :n])


def _box_gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Squared distance between boxes."""
    return (np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum(-1)


class _Join:
    """Recursive join of two intervals of grid-ordered vectors of one dimension."""

    def __init__(self, units: np.ndarray, lead: np.ndarray, cosine: float):
        self.units, self.lead, self.cosine = units, lead, cosine
        self.limit = (2.0 - 2.0 * cosine) * (1 + 1e-9) + 1e-12
        self.x: list[np.ndarray] = []
        self.y: list[np.ndarray] = []
        self.leaves = self.skipped = 0
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            self.boxes[lo, hi] = self.lead[lo:hi].min(0), self.lead[lo:hi].max(0)
        return self.boxes[lo, hi]

    def run(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        if a[0] >= a[1] or b[0] >= b[1]:
            return
        if a != b and _box_gap(*self.box(*a), *self.box(*b)) > self.limit:
            self.skipped += 1
            return
        if a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF:
            self.leaf(a, b)
        elif a == b:
            m = (a[0] + a[1]) // 2
            self.run((a[0], m), (a[0], m))
            self.run((a[0], m), (m, a[1]))
            self.run((m, a[1]), (m, a[1]))
        elif a[1] - a[0] >= b[1] - b[0]:
            m = (a[0] + a[1]) // 2
            self.run((a[0], m), b)
            self.run((m, a[1]), b)
        else:
            m = (b[0] + b[1]) // 2
            self.run(a, (b[0], m))
            self.run(a, (m, b[1]))

    def leaf(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        self.leaves += 1
        x, y = np.nonzero(self.units[a[0] : a[1]] @ self.units[b[0] : b[1]].T >= self.cosine)
        x, y = x + a[0], y + b[0]
        if a == b:
            x, y = x[y > x], y[y > x]
        self.x.append(x)
        self.y.append(y)


def spanning_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows over the links (x, y)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _blocks(ordered: DataFrame) -> tuple[DataFrame, int]:
    """The rows in grid order with the ``block`` of each, and the bits of a block number.

    Block k holds the rows k * BLOCK and after of the whole order, however that order is dealt over sorted ranges.
    """
    total = ordered.count()
    ranges = max(1, math.ceil(total / (BLOCK * RANGE_BLOCKS)))
    row = F.monotonically_increasing_id()  # the range in the bits from 33 on, the row in it below
    in_order = ordered.repartitionByRange(ranges, "dim", "cell", "rep").sortWithinPartitions("dim", "cell", "rep").withColumn("row", row)
    pieces = staged(in_order.withColumns({"range": F.shiftright("row", 33), "row": F.col("row").bitwiseAND((1 << 33) - 1)}), "intervals")
    sizes = pieces.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = pieces.join(starts, "range").withColumn("block", F.floor((F.col("start") + F.col("row")) / BLOCK))
    return numbered.drop("range", "row", "start"), (max(0, total - 1) // BLOCK).bit_length()


def near_blocks(pieces: DataFrame, bits: int, cosine: float) -> DataFrame:
    """(i, j), i <= j: the blocks of ``pieces`` whose bounding boxes leave room for a link.

    Halves intervals of block numbers from the whole sequence down, one round for each bit, and drops two intervals with
    all that is in them once their boxes are too far apart. Boxes and pairs are tables; none comes to the driver.
    """
    spark = pieces.sparkSession
    lead = [(F.min, F.col("lead")[i], f"l{i}") for i in range(LEADING)] + [(F.max, F.col("lead")[i], f"h{i}") for i in range(LEADING)]
    boxed = pieces.groupBy("block").agg(F.min("dim").alias("short"), F.max("dim").alias("long"), *[f(c).alias(n) for f, c, n in lead])
    levels = boxed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("node", F.expr("shiftright(block, level)"))
    box = [F.min("short").alias("short"), F.max("long").alias("long"), *[f(n).alias(n) for f, _, n in lead]]
    tree = staged(levels.groupBy("level", "node").agg(*box), "boxes")
    limit = (2.0 - 2.0 * cosine) * (1 + 1e-9) + 1e-12
    apart = [F.greatest(F.lit(0.0), F.col(f"a.l{i}") - F.col(f"b.h{i}"), F.col(f"b.l{i}") - F.col(f"a.h{i}")) for i in range(LEADING)]
    gap = sum((d * d for d in apart[1:]), apart[0] * apart[0])
    room = (F.col("i") == F.col("j")) | ((gap <= limit) & (F.col("a.short") <= F.col("b.long")) & (F.col("b.short") <= F.col("a.long")))
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    pairs = spark.createDataFrame([(0, 0)], "i long, j long")
    for level in range(bits - 1, -1, -1):
        at = tree.where(F.col("level") == level).drop("level")
        split = pairs.withColumn("p", half).withColumn("q", half).select((F.col("i") * 2 + F.col("p")).alias("i"), (F.col("j") * 2 + F.col("q")).alias("j"))
        met = split.where("i <= j").alias("s").join(at.alias("a"), F.col("i") == F.col("a.node")).join(at.alias("b"), F.col("j") == F.col("b.node"))
        pairs = staged(met.where(room).select("i", "j"), "pairs")
    return pairs


def similar_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (``vec_id``, ``embedding``).

    Links vectors whose cosine in double precision is at least ``cosine``; every row with an equal vector counts as a
    linked vector of its own. Vectors that are null, empty, all zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with each other. Repeated rows each get a row, an empty table gives
    none, other columns are not read.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    usable = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    keyed = staged(rows.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding")).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")}), "vectors")
    valid = keyed.where("embedding is not null")
    copies = staged(valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "copies")
    distinct = valid.join(copies, ["k1", "k2"]).where("vec_id = rep").dropDuplicates(["k1", "k2"]).select("rep", "n", "embedding")

    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("embedding").collect()
    by_length: dict[int, list] = {}
    for (values,) in sample:
        by_length.setdefault(len(values), []).append(values)
    axes = {d: principal_axes(unit_rows(np.array(v))) for d, v in by_length.items()}
    width = math.sqrt(max(2.0 - 2.0 * cosine, 1e-12))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _vectors(batch.column(2))
            lengths = np.diff(at)
            cells, leads = [b""] * batch.num_rows, [None] * batch.num_rows
            for d in np.unique(lengths).tolist():
                pick = np.flatnonzero(lengths == d)
                lead = unit_rows(values[at[pick][:, None] + np.arange(d)]) @ axes.get(d, np.eye(d)[:, :LEADING])
                lead = np.pad(lead, ((0, 0), (0, LEADING - lead.shape[1])))
                grid = (np.clip(np.floor(lead / width), -2e9, 2e9) + 2**31).astype(">u4")
                for r, c, v in zip(pick.tolist(), grid, lead):
                    cells[r], leads[r] = c.tobytes(), v
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths.astype(np.int32)), pa.array(cells, pa.binary()), pa.array(leads, pa.list_(pa.float64())), batch.column(2)],
                names=["rep", "n", "dim", "cell", "lead", "embedding"],
            )

    ordered = staged(distinct.mapInArrow(place, "rep long, n long, dim int, cell binary, lead array<double>, embedding array<double>"), "cells")
    pieces, bits = _blocks(ordered)
    meets = near_blocks(pieces, bits, cosine)
    sides = meets.select(F.col("i").alias("block"), "i", "j", F.lit(0).alias("side")).union(
        meets.where("i <> j").select(F.col("j"), "i", "j", F.lit(1))
    )
    met = pieces.join(sides, "block")
    met = met.select("i", "j", "side", "dim", "cell", "rep", "n", "lead", "embedding").repartition("i", "j").sortWithinPartitions("i", "j", "dim", "side", "cell", "rep")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["i", "j", "dim"]):
            keys = np.column_stack([table.column(c).to_numpy() for c in ("i", "j", "dim")])
            starts = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])), len(keys))
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                part = table.slice(lo, hi - lo)
                d = int(keys[lo, 2])
                units = unit_rows(part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                lead = part.column("lead").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, LEADING)
                rep, n, side = (part.column(c).to_numpy() for c in ("rep", "n", "side"))
                work = _Join(units, lead, cosine)
                first = int((side == 0).sum())
                if keys[lo, 0] == keys[lo, 1]:
                    work.run((0, first), (0, first))
                else:
                    work.run((0, first), (first, len(rep)))
                if not work.x:
                    continue
                x, y = np.concatenate(work.x), np.concatenate(work.y)
                if not len(x):
                    continue
                links = np.bincount(x, n[y], len(rep)) + np.bincount(y, n[x], len(rep))
                label = spanning_labels(len(rep), x, y)
                linked = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(links[linked].astype(np.int64)), pa.array(rep[label[linked]])], names=["rep", "links", "other"])

    found = staged(met.mapInArrow(join, "rep long, links long, other long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("rep <> other").select("rep", "other").distinct(), "rep", "other").withColumnRenamed("id", "rep")
    named_reps = copies.join(counts, "rep", "left").join(components, "rep", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    known = keyed.where("embedding is not null").select("vec_id", "k1", "k2").join(named_reps, ["k1", "k2"])
    alone = keyed.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
