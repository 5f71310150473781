"""A bisected tree over vectors, and the leaf pairs of two trees that can hold similar vectors.

Vectors become points of a few coordinates: their leading principal axes and the norms of the remaining axes in chunks.
The map brings no two vectors further apart (Cauchy-Schwarz on the chunks), so gaps between the points of two nodes bound
the similarity of their vectors. Nodes are cut on their widest axis, at the widest gap of the middle half, four times a round,
until none has more than a leaf's rows; cuts come from a sample of a node, so every node of a round is cut at once and no node is ever
collected. Two trees are walked down together: a pair of nodes survives if neither the angle between their centres nor
the gap between their boxes rules it out. Rows are multiplied only where leaf pairs survive. Neighbouring leaves travel
together in blocks of bounded size, so a row is sent to each block that it meets, not to each leaf.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

#: Rows of a leaf at most; halvings of a round; rows that choose the cuts of a node (about).
LEAF, HALVINGS, SAMPLE = 4096, 4, 4096
FAN = 1 << HALVINGS
#: Values of the vectors of a block (about), and blocks of a table at least, where leaves are small enough.
BLOCK_VALUES, BLOCKS = 1 << 23, 8
#: Leading axes kept as coordinates, chunks of the others, and vectors per space that choose the axes.
AXES, CHUNKS, PILOT = 16, 4, 2048
#: Angles and similarities are widened by this much, far more than rounding can do.
SLACK = 1e-6

_NODE = "level int, space string, node long, n long, centre array<double>, spread double, low array<double>, high array<double>"
_KINDS = {"level": pa.int32(), "space": pa.string(), "node": pa.int64(), "n": pa.int64(), "spread": pa.float64()}


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(arr), -1) if len(arr) else np.zeros((0, 1))


def padded(column) -> np.ndarray:
    """A list column of any lengths as a matrix, filled up with zeros."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(arr.offsets.to_numpy())
    out = np.zeros((len(sizes), max(sizes.max(initial=0), 1)))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = arr.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def points(m: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates of vectors: leading axes and chunk norms of the rest; never further apart than the unit vectors."""
    turned = unit(m) @ axes
    rest = np.array_split(turned[:, AXES:], CHUNKS, axis=1)
    head = turned[:, :AXES]
    if head.shape[1] < AXES:
        head = np.pad(head, ((0, 0), (0, AXES - head.shape[1])))
    return np.hstack([head, *[np.linalg.norm(r, axis=1, keepdims=True) for r in rest]])


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Rotation for each vector length, widest axis first, from PILOT vectors of it at most; results do not depend on it."""
    rank = Window.partitionBy("size").orderBy(F.xxhash64("row_id"), "row_id")
    few = rows.select(F.size("embedding").alias("size"), "row_id", "embedding").withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= PILOT)
    by: dict[int, list] = {}
    for r in few.select("size", "embedding").collect():
        by.setdefault(r[0], []).append(r[1])
    out = {}
    for size, vectors in by.items():
        u = unit(np.array(vectors, dtype=np.float64))
        _, axes = np.linalg.eigh(np.cov(u.T).reshape(size, size) if len(u) > 1 else np.eye(size))
        out[size] = axes[:, ::-1]
    return out


def _pointed(rows: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = batch["embedding"]
                sizes = np.diff(vectors.offsets.to_numpy())
                out = np.zeros((len(sizes), AXES + CHUNKS))
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    out[at] = points(matrix(vectors.take(pa.array(at))), axes[int(size)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, AXES + CHUNKS, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch["space"], batch["row_id"], lists], ["space", "row_id", "point"])

    return rows.select("space", "row_id", "embedding").mapInArrow(run, "space string, row_id string, point array<double>")


def _cuts(table: pa.Table, leaf: int) -> pa.Table:
    """Halvings of one node in heap order: axis and value, axis -1 where nothing tells the points apart, -2 in a small enough node."""
    x = matrix(table["point"])
    axis, at = [-2] * (FAN - 1), [0.0] * (FAN - 1)
    members = {0: np.arange(len(x))}
    share = len(x) / table["n"][0].as_py()  # of the node's rows in the sample
    for k in range(FAN - 1):
        own = members.pop(k, np.zeros(0, np.int64))
        if len(own) > 1 and len(own) > leaf * share:
            part = x[own]
            wide = part.std(axis=0)
            j = int(wide.argmax())
            if part[:, j].max() > part[:, j].min():
                values = np.sort(part[:, j])
                # the widest gap of the middle half, so that clusters stay whole
                low, high = len(values) // 4, max(len(values) // 4 + 1, 3 * len(values) // 4)
                gaps = np.diff(values[low : high + 1])
                cut = float(values[low + int(gaps.argmax())] if gaps.max() > 0 else values[values < values[-1]][-1])
                values = part[:, j]
                axis[k], at[k] = j, cut
                members[2 * k + 1], members[2 * k + 2] = own[values <= cut], own[values > cut]
            else:
                axis[k] = -1
                members[2 * k + 1], members[2 * k + 2] = own[::2], own[1::2]
    cuts = [{"axis": a, "at": v} for a, v in zip(axis, at)]
    kind = pa.list_(pa.struct([("axis", pa.int32()), ("at", pa.float64())]))
    return pa.table({"space": table["space"].slice(0, 1), "node": table["node"].slice(0, 1), "cuts": pa.array([cuts], kind)})


def _descended(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Every row in its child node after four halvings; nodes without cuts keep their rows together."""
    at = F.lit(0)
    for level in range(HALVINGS):
        cut = F.element_at("cuts", at + 1)
        bit = F.when(cut["axis"] == -2, 0).when(cut["axis"] < 0, F.pmod(F.shiftright(F.xxhash64("row_id", "node"), level), F.lit(2))).otherwise((F.get("point", cut["axis"]) > cut["at"]).cast("int"))
        rows = (rows if level else rows.join(cuts, ["space", "node"], "left")).withColumn("_at", (2 * at + 1 + bit).cast("int"))
        at = F.col("_at")
    child = F.when(F.col("cuts").isNull(), 0).otherwise(F.col("_at") - (FAN - 1))
    return rows.withColumn("node", F.col("node") * FAN + child).select("space", "row_id", "point", "node")


def _summary(table: pa.Table, level: int) -> pa.Table:
    u, x = unit(matrix(table["embedding"])), matrix(table["point"])
    centre = unit(u.mean(axis=0, keepdims=True))
    if not centre.any():
        centre = u[:1]
    spread = float(np.arccos(np.clip(u @ centre[0], -1.0, 1.0)).max())
    if not (u.any(axis=1)).all():
        spread = float(np.pi)
    return _node(level, table["space"][0].as_py(), table["node"][0].as_py(), len(u), centre[0], spread, x.min(axis=0), x.max(axis=0))


def _node(level, space, node, n, centre, spread, low, high) -> pa.Table:
    out = {"level": level, "space": space, "node": node, "n": n, "centre": centre.tolist(), "spread": spread, "low": low.tolist(), "high": high.tolist()}
    return pa.table({k: pa.array([v], _KINDS.get(k, pa.list_(pa.float64()))) for k, v in out.items()})


def _merged(table: pa.Table, level: int) -> pa.Table:
    """Summary of a node from those of its children."""
    c, n = matrix(table["centre"]), table["n"].to_numpy()
    centre = unit((c * n[:, None]).sum(axis=0, keepdims=True))
    if not centre.any():
        centre = c[:1]
    spread = min(float(np.pi), float((np.arccos(np.clip(c @ centre[0], -1.0, 1.0)) + table["spread"].to_numpy()).max()))
    return _node(level, table["space"][0].as_py(), table["parent"][0].as_py(), int(n.sum()), centre[0], spread, matrix(table["low"]).min(axis=0), matrix(table["high"]).max(axis=0))


def _at_level(make: Callable, level: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        return make(table, level)

    return run


@dataclass
class Tree:
    """``rows`` with their leaf (``node``) and its ``block``, and a summary of the nodes of every level, 0 (root) to
    ``depth`` (leaves); ``blocks``: space, node, block of the leaves."""

    rows: DataFrame
    depth: int
    nodes: DataFrame
    blocks: DataFrame


def is_small(rows: DataFrame, leaf: int) -> bool:
    """Whether every space of ``rows`` fits into one leaf."""
    return rows.groupBy("space").agg(F.count("*").alias("n")).filter(F.col("n") > leaf).isEmpty()


def _blocks(placed: DataFrame, width: int, leaf: int) -> DataFrame:
    """(space, node, block): leaves in the order of the tree, packed until a block is full."""
    leaves = placed.groupBy("space", "node").agg(F.count("*").alias("n")).checkpoint()
    total = leaves.agg(F.sum("n")).first()[0] or 0
    size = max(leaf, min(-(-total // BLOCKS), BLOCK_VALUES // width))
    before = F.sum("n").over(Window.partitionBy("space").orderBy("node")) - F.col("n")  # one short row per leaf
    return leaves.select("space", "node", "n", before.alias("before")).select("space", "node", F.floor(F.col("before") / size).alias("block")).checkpoint()


def grow(rows: DataFrame, axes: dict[int, np.ndarray], leaf: int = LEAF) -> Tree:
    """Tree over ``rows`` (space, row_id, embedding, any others); (space, row_id) names a row, vectors of a space have one length.

    Only points travel while the tree grows, each round written to the checkpoint folder.
    """
    placed = _pointed(rows, axes).withColumn("node", F.lit(0).cast("long")).checkpoint()
    depth = 0
    while True:
        heavy = placed.groupBy("space", "node").agg(F.count("*").alias("n")).filter(F.col("n") > leaf)
        share = F.pmod(F.xxhash64("row_id", F.lit(depth)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = placed.join(heavy, ["space", "node"]).filter(share * F.col("n") < SAMPLE)
        cuts = sample.select("space", "node", "n", "point").groupBy("space", "node").applyInArrow(_at_level(_cuts, leaf), "space string, node long, cuts array<struct<axis: int, at: double>>").checkpoint()
        if cuts.isEmpty():
            break
        placed, depth = _descended(placed, cuts).checkpoint(), depth + 1
    blocks = _blocks(placed, max(axes, default=1), leaf)
    full = rows.join(placed.join(blocks, ["space", "node"]), ["space", "row_id"]).checkpoint()
    level = full.select("space", "node", "embedding", "point").groupBy("space", "node").applyInArrow(_at_level(_summary, depth), _NODE)
    levels = [level := level.checkpoint()]
    for d in range(depth - 1, -1, -1):
        up = level.withColumn("parent", F.shiftright("node", HALVINGS))
        levels.append(level := up.groupBy("space", "parent").applyInArrow(_at_level(_merged, d), _NODE).checkpoint())
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return Tree(full.drop("point"), depth, nodes, blocks)


def bounds(q: pa.RecordBatch, g: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(largest similarity that two nodes can hold, similarity of their centres), row by row."""
    middle = np.clip((padded(q["centre"]) * padded(g["centre"])).sum(axis=1), -1.0, 1.0)
    angle = np.arccos(middle) - q["spread"].to_numpy() - g["spread"].to_numpy() - SLACK
    gap = np.maximum(0.0, np.maximum(matrix(q["low"]) - matrix(g["high"]), matrix(g["low"]) - matrix(q["high"])))
    return np.minimum(np.cos(np.clip(angle, 0.0, np.pi)), 1.0 - (gap**2).sum(axis=1) / 2.0 + SLACK), middle


def side(nodes: DataFrame, depth: int, level: int, name: str, columns: list) -> DataFrame:
    """Nodes of a level with the node of the level before that they belong to; leaves stand for themselves further down."""
    up = F.shiftright("node", HALVINGS) if 0 < level <= depth else F.col("node")
    return nodes.filter(F.col("level") == min(level, depth)).select("space", up.alias(f"up_{name}"), F.col("node").alias(name), *columns)


def leaf_pairs(q: Tree, g: Tree, floors: DataFrame | None = None, threshold: float | None = None, nearest: int | None = None, ordered: bool = False) -> DataFrame:
    """(space, a, b): leaves of ``q`` and ``g`` that may hold a pair of ``threshold`` and more.

    ``floors`` (level, space, node, floor) gives each query node its own threshold. ``nearest`` keeps, instead, so many
    nodes of ``g`` for each node of ``q`` on the way down, those with the nearest centres. ``ordered`` keeps a <= b, for
    a tree joined with itself.
    """
    asked = q.nodes if floors is None else q.nodes.join(floors, ["level", "space", "node"])
    if floors is None:
        asked = asked.withColumn("floor", F.lit(-2.0 if threshold is None else threshold))
    summary = F.struct("centre", "spread", "low", "high")

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (pa.RecordBatch.from_struct_array(batch[s]) for s in ("s_a", "s_b"))
                most, middle = bounds(left, right)
                keep = np.flatnonzero(most >= batch["floor"].to_numpy()) if nearest is None else np.arange(len(most))
                out = [batch[c].take(pa.array(keep)) for c in ("space", "a", "b")]
                yield pa.RecordBatch.from_arrays([*out, pa.array(middle[keep])], ["space", "a", "b", "middle"])

    pairs = None
    for level in range(max(q.depth, g.depth) + 1):
        a, b = side(asked, q.depth, level, "a", [summary.alias("s_a"), "floor"]), side(g.nodes, g.depth, level, "b", [summary.alias("s_b")])
        both = a.join(b, "space") if pairs is None else pairs.join(a.withColumnRenamed("up_a", "pa"), ["space", "pa"]).join(b.withColumnRenamed("up_b", "pb"), ["space", "pb"])
        if ordered:
            both = both.filter("a <= b")
        tested = both.select("space", "a", "b", "s_a", "s_b", "floor").mapInArrow(test, "space string, a long, b long, middle double")
        if nearest is not None:
            best = Window.partitionBy("space", "a").orderBy(F.col("middle").desc(), "b")
            tested = tested.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= nearest)
        pairs = tested.select("space", F.col("a").alias("pa"), F.col("b").alias("pb")).checkpoint()
    return pairs.select("space", F.col("pa").alias("a"), F.col("pb").alias("b"))


#: What a block function gets beside its rows: (query rows, index rows, whether a leaf meets itself in an ordered join).
Meetings = list[tuple[np.ndarray, np.ndarray, bool]]


def leaf_join(q: DataFrame, g: DataFrame, pairs: DataFrame | None, fn: Callable, schema: str, q_cols: list[str], g_cols: list[str]) -> DataFrame:
    """``fn(key, query rows, index rows, meetings)`` for every pair of leaves; without ``pairs``, for the one leaf of each space."""
    keys = ["space", "a", "b"]
    if pairs is None:
        zero = F.lit(0).cast("long")
        left, right = (df.select("space", zero.alias("a"), zero.alias("b"), *cols) for df, cols in ((q, q_cols), (g, g_cols)))
    else:
        left = pairs.withColumnRenamed("a", "node").join(q, ["space", "node"]).select("space", F.col("node").alias("a"), "b", *q_cols)
        right = pairs.withColumnRenamed("b", "node").join(g, ["space", "node"]).select("space", "a", F.col("node").alias("b"), *g_cols)
    # a self join reads one lineage twice: fresh column identities tell the sides apart
    right = right.toDF(*right.columns)

    def run(key: tuple, q: pa.Table, g: pa.Table) -> pa.Table:
        return fn(key, q, g, [(np.arange(q.num_rows), np.arange(g.num_rows), False)] if q.num_rows and g.num_rows else [])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _leaves(table: pa.Table) -> dict[int, np.ndarray]:
    """Rows of each leaf of a table that is sorted by leaf."""
    names, starts = np.unique(table["node"].to_numpy(), return_index=True)
    return {int(n): np.arange(a, b) for n, a, b in zip(names, starts, [*starts[1:], table.num_rows])}


def block_join(q: Tree, g: Tree, pairs: DataFrame, fn: Callable, schema: str, q_cols: list[str], g_cols: list[str], ordered: bool = False) -> DataFrame:
    """``fn(key, query rows, index rows, meetings)`` for every pair of blocks in which some of the leaf ``pairs`` (space, a, b) meet.

    A row travels once to each block that it meets; the leaf pairs travel as rows of the query side, and a leaf's rows
    meet at once all that they have to meet in the other block. ``ordered``: the tree meets itself, each pair of leaves once.
    """
    keys = ["space", "p", "r"]
    of = lambda tree, node, block: tree.blocks.select("space", F.col("node").alias(node), F.col("block").alias(block))
    links = pairs.join(of(q, "a", "p"), ["space", "a"]).join(of(g, "b", "r"), ["space", "b"]).checkpoint()
    met = links.select(*keys).distinct().checkpoint()  # a few pairs for each space, as blocks are few
    side = lambda tree, block: tree.rows.withColumnRenamed("block", block).join(F.broadcast(met), ["space", block])
    rows = side(q, "p").select(*keys, "node", F.lit(None).cast("long").alias("other"), *q_cols)
    left = rows.unionByName(links.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")), allowMissingColumns=True)
    right = side(g, "r").select(*keys, "node", *g_cols)
    # a self join reads one lineage twice: fresh column identities tell the sides apart
    right = right.toDF(*right.columns)

    def run(key: tuple, q: pa.Table, g: pa.Table) -> pa.Table:
        is_link = pc.is_valid(q["other"])
        links = q.select(["node", "other"]).filter(is_link)
        q, g = q.filter(pc.invert(is_link)).sort_by("node"), g.sort_by("node")
        own, others, meets = _leaves(q), _leaves(g), {}
        for a, b in zip(links["node"].to_pylist(), links["other"].to_pylist()):
            meets.setdefault((a, ordered and a == b), []).append(b)
        meetings = [(own[a], np.concatenate([others[b] for b in sorted(bs)]), same) for (a, same), bs in sorted(meets.items())]
        return fn(key, q, g, meetings)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


# ---- sums of similarities ----------------------------------------------------------------

_SUMS = "level int, space string, node long, total array<double>, own double"


def _sum_rows(level: int, space, node, total: np.ndarray, own: float) -> pa.Table:
    return pa.table({"level": pa.array([level], pa.int32()), "space": pa.array([space], pa.string()), "node": pa.array([node], pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.float64())), "own": pa.array([own])})


def _leaf_sums(table: pa.Table, level: int) -> pa.Table:
    u, w = unit(matrix(table["embedding"])), table["copies"].to_numpy().astype(np.float64)
    return _sum_rows(level, table["space"][0].as_py(), table["node"][0].as_py(), w @ u, float(w @ (u**2).sum(axis=1)))


def _merged_sums(table: pa.Table, level: int) -> pa.Table:
    return _sum_rows(level, table["space"][0].as_py(), table["parent"][0].as_py(), matrix(table["total"]).sum(axis=0), float(table["own"].to_numpy().sum()))


def with_sums(tree: Tree) -> DataFrame:
    """Nodes with ``total``, the sum of their unit vectors times ``copies``, and ``own``, that of the squared lengths."""
    level = tree.rows.select("space", "node", "embedding", "copies").groupBy("space", "node").applyInArrow(_at_level(_leaf_sums, tree.depth), _SUMS).checkpoint()
    every = level
    for d in range(tree.depth - 1, -1, -1):
        up = level.withColumn("parent", F.shiftright("node", HALVINGS))
        level = up.groupBy("space", "parent").applyInArrow(_at_level(_merged_sums, d), _SUMS).checkpoint()
        every = every.unionByName(level)
    return tree.nodes.join(every, ["level", "space", "node"]).checkpoint()


def similarity_sums(q: Tree, g: Tree, block: Callable, ordered: bool = False) -> DataFrame:
    """(space, part): partial sums over the pairs of rows, times their ``copies``, of the similarities above zero.

    Pairs of nodes between which no similarity is negative count by the product of their sums, those without a positive
    one not at all; the others are taken apart, down to the leaves, whose rows ``block`` multiplies. ``ordered``: the
    tree meets itself, each pair of rows once, and copies of a row are pairs as well.
    """
    of_q, of_g = with_sums(q), None
    of_g = of_q if ordered else with_sums(g)
    columns = lambda name: [F.struct("centre", "spread", "low", "high", "total", "own").alias(f"s_{name}")]

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (pa.RecordBatch.from_struct_array(batch[s]) for s in ("s_a", "s_b"))
                same = ordered & (batch["a"].to_numpy() == batch["b"].to_numpy())
                middle = np.arccos(np.clip((padded(left["centre"]) * padded(right["centre"])).sum(axis=1), -1.0, 1.0))
                reach = left["spread"].to_numpy() + right["spread"].to_numpy() + SLACK
                middle = np.where(same, 0.0, middle)
                product = (padded(left["total"]) * padded(right["total"])).sum(axis=1)
                value = np.where(same, (product - left["own"].to_numpy()) / 2.0, product)
                positive, negative = middle + reach <= np.pi / 2, middle - reach >= np.pi / 2
                part = np.where(positive, value, 0.0)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("space", "a", "b")], pa.array(part), pa.array(~(positive | negative))], ["space", "a", "b", "part", "is_open"])

    pairs, settled = None, None
    for level in range(max(q.depth, g.depth) + 1):
        a, b = side(of_q, q.depth, level, "a", columns("a")), side(of_g, g.depth, level, "b", columns("b"))
        both = a.join(b, "space") if pairs is None else pairs.join(a.withColumnRenamed("up_a", "pa"), ["space", "pa"]).join(b.withColumnRenamed("up_b", "pb"), ["space", "pb"])
        if ordered:
            both = both.filter("a <= b")
        tested = both.select("space", "a", "b", "s_a", "s_b").mapInArrow(test, "space string, a long, b long, part double, is_open boolean").checkpoint()
        closed = tested.filter("NOT is_open AND part <> 0").select("space", "part")
        settled = closed if settled is None else settled.unionByName(closed)
        pairs = tested.filter("is_open").select("space", F.col("a").alias("pa"), F.col("b").alias("pb"))
    left = pairs.select("space", F.col("pa").alias("a"), F.col("pb").alias("b"))
    cols = ["embedding", "copies"]
    return settled.unionByName(block_join(q, g, left, block, "space string, part double", cols, cols, ordered))
