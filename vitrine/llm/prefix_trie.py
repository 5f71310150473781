"""Trie of the common beginnings of conversations, aggregated by Spark SQL's ROLLUP over positional turn columns.

A conversation is laid out as blocks of BLOCK turns. A block row has the columns ``t1 .. t8`` (the ids of its turns, each
made from the turn's content and its position) and the key of the node at which the block before ended, so one
``GROUP BY key, ROLLUP(t1, .., t8)`` aggregates the prefixes of all lengths of all blocks together; ``grouping_id()``
tells a row's depth. Keys are 128-bit exclusive-or sums of positional turn ids, so a running window makes them and no
block waits for another: conversations of any length take the same two rollups.

A node belongs to the smallest member of it. The nodes that a conversation owns are the end of its path, because a
deeper node has fewer members; so sums over a subtree come from one number for each conversation, summed over the
members of a node by the second rollup, less what the owner has above the node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .digests import joined_pieces, ordered_sha256
from .staging import ready, staged, words

BLOCK = 8
#: Conversations share the head of the first one of their group of so many ids; at most HEAD - 1 turns.
GROUP, HEAD = 20, 4
#: A parent of more than one HOT_SHARE-th of the rows of a join is broadcast, so at most HOT_SHARE rows are.
HOT_SHARE = 1000
TURNS = [f"t{i}" for i in range(1, BLOCK + 1)]
NODE = ["depth", "hi", "lo"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, words): the turns of each conversation, numbered from 1 in the order of ``turn``.

    ``turn_id`` is 128 bits of the SHA-256 of role and text, where null counts as empty. Null turns come first; rows of
    one turn are ordered by turn_id, so repeated rows stay next to each other. Rows without a conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.unhex(F.left(F.sha2(content, 256), F.lit(32))).alias("turn_id"), words(text).alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "turn_id", "words")


def share_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, turns) of rebuilt conversations: the first h turns of the group's first conversation, then the own ones after h.

    The group of c starts at ``c - c % GROUP`` and h is ``crc32(c) % HEAD``. A group whose first conversation is absent
    has no head to share; a conversation may end up without turns and stays a member.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % HEAD
    members = turns.groupBy("conv_id").agg(F.count("*").alias("_n")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("_base"), h.alias("_h"))
    heads = turns.where(F.col("pos") < HEAD).where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_base"), "pos", "turn_id", "words")
    shared = members.where("_h > 0").join(heads, "_base").where("pos <= _h").select("conv_id", F.lit(0).alias("_part"), "pos", "turn_id", "words")
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("_part"), "pos", "turn_id", "words")
    order = Window.partitionBy("conv_id").orderBy("_part", "pos")
    rebuilt = shared.unionByName(own).select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "turn_id", "words")
    return members.select("conv_id"), rebuilt


def _blocks(members: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, block, key_hi, key_lo, last, t1 .. t8): one row for each BLOCK turns; members without turns have an empty block."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lanes = turns.select(
        "conv_id", "pos", F.struct(F.xxhash64("turn_id", "pos").alias("hi"), F.xxhash64("pos", "turn_id").alias("lo"), "words").alias("t1"),
    )
    wide = lanes.select(
        "conv_id", "pos", "t1",
        *[F.coalesce(F.bit_xor(f"t1.{lane}").over(before), F.lit(0)).cast("long").alias(f"key_{lane}") for lane in ("hi", "lo")],
        *[F.lead("t1", i).over(order).alias(f"t{i + 1}") for i in range(1, BLOCK)],
        F.lead("pos", BLOCK).over(order).isNull().alias("last"),
    )
    blocks = wide.where((F.col("pos") - 1) % BLOCK == 0).select("conv_id", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), "key_hi", "key_lo", "last", *TURNS)
    turnless = members.join(turns.where("pos = 1").select("conv_id"), "conv_id", "left_anti")
    none = turnless.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("key_hi"), F.lit(0).cast("long").alias("key_lo"), F.lit(True).alias("last"), *[F.lit(None).cast(blocks.schema["t1"].dataType).alias(t) for t in TURNS])
    return blocks.unionByName(none)


def _xor(lane: str, columns: list[str]) -> Column:
    out = F.col(f"key_{lane}")
    for c in columns:
        out = out.bitwiseXOR(F.coalesce(F.col(f"{c}.{lane}"), F.lit(0).cast("long")))
    return out


def _rolled(blocks: DataFrame, aggregates: str) -> DataFrame:
    """``aggregates`` over the blocks below every prefix: depth, hi, lo, p_hi, p_lo (the parent's), words, and the aggregates.

    The prefixes that a short block does not have are dropped before the aggregation, since Spark pushes the condition
    on grouping columns below it; copies are aggregated in the map tasks.
    """
    spark = blocks.sparkSession
    real = " OR ".join([f"(g = {(1 << BLOCK) - 1} AND block = 0)", *[f"(g = {(1 << (BLOCK - d)) - 1} AND t{d} IS NOT NULL)" for d in range(1, BLOCK + 1)]])
    keys = ", ".join(TURNS)
    rolled = spark.sql(
        f"SELECT * FROM (SELECT block, key_hi, key_lo, {keys}, grouping_id() AS g, {aggregates} FROM {{blocks}} GROUP BY block, key_hi, key_lo, ROLLUP({keys})) WHERE {real}",
        blocks=blocks,
    )
    last = F.coalesce(*reversed(TURNS))
    names = [c for c in rolled.columns if c not in {"block", "key_hi", "key_lo", "g", *TURNS}]
    out = rolled.select(
        (F.col("block") * BLOCK + BLOCK - F.bit_count("g")).alias("depth"), _xor("hi", TURNS).alias("hi"), _xor("lo", TURNS).alias("lo"), last.alias("_last"), *names,
    )
    parent = [F.col(lane).bitwiseXOR(F.coalesce(F.col(f"_last.{lane}"), F.lit(0).cast("long"))).alias(f"p_{lane}") for lane in ("hi", "lo")]
    return out.select("depth", "hi", "lo", *parent, F.coalesce("_last.words", F.lit(0).cast("long")).alias("words"), *names)


def _parents(nodes: DataFrame, parent: list[Column]) -> DataFrame:
    """(depth, hi, lo, _owner) of the nodes that start a conversation's own part, with the owner of their parent.

    Parents with a HOT_SHARE-th of all such nodes and more, of which there are HOT_SHARE at most, are broadcast; no other
    parent has more of the rows that are shuffled.
    """
    tops = nodes.where("top").select(F.col("depth").alias("_d"), F.col("hi").alias("_h"), F.col("lo").alias("_l"), *parent)
    owners = staged(nodes.where("n_tops > 0").select(*NODE, F.col("conv_id").alias("_owner"), "n_tops"), "trie-parents")
    least = (owners.agg(F.sum("n_tops")).first()[0] or 0) / HOT_SHARE
    hot, cold = owners.where(F.col("n_tops") >= least).drop("n_tops"), owners.where(F.col("n_tops") < least).drop("n_tops")
    met = tops.join(F.broadcast(hot), NODE, "left")
    rest = met.where("_owner is null").drop("_owner").join(cold, NODE)
    return met.where("_owner is not null").unionByName(rest).select(F.col("_d").alias("depth"), F.col("_h").alias("hi"), F.col("_l").alias("lo"), "_owner")


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, pos from 1 without gaps, turn_id, words).

    ``members`` (distinct conv_id) also names the conversations without turns, which end at the root. Columns: conv_id
    (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree, its top included), saved_tokens (over the subtree, (n_convs - 1) times the words of a node's last turn),
    ends_sha256 (of the comma-joined conv_ids that end at the node, ascending), hi and lo (the node's key).
    Equal turns at different places are different nodes; a turn table without rows gives no nodes.
    """
    ready(turns.sparkSession)
    blocks = staged(_blocks(members, turns), "trie-blocks")
    nodes = staged(_rolled(blocks, "min(conv_id) AS conv_id, count(1) AS n_convs"), "trie-nodes")

    chain = Window.partitionBy("conv_id").orderBy("depth")
    saved = (F.col("n_convs") - 1) * F.col("words")
    chained = nodes.select(
        *NODE, "p_hi", "p_lo", "conv_id", "n_convs", saved.alias("saved"),
        F.coalesce(F.sum(saved).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"),
        ((F.row_number().over(chain) == 1) & (F.col("depth") > 0)).alias("top"), F.lead("depth").over(chain).isNotNull().cast("long").alias("more"),
    )
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")]
    kids = chained.where("top").groupBy(*parent).agg(F.count("*").alias("tops"))
    counted = chained.join(kids, NODE, "left").withColumn("n_tops", F.coalesce("tops", F.lit(0)))
    counted = staged(counted.withColumn("n_children", F.col("more") + F.col("n_tops")).drop("tops", "more"), "trie-counted")

    own = counted.groupBy("conv_id").agg(F.sum("saved").alias("own_saved"), (F.max_by("n_children", "depth") == 0).cast("long").alias("own_leaf"))
    below = _rolled(blocks.join(own, "conv_id"), "sum(own_saved) AS all_saved, sum(own_leaf) AS n_leaves").select(*NODE, "all_saved", "n_leaves")
    outer = _parents(counted, parent)

    ends = blocks.where("last").select(
        F.when(F.col("t1").isNull(), 0).otherwise(F.col("block") * BLOCK + sum(F.col(t).isNotNull().cast("int") for t in TURNS)).cast("long").alias("depth"),
        _xor("hi", TURNS).alias("hi"), _xor("lo", TURNS).alias("lo"), "conv_id", F.col("conv_id").cast("string").alias("name"),
    )
    digests = ordered_sha256(joined_pieces(ends, NODE, "conv_id", "name", ","), NODE, "conv_id", "name", ",")

    out = counted.join(below, NODE).join(outer, NODE, "left").join(digests, NODE, "left")
    return out.select(
        "conv_id", "depth", F.coalesce("_owner", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("all_saved") - F.col("above")).alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "hi", "lo",
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of the conversations rebuilt by :func:`share_heads`.

    Null roles and texts are empty, null turns come first, repeated rows are turns of their own, rows without a conv_id
    are left out, other columns are ignored, and an empty table gives no nodes. A conversation's rows are sorted in one
    task, which spills; its texts stay behind, as only ids of turns are shuffled.
    """
    turns = staged(turn_rows(conversations), "trie-turns")
    return prefix_trie(*share_heads(turns))
