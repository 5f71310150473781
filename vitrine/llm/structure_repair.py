"""Cheapest repair of a conversation's turn order, by a run-length dynamic programme over role and fault symbols.

Rows become symbols (role initial and fault). A row's edits are a min-plus matrix over the four states of the order
``(s?(ua)+)?``; equal consecutive symbols are one run, and a run of length L is crossed by the binary powers of its
matrix, which are computed once for each symbol. The costs at the starts of the runs then decide every edit from the
front, the smallest letter first among equals. Texts take no part: Spark numbers, flags and stages the rows, the
programme sees two letters a row, and the edits find their rows again by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .digests import ordered_sha256
from .staging import ready, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. STEP is the state after the one role that may follow and be made.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = (USER, USER, ASSISTANT, USER)
ACCEPTED = (START, ASSISTANT)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FAR = 1 << 60
#: Inside a run, costs are unrolled in pieces of so many rows.
PIECE = 1 << 12
WHITE = " \t\n\x0b\f\r"

Costs = tuple[int, int, int, int]


def _product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


class Programme:
    """The dynamic programme with its tables, which fill as symbols and costs are met; one for each task."""

    def __init__(self):
        self.inserted = [[FAR] * 4 for _ in range(4)]
        for q in range(4):
            at, cost = q, 0
            while self.inserted[q][at] == FAR:
                self.inserted[q][at] = cost
                at, cost = STEP[at], cost + INSERT
        self.end: Costs = tuple(min(self.inserted[q][r] for r in ACCEPTED) for q in range(4))
        self.powers: dict[str, list[list[list[int]]]] = {}
        self.choices: dict[tuple, tuple[str, int]] = {}

    def power(self, symbol: str, k: int) -> list[list[int]]:
        """Min-plus matrix of ``2**k`` rows of ``symbol``, insertions before each included."""
        powers = self.powers.setdefault(symbol, [])
        if not powers:
            role, fault = symbol
            row = [[FAR] * 4 for _ in range(4)]
            for q in range(4):
                row[q][q] = DELETE
                if fault not in "bd":
                    extra = TRUNCATED if fault == "t" else 0
                    row[q][STEP[q]] = min(row[q][STEP[q]], REROLE + extra)
                    if q in KEPT.get(role, {}):
                        row[q][KEPT[role][q]] = KEEP + extra
            powers.append(_product(self.inserted, row))
        while len(powers) <= k:
            powers.append(_product(powers[-1], powers[-1]))
        return powers[k]

    def before(self, symbol: str, length: int, costs: Costs) -> Costs:
        """Costs to go before ``length`` rows of ``symbol``, given those after them."""
        k = 0
        while length:
            if length & 1:
                m = self.power(symbol, k)
                costs = tuple(min(m[q][r] + costs[r] for r in range(4)) for q in range(4))
            length, k = length >> 1, k + 1
        return costs

    def choose(self, symbol: str, state: int, here: Costs, after: Costs) -> tuple[str, int]:
        """Cheapest edits of one row, the smallest letters first, and the state after it."""
        base = min(after)
        key = (symbol, state, tuple(c - base for c in here), tuple(c - base for c in after))
        if key not in self.choices:
            self.choices[key] = self._chosen(symbol, state, here, after)
        return self.choices[key]

    def _chosen(self, symbol: str, state: int, here: Costs, after: Costs) -> tuple[str, int]:
        letters = ""
        role, fault = symbol
        extra = TRUNCATED if fault == "t" else 0
        while True:
            if DELETE + after[state] == here[state]:
                return letters + "D", state
            if INSERT + here[STEP[state]] == here[state]:
                letters, state = letters + "I", STEP[state]
                continue
            kept = KEPT.get(role, {}).get(state)
            if kept is not None and fault not in "bd" and KEEP + extra + after[kept] == here[state]:
                return letters + "K", kept
            return letters + "R", STEP[state]

    def cheapest_edits(self, runs: list[tuple[str, int]]) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits of runs (symbol, length); among equals the ASCII-least audit.

        A symbol is a role letter (s, u, a, or x for any other) and a fault letter (b, d, t or -).
        """
        ahead = [self.end]
        for symbol, length in reversed(runs):
            ahead.append(self.before(symbol, length, ahead[-1]))
        ahead.reverse()
        audit, state = [], START
        for i, (symbol, length) in enumerate(runs):
            while length:
                piece = min(length, PIECE)
                costs = [self.before(symbol, length - piece, ahead[i + 1])]
                for _ in range(piece):
                    costs.append(self.before(symbol, 1, costs[-1]))
                for j in range(piece, 0, -1):
                    letters, state = self.choose(symbol, state, costs[j], costs[j - 1])
                    audit.append(letters)
                length -= piece
        while state not in ACCEPTED:
            audit.append("I")
            state = STEP[state]
        return ahead[0][START], "".join(audit)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows as the contract damages them: by ``crc32('conv_id:turn') % 20``.

    Null roles and texts, and a null turn in the key, are one space; rows without a conv_id are left out.
    """
    space = F.lit(" ")
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(key) % 20, F.coalesce("text", space)
    rows = conversations.where("conv_id is not null").where(kind != 0)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def numbered_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, source, turn, symbol, role, text): rows in order, from 1, with role letter and first fault.

    Ordered by turn, nulls first, rows of one turn by role and text. Faults: b blank, d duplicate (role and text seen
    earlier in the conversation), t truncated, - none. A conversation's rows are sorted in one task, which spills.
    """
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.left("role", F.lit(1))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(bare == "", "b").when(F.col("_seen"), "d").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # one shuffle for both windows: rows of a conversation hold all rows of its texts
    rows = rows.where("conv_id is not null").repartition("conv_id").withColumn("_seen", seen)
    return rows.select(
        "conv_id", F.row_number().over(order).cast("long").alias("source"), "turn",
        F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault).alias("symbol"), "role", "text",
    )


SUMMARY = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]


class _Conversation:
    """Counts and runs of the rows of one conversation, seen once and in order."""

    def __init__(self, conv_id):
        self.conv_id, self.runs, self.faults, self.illegal = conv_id, [], {"b": 0, "d": 0, "t": 0, "-": 0}, 0
        self.low = self.high = self.role = None
        self.turns = 0

    def add(self, turn: int | None, symbol: str) -> None:
        role, fault = symbol
        self.faults[fault] += 1
        if self.role is not None and self.role + role not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])

    def summary(self, programme: Programme) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, *programme.cheapest_edits(self.runs))


def summaries(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of :func:`numbered_rows`; one row each."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in SUMMARY)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, key, programme = None, pa.int64(), Programme()

        def made(done: list[tuple]) -> pa.RecordBatch:
            types = [key, *[pa.string() if t == "string" else pa.int64() for _, t in SUMMARY]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["conv_id", *[n for n, _ in SUMMARY]])

        for batch in batches:
            key, done = batch.schema.field(0).type, []
            for conv_id, turn, symbol in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.summary(programme))
                    current = _Conversation(conv_id)
                current.add(turn, symbol)
            if done:
                yield made(done)
        if current is not None:
            yield made([current.summary(programme)])

    narrow = rows.select("conv_id", "source", F.col("turn").cast("long").alias("turn"), "symbol")
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "source").mapInArrow(read, schema)


def edits(audits: DataFrame) -> DataFrame:
    """(conv_id, position, source, edit, made): a row for each row that an audit leaves; source is null for insertions.

    ``made`` is the role that the order asks for at that place; an audit that leaves an odd number of rows starts with a
    system row. Long audits are unrolled in pieces.
    """
    kind = audits.schema["conv_id"].dataType.simpleString()

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits = batch.column(1).to_pylist()
            letters, sizes = np.frombuffer("".join(audits).encode(), np.uint8), np.array([len(a) for a in audits])
            row, start = np.repeat(np.arange(len(audits)), sizes), np.cumsum(sizes) - sizes
            used, left = np.cumsum(letters != ord("I")), letters != ord("D")
            kept = np.cumsum(left)
            source = used - (used[start] - (letters[start] != ord("I")))[row]
            position = kept - (kept[start] - left[start])[row]
            odd = (position[start + sizes - 1] % 2)[row]
            role = np.where((position + odd) % 2 == 1, "user", "assistant")
            role = np.where((odd == 1) & (position == 1), "system", role)
            every = np.flatnonzero(left)
            for at in range(0, len(every), 1 << 16):
                part = every[at : at + (1 << 16)]
                edit = pa.array([chr(c) for c in letters[part]], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[part])), pa.array(position[part], pa.int64()), pa.array(source[part], pa.int64(), mask=letters[part] == ord("I")), edit, pa.array(role[part].tolist(), pa.string())],
                    names=["conv_id", "position", "source", "edit", "made"],
                )

    return audits.select("conv_id", "audit").where("audit <> ''").mapInArrow(unroll, f"conv_id {kind}, position long, source long, edit string, made string")


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit, source): the conversations after their audits (K, R or I).

    Kept rows have their own role, others that of their place; inserted rows have an empty text.
    """
    todo = edits(audits)
    # audits are small beside the rows that they unroll to, so their file size is no reason to broadcast them
    old = todo.where("edit <> 'I'").hint("merge").join(rows.select("conv_id", "source", "role", "text"), ["conv_id", "source"])
    own: Column = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("made"))
    new = todo.where("edit = 'I'").select("conv_id", "position", F.col("made").alias("role"), F.lit("").alias("text"), "edit", "source")
    return old.select("conv_id", "position", own.alias("role"), "text", "edit", "source").unionByName(new)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, repaired rows) of conversations (conv_id, turn, role, text), undamaged or damaged.

    Every edit has its price: keeping 0, another role 2, deletion 3 (needed for blank and duplicate rows), an empty row
    2, and 1 more for a truncated row that stays; the cheapest edits that give the order ``(s?(ua)+)?`` are taken, the
    ASCII-least audit among equals. Null roles and texts are one space, null turns come first, repeated rows are
    duplicates, a role of any other initial has to be changed or deleted, rows without a conv_id are left out and other
    columns ignored. An empty table gives two empty ones.
    """
    ready(conversations.sparkSession)
    rows = staged(numbered_rows(conversations), "repair-rows")
    found = staged(summaries(rows), "repair-audits")
    return found, repaired_rows(rows, found)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Damage, repair and digest of every conversation; those without rows after the damage have zeros and empty values."""
    found, rows = repair(damage(conversations))
    line = rows.select("conv_id", "position", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = ordered_sha256(line, ["conv_id"], "position", "line", "\n").withColumnRenamed("sha256", "repaired_sha256")
    ids = conversations.select("conv_id").where("conv_id is not null").distinct()
    out = ids.join(found, "conv_id", "left").join(digests, "conv_id", "left")
    zero = [F.coalesce(n, F.lit("") if t == "string" else F.lit(0).cast("long")).alias(n) for n, t in SUMMARY]
    return out.select("conv_id", *zero, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
