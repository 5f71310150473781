"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, connected components.

Documents with one shingle set are one class. Classes that share a band of MinHash values are compared by odd
sketches (parity bitmaps of the MinHash sample, whose XOR population count estimates high similarities well); what
comes close is confirmed on the full shingle sets. Only spanning links are kept, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import distinct_per_row, mix, row_chunks, shingle_hashes, text_bytes, word_hashes
from .staging import ready, staged

BANDS, BAND_ROWS = 28, 5
SAMPLE = BANDS * BAND_ROWS
WORDS = 4  # 64-bit words of an odd sketch
BITS = 64 * WORDS
#: How far below the wanted similarity an estimate may be and still be confirmed (about six standard errors).
MARGIN = 0.2
#: Classes, and shingles, of one block; larger buckets are compared block by block in separate tasks.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21

_SEEDS = mix(np.arange(1, 2 * SAMPLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLY = (_SEEDS[:SAMPLE] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_SEEDS[SAMPLE:] >> np.uint64(32)).astype(np.uint32)


def minhash(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash samples (rows x SAMPLE, 32 bits) of the non-empty rows of shingle hashes."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLE, len(begin) - 1), np.uint32)
    work = np.empty_like(short)
    for k in range(SAMPLE):
        np.multiply(short, _MULTIPLY[k], out=work)
        np.add(work, _ADD[k], out=work)
        out[k] = np.minimum.reduceat(work, begin[:-1])
    return out.T


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x WORDS) of MinHash samples."""
    place = mix(sample.astype(np.uint64) * np.uint64(SAMPLE) + np.arange(SAMPLE, dtype=np.uint64)) % np.uint64(BITS)
    odd = np.zeros((len(sample), BITS), np.uint8)
    rows = np.arange(len(sample))
    for k in range(sample.shape[1]):
        odd[rows, place[:, k].astype(np.int64)] ^= 1
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def odd_similarity(difference: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the number of differing bits."""
    share = np.minimum(2.0 * difference / BITS, 1 - 1e-9)
    return 1.0 + BITS / (4.0 * SAMPLE) * np.log(1.0 - share)


def band_keys(sample: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sample), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sample), b + 1, np.uint64)
        for v in sample[:, b * BAND_ROWS : (b + 1) * BAND_ROWS].T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v)
        keys[:, b] = h
    return keys.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in row_chunks(offsets):
            words, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            values, begin = distinct_per_row(*shingle_hashes(words, first))
            sizes = np.diff(begin)
            full = np.flatnonzero(sizes > 0)
            total, other = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            keys = np.zeros((hi - lo, 0), np.int64)
            bands: list = [[]] * (hi - lo)
            sketch: list = [b""] * (hi - lo)
            if len(full):
                at = np.concatenate([begin[:-1][full], begin[-1:]])
                total[full] = np.add.reduceat(values, at[:-1])
                other[full] = np.bitwise_xor.reduceat(mix(values + np.uint64(1)), at[:-1])
                sample = minhash(values, at)
                keys, bits = band_keys(sample), odd_sketch(sample)
                for r, k, s in zip(full.tolist(), keys, bits):
                    bands[r], sketch[r] = k, s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(total.view(np.int64)), pa.array(other.view(np.int64)),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "set_sum", "set_xor", "bands", "sketch"],
            )


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches that are sorted by ``keys``."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        columns = [table.column(k).to_numpy() for k in keys]
        same = np.ones(table.num_rows, bool)
        for c in columns:
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


class Forest:
    """Union-find over a block's rows."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _near_pairs(sketch: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, low: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (left, right) whose estimate is at least ``low`` and whose sizes allow the similarity, best first."""
    found, same = [], left is right
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        differ = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int64)
        small, large = np.minimum(size[rows][:, None], size[right][None, :]), np.maximum(size[rows][:, None], size[right][None, :])
        x, y = np.nonzero((odd_similarity(differ) >= low) & (small >= ratio * large - 1e-9))
        if same:
            x, y = x[y > x + lo], y[y > x + lo]
        found.append((differ[x, y], rows[x], right[y]))
    differ, x, y = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(differ, kind="stable")
    return x[order], y[order]


def _blocks(keys: list[str], threshold: float, confirm: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links that span each group of rows: by estimate, or confirmed on the shingle sets.

    A group is one bucket, or the meeting of two blocks ``i`` and ``j`` of a large one; between blocks only pairs
    across them are compared.
    """
    low = threshold - MARGIN

    def exact(sets: list[np.ndarray], x: int, y: int) -> bool:
        common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return 100 * common >= round(100 * threshold) * (len(sets[x]) + len(sets[y]) - common)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, [*keys, "i", "j"]):
            columns = [table.column(k).to_numpy() for k in [*keys, "i", "j"]]
            edge = np.ones(table.num_rows, bool)
            edge[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            starts = np.append(np.flatnonzero(edge), table.num_rows)
            ids, block = table.column("rep").to_numpy(), table.column("block").to_numpy()
            sizes = table.column("n_shingles").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, WORDS)
            i_of, j_of = columns[-2], columns[-1]
            a_out, b_out = [], []
            lengths = np.diff(starts)
            two = starts[:-1][lengths == 2] if not confirm else np.zeros(0, np.int64)
            if len(two):
                fits = odd_similarity(np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(1, dtype=np.int64)) >= low
                fits &= np.minimum(sizes[two], sizes[two + 1]) >= threshold * np.maximum(sizes[two], sizes[two + 1]) - 1e-9
                a_out.append(ids[two[fits]])
                b_out.append(ids[two[fits] + 1])
            for lo, n in zip(starts[:-1], lengths):
                if n < 2 or (n == 2 and not confirm):
                    continue
                rows = np.arange(lo, lo + n)
                if i_of[lo] == j_of[lo]:
                    left = right = rows
                else:
                    left, right = rows[block[rows] == i_of[lo]], rows[block[rows] == j_of[lo]]
                    if not len(left) or not len(right):
                        continue
                x, y = _near_pairs(sketch, sizes, left, right, low, threshold)
                sets = {}
                if confirm:
                    raw = table.column("shingles").slice(lo, n).to_pylist()
                    sets = [np.frombuffer(r, np.uint64) for r in raw]
                forest, kept = Forest(int(n)), []
                for p, q in zip((x - lo).tolist(), (y - lo).tolist()):
                    if forest.root(p) != forest.root(q) and (not confirm or exact(sets, p, q)):
                        forest.join(p, q)
                        kept.append((p, q))
                if kept:
                    pairs = np.array(kept) + lo
                    a_out.append(ids[pairs[:, 0]])
                    b_out.append(ids[pairs[:, 1]])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return link


def _meetings(rows: DataFrame, keys: list[str], parts: str) -> DataFrame:
    """Each row once for every pair of blocks that it takes part in, grouped by key and pair."""
    block = F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")
    met = rows.withColumn("block", block).withColumn("_with", F.explode(F.sequence(F.lit(0), (F.col(parts) - 1).cast("int"))))
    met = met.withColumn("i", F.least("block", "_with")).withColumn("j", F.greatest("block", "_with")).drop("_with", parts)
    return met.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "rep")


def near_duplicates(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (``doc_id``, ``text``).

    Links documents whose sets of five-word shingles have a Jaccard similarity of at least ``threshold`` and gives the
    smallest doc_id reachable. Documents without words (null, empty) link with nothing; documents of one to four words
    have one shingle, their whole sequence. Repeated rows and exact copies are one class and each get a row, as do rows that
    repeat a doc_id with another text, which are documents of their own in one component_id where linked; an empty
    table gives none; other input columns are not read. A pair at the threshold escapes all bands with a chance of
    about 1e-7 (2e-5 at a threshold of 0.8); nothing found is dropped.
    """
    spark = ready(docs.sparkSession)
    schema = "doc_id long, n_shingles long, set_sum long, set_xor long, bands array<long>, sketch binary"
    signed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketches, schema)
    signed = staged(signed.withColumn("row", F.monotonically_increasing_id()), "sketches")
    # a class is named by one row of its smallest doc_id; a doc_id may repeat with other texts, a row does not
    shared = ["set_sum", "set_xor", "n_shingles"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first")
    classes = signed.where("n_shingles > 0").groupBy(*shared).agg(first).select(*shared, F.col("first.doc_id").alias("low"), F.col("first.row").alias("rep"))
    classes = staged(classes, "classes")
    reps = signed.where("n_shingles > 0").join(classes, shared).where("row = rep")
    reps = staged(reps.select("rep", "low", *shared, "bands", "sketch"), "representatives")

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = keyed.join(crowded.select("key", "parts"), "key").join(reps.select("rep", "n_shingles", "sketch"), "rep")
    guessed = _meetings(members, ["key"], "parts").mapInArrow(_blocks(["key"], threshold, False), "a long, b long")
    close = connected_components(staged(guessed.distinct(), "guesses"))

    sizes = close.join(reps.select(F.col("rep").alias("id"), "n_shingles"), "id")
    parts = sizes.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    wanted = close.join(parts, "component").withColumnRenamed("id", "rep").join(reps.select("rep", "low", "set_sum", "set_xor"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("low"), "text").join(wanted.hint("shuffle_hash"), "low")
    sets = texts.select("rep", "component", "parts", "set_sum", "set_xor", "text").mapInArrow(_sets, "rep long, component long, parts int, shingles binary")
    sets = sets.dropDuplicates(["rep"]).join(reps.select("rep", "n_shingles", "sketch"), "rep")
    links = _meetings(sets, ["component"], "parts").mapInArrow(_blocks(["component"], threshold, True), "a long, b long")
    joined = connected_components(staged(links, "confirmed")).withColumnRenamed("id", "rep")

    member = classes.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    named = member.join(lowest, "component").select(*shared, "component_id")
    out = signed.select("doc_id", *shared).join(named, shared, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(5))
        sums, others = (batch.column(c).to_numpy() for c in (3, 4))
        for lo, hi in row_chunks(offsets):
            words, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            values, begin = distinct_per_row(*shingle_hashes(words, first))
            own = [values[a:b] for a, b in zip(begin[:-1], begin[1:])]
            same = [  # of several texts of one doc_id, that of the class
                i for i, v in enumerate(own)
                if v.sum(dtype=np.uint64).view(np.int64) == sums[lo + i] and np.bitwise_xor.reduce(mix(v + np.uint64(1))).view(np.int64) == others[lo + i]
            ]
            part = batch.slice(lo, hi - lo).take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([own[i].tobytes() for i in same], pa.binary())], names=["rep", "component", "parts", "shingles"])


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps its smallest doc_id.

    Documents without words, and rows without a doc_id, all stay. Of rows that repeat one doc_id and text, each stays if that id stays.
    """
    gone = near_duplicates(docs, threshold).where("not kept").select(F.col("doc_id").alias("__v_gone"))
    return docs.join(gone.distinct().hint("shuffle_hash"), F.col("doc_id") == F.col("__v_gone"), "left_anti")
