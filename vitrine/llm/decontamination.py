"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed on exact shingle sets.

Test items are partitioned by the size of their shingle sets. Items of up to SMALLEST shingles are looked up by each of
their shingles, which misses none. For a larger class, of items of up to Q shingles, a document is
seen as windows of 2Q shingles, Q apart, so that a short item is compared with a set of its own order however long the
document is. A window and an item become candidates when one of the MinHash values agrees; candidates are confirmed
by the exact share of the item's shingles that the whole document has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import distinct_per_row, mix, row_chunks, shingle_hashes, text_bytes, word_hashes
from .staging import ready

SAMPLE = 64
SMALLEST = 8
#: Shingles of one block of test items; a larger benchmark is searched block by block, all documents against each.
BLOCK_SHINGLES = 1 << 20
_FILTER_BITS = 18

_SEEDS = mix(np.arange(1, 2 * SAMPLE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_MULTIPLY = (_SEEDS[:SAMPLE] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_SEEDS[SAMPLE:] >> np.uint64(32)).astype(np.uint32)


class Items:
    """Shingle sets of a block of items and, by size class, their MinHash values."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        values, begin = distinct_per_row(*shingle_hashes(*word_hashes(data, offsets)))
        self.ids = np.array(ids, np.int64)
        self.sets = [values[a:b] for a, b in zip(begin[:-1], begin[1:])]
        self.size = np.diff(begin)
        few = np.flatnonzero((self.size > 0) & (self.size <= SMALLEST))
        held = np.concatenate([self.sets[m] for m in few]) if len(few) else np.zeros(0, np.uint64)
        by = np.argsort(held, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(held & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        #: Shingles of the small items in order, the item of each, and a filter.
        self.small = held[by], np.repeat(few, self.size[few])[by], seen
        order = np.ceil(np.log2(np.maximum(self.size, 1))).astype(int)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for c in sorted(set(order[self.size > SMALLEST].tolist())):
            members = np.flatnonzero((order == c) & (self.size > SMALLEST))
            tables = []
            for k in range(SAMPLE):
                low = np.array([(_hashed(self.sets[m], k)).min() for m in members], np.uint32)
                by = np.argsort(low, kind="stable")
                seen = np.zeros(1 << _FILTER_BITS, bool)
                seen[low & np.uint32((1 << _FILTER_BITS) - 1)] = True
                tables.append((low[by], members[by], seen))
            self.classes[c] = tables

    def candidates(self, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Distinct (row, item) pairs for shingles in text order, ``begin`` marking the rows."""
        counts = np.diff(begin)
        blocks = -(-counts // SMALLEST)  # pieces of SMALLEST shingles
        first = np.concatenate([[0], np.cumsum(blocks)])
        row0 = np.repeat(np.arange(len(counts)), blocks)
        starts = begin[:-1][row0] + (np.arange(first[-1]) - first[:-1][row0]) * SMALLEST
        found = [np.zeros((0, 2), np.int64), self._small_candidates(values, begin)]
        if not len(starts) or not self.classes:
            return np.unique(np.concatenate(found), axis=0)
        short = (values >> np.uint64(32)).astype(np.uint32)
        # how pieces pair up to the next size, row by row; the same for every hash function
        plans, row = [], row0
        for c in range(int(np.log2(SMALLEST)), max(self.classes) + 1):
            if len(plans):
                at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                place = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))
                pick = np.flatnonzero(place % 2 == 0)
                row = row[pick]
            else:
                pick = None
            follows = np.append(row[1:] == row[:-1], False)
            plans.append((c, pick, row, follows))
        for k in range(SAMPLE):
            low = np.minimum.reduceat(short * _MULTIPLY[k] + _ADD[k], starts)
            for c, pick, row, follows in plans:
                if pick is not None:
                    low = np.minimum.reduceat(low, pick)
                if c not in self.classes:
                    continue
                window = low.copy()
                window[:-1][follows[:-1]] = np.minimum(low[:-1], low[1:])[follows[:-1]]
                known, members, seen = self.classes[c][k]
                hit = np.flatnonzero(seen[window & np.uint32((1 << _FILTER_BITS) - 1)])
                if not len(hit):
                    continue
                a, b = np.searchsorted(known, window[hit], "left"), np.searchsorted(known, window[hit], "right")
                n = b - a
                which = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found.append(np.unique(np.column_stack([np.repeat(row[hit], n), members[which]]), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def _small_candidates(self, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(row, item) wherever a row has a shingle of an item of up to SMALLEST shingles."""
        held, owner, seen = self.small
        at = np.flatnonzero(seen[(values & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]) if len(held) else np.zeros(0, np.int64)
        a, b = np.searchsorted(held, values[at], "left"), np.searchsorted(held, values[at], "right")
        n = b - a
        which = np.repeat(a - np.concatenate([[0], np.cumsum(n)])[: len(n)], n) + np.arange(n.sum())
        row = np.searchsorted(begin, np.repeat(at, n), "right") - 1
        return np.unique(np.column_stack([row, owner[which]]), axis=0).astype(np.int64).reshape(-1, 2)

    def leaks(self, values: np.ndarray, begin: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of the confirmed candidates."""
        out, last, known = [], -1, None
        for row, item in self.candidates(values, begin).tolist():
            if row != last:
                last, known = row, np.unique(values[begin[row] : begin[row + 1]])
            shared = len(np.intersect1d(known, self.sets[item], assume_unique=True))
            if 1000 * shared >= round(1000 * threshold) * self.size[item]:
                out.append((row, item, shared))
        return out


def _hashed(values: np.ndarray, k: int) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.uint32) * _MULTIPLY[k] + _ADD[k]


def _item_blocks(items: DataFrame) -> Iterator[Items]:
    """The distinct items in blocks of bounded size."""
    plain = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = plain.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    parts = max(1, -(-total // BLOCK_SHINGLES))
    for part in range(parts):
        rows = plain.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])


def _shingled(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets):
        values, begin = shingle_hashes(*word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        yield lo, hi, values, begin


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles): items of which a document has ``threshold`` of the shingles.

    Shingles are five words, A-Z lower-cased; an item or document of fewer words has one, its whole sequence. Null or
    empty texts and null item ids match nothing; repeated documents each get their rows, repeated items one; empty
    tables give no rows; other columns are not read. Documents are never shuffled; items are broadcast in blocks
    of BLOCK_SHINGLES. Items of up to SMALLEST shingles are found without exception; a window shares one of 64 MinHash
    values with a larger item at the threshold with a chance of at least 0.9999.
    """
    spark = ready(docs.sparkSession)
    schema = "doc_id long, item_id long, item_shingles long, shared_shingles long"
    out = spark.createDataFrame([], schema)
    for block in _item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for lo, _, values, begin in _shingled(batch.column(1)):
                    rows = known.leaks(values, begin, threshold)
                    if rows:
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([ids[lo + r[0]] for r in rows], pa.int64()),
                            "item_id": pa.array([known.ids[r[1]] for r in rows], pa.int64()),
                            "item_shingles": pa.array([known.size[r[1]] for r in rows], pa.int64()),
                            "shared_shingles": pa.array([r[2] for r in rows], pa.int64()),
                        })

        found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema)
        out = out.union(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; all columns stay, nothing is shuffled.

    Null and empty texts stay, as does every row if the benchmark is empty; whole texts are searched whatever their length,
    repeated rows go or stay alike, an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    for block in _item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, values, begin in _shingled(batch.column(batch.num_columns - 1)):
                    for row, _, _ in shared.value.leaks(values, begin, threshold):
                        keep[lo + row] = False
                yield batch.filter(pa.array(keep)).select(batch.schema.names[:-1])

        docs = docs.withColumn("__v_text", F.col("text")).mapInArrow(clean, docs.schema)
    return docs
