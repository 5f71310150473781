"""Scoring texts by a class-based bigram model: exchange clustering, class transitions, word emissions.

Documents are coded once, part by part, against a dictionary of each part's own words; the words' corpus counts come
back to the parts through a shuffle by word hash. Words and their counts are never gathered in one place: the driver
sees the most frequent words' counts, a table of their bigrams, and class tables, all of fixed size.

Every word of MIN_COUNT training occurrences is clustered by its own contexts. The most frequent words and the endings
of the others are exchanged on the driver, which gives each word a class to start from. Then passes over the parts
count each other word's neighbour classes, and tasks of word buckets move the words against the class table of the
pass: half of the words a pass, so that neighbours do not swap past each other, and a pass that lowers the likelihood
is dropped. Rarer words, and words outside the training documents, have the class of their ending.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_duplicates import _groups
from .shingles import mix, row_chunks, text_bytes, word_hashes
from .staging import bucketed, crc_of_id, drop_staged, ready, shared_path, staged, staged_at

_log = logging.getLogger(__name__)
#: Words whose exchange starts on the driver, endings that stand for the rest, classes, and passes of that exchange.
FREQUENT, ENDINGS, CLASSES, PASSES = 1024, 256, 64, 12
#: Training occurrences from which a word is clustered by its own contexts, and the most passes over the parts for that.
MIN_COUNT, WORD_PASSES = 5, 6
#: Dictionary entries that one counting task takes at a time, and one exchanging task; context entries of one block of it.
BUCKET_ENTRIES, CONTEXT_ENTRIES, BLOCK = 1 << 20, 1 << 18, 1 << 15
END_WORD = np.uint64(0x656E64206F662074)
_PRIOR = 0.1  # added to each class transition


def _endings(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number below ENDINGS for the last two bytes of each word (one-byte words repeat theirs)."""
    last = data[stops - 1].astype(np.uint64)
    before = data[np.maximum(stops - 2, 0)].astype(np.uint64)
    return (mix(last * np.uint64(257) + before + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.uint16)


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, endings, first index per row) of the words, each row closed by the end word."""
    hashes, first = word_hashes(data, offsets)
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = inside
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[offsets[:-1]] = True
    if len(data):
        stop[1:-1] &= ~inside[1:] | starts_row[1:-1]
    ends = _endings(lower, np.flatnonzero(stop)) if len(hashes) else np.zeros(0, np.uint16)
    return np.insert(hashes, first[1:], END_WORD), np.insert(ends, first[1:], 0), first + np.arange(len(first))


_PART = "part long, doc_id array<long>, held_out array<boolean>, first array<long>, tokens binary, hashes binary, counts binary, endings binary"


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each batch of documents: its dictionary with training counts, and its tokens as dictionary places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(1))
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        pieces = [_words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in row_chunks(offsets)]
        hashes, endings = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        lengths = np.concatenate([np.diff(p[2]) for p in pieces])
        first = np.concatenate([[0], np.cumsum(lengths)])
        known, at, place, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        counts = np.bincount(place, np.repeat(~held, lengths), len(known)).astype(np.uint32)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([uuid.uuid4().int >> 65], pa.int64()), "doc_id": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), "held_out": pa.array([held.tolist()], pa.list_(pa.bool_())),
            "first": pa.array([first.tolist()], pa.list_(pa.int64())), "tokens": [np.concatenate([rank, rank[place]]).tobytes()],
            "hashes": [known.tobytes()], "counts": [counts.tobytes()], "endings": [endings[at].tobytes()],
        })


def _requests(bits: int):
    """The dictionaries cut by the leading bits of the hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, c, e in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                h, c, e = np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32), np.frombuffer(e, np.uint16)
                edges = np.searchsorted(h >> np.uint64(64 - bits), np.arange(2**bits + 1)) if bits else np.array([0, len(h)])
                rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if hi > lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int64())] + [pa.array([x[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()) for x in (h, c, e)],
                    names=["bucket", "part", "hashes", "counts", "endings"],
                )

    return cut


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts of each bucket's words: an answer for each part, and the bucket's own figures (part -1).

    The figures are the bucket's most frequent words with counts, and how many words have each ending.
    """
    for table in _groups(batches, ["bucket"]):
        bucket = table.column("bucket").to_numpy()
        edge = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            rows = table.slice(lo, hi - lo)
            blobs = [rows.column(c).to_pylist() for c in ("hashes", "counts", "endings")]
            hashes, counts, endings = (np.frombuffer(b"".join(b), t) for b, t in zip(blobs, (np.uint64, np.uint32, np.uint16)))
            known, at, place = np.unique(hashes, return_index=True, return_inverse=True)
            total = np.bincount(place, counts, len(known)).astype(np.uint64)
            answers = total[place]
            sizes = np.cumsum([0] + [len(h) // 8 for h in blobs[0]])
            top = np.argsort(-total.astype(np.int64), kind="stable")[: FREQUENT + 1]
            words = np.concatenate([np.bincount(endings[at][pick], minlength=ENDINGS) for pick in (total > 0, (total > 0) & (total < MIN_COUNT))])
            words = np.append(words, [total[total >= MIN_COUNT].sum(), total.sum()]).astype(np.int64)
            parts = rows.column("part").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*parts, -1], pa.int64()), pa.array([int(bucket[lo])] * (len(parts) + 1), pa.int32()),
                 pa.array([*(answers[a:b].tobytes() for a, b in zip(sizes[:-1], sizes[1:])), total[top].tobytes()], pa.binary()),
                 pa.array([*[b""] * len(parts), known[top].tobytes()], pa.binary()), pa.array([*[b""] * len(parts), words.tobytes()], pa.binary()),
                 pa.array([*[b""] * len(parts), endings[at][top].tobytes()], pa.binary())],
                names=["part", "bucket", "counts", "hashes", "words", "endings"],
            )


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each type, by exchanges that raise the likelihood of the class bigram model.

    ``bigrams[a, b]`` counts type b after type a. Types start in ``classes`` groups by frequency rank; each in turn,
    most frequent first, moves to the class where the likelihood is highest, until a pass moves none.
    """
    bigrams = bigrams.astype(np.float64)
    n_types = len(bigrams)
    freq = bigrams.sum(0)
    order = np.argsort(-freq, kind="stable")
    of = np.empty(n_types, np.int64)
    of[order] = np.arange(n_types) % classes
    member = np.zeros((n_types, classes))
    member[np.arange(n_types), of] = 1.0
    table, size = member.T @ bigrams @ member, member.T @ freq
    for _ in range(passes):
        moved = 0
        for t in order[freq[order] > 0]:
            row, col, own, old = bigrams[t] @ member, bigrams[:, t] @ member, bigrams[t, t], of[t]
            row[old] -= own
            col[old] -= own
            table[old, :] -= row
            table[:, old] -= col
            table[old, old] -= own
            size[old] -= freq[t]
            diagonal = table.diagonal()
            gain = (_xlogx(table + row[None, :]) - _xlogx(table)).sum(1) + (_xlogx(table + col[:, None]) - _xlogx(table)).sum(0)
            gain += _xlogx(diagonal + row + col + own) - _xlogx(diagonal + row) - _xlogx(diagonal + col) + _xlogx(diagonal)
            gain -= 2.0 * (_xlogx(size + freq[t]) - _xlogx(size))
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else int(old)
            table[new, :] += row
            table[:, new] += col
            table[new, new] += own
            size[new] += freq[t]
            if new != old:
                member[t, old], member[t, new], of[t] = 0.0, 1.0, new
                moved += 1
        if not moved:
            break
    return of


class _Part:
    """A part's dictionary and tokens with the answers for its words."""

    def __init__(self, row: dict, top_hashes: np.ndarray):
        self.part, self.doc_id, self.held_out, self.first = row["part"], row["doc_id"], np.array(row["held_out"], bool), np.array(row["first"], np.int64)
        self.hashes, self.endings = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["endings"], np.uint16).astype(np.int64)
        self.counts = np.frombuffer(_joined(row["replies"], "counts"), np.uint64)
        raw = np.frombuffer(row["tokens"], np.uint32)
        word = np.empty(len(self.hashes), np.int64)
        word[raw[: len(word)]] = np.arange(len(word))
        self.tokens = word[raw[len(word) :]]
        at = np.minimum(np.searchsorted(top_hashes, self.hashes), max(len(top_hashes) - 1, 0))
        self.top = np.where(top_hashes[at] == self.hashes, at, -1) if len(top_hashes) else np.full(len(self.hashes), -1)
        self.movable = np.flatnonzero((self.top < 0) & (self.counts >= MIN_COUNT))
        self.chosen = np.frombuffer(_joined(row["chosen"], "classes"), np.uint8)[ENDINGS:] if row.get("chosen") else None

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], top_hashes: np.ndarray) -> Iterator[_Part]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield cls(batch.slice(i, 1).to_pylist()[0], top_hashes)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Dictionary places of the neighbours in training documents; a document's first word follows an end."""
        after = self.tokens[np.repeat(~self.held_out, np.diff(self.first))]
        return np.roll(after, 1), after

    def classes(self, top_class: np.ndarray, of_ending: np.ndarray) -> np.ndarray:
        """Class of each dictionary word."""
        of = of_ending[self.endings]
        is_top = self.top >= 0
        of[is_top] = top_class[self.top[is_top]]
        if self.chosen is not None:
            of[self.movable] = self.chosen
        return of


def _joined(answers: list[dict], name: str) -> bytes:
    return b"".join(a[name] for a in sorted(answers, key=lambda a: a["bucket"]))


class _State(NamedTuple):
    """Classes of the words of each part (None: those of their endings), classes of endings, words of each class."""

    classes: DataFrame | None
    endings: np.ndarray
    words: np.ndarray


def _square(pairs: DataFrame, n: int) -> np.ndarray:
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most n * n rows
    out = np.zeros(n * n)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n, n)


def _class_pairs(top_hashes: np.ndarray, top_class: np.ndarray, of_ending: np.ndarray, classes: int):
    """Bigrams of classes in the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for part in _Part.of(batches, top_hashes):
            of = part.classes(top_class, of_ending)
            before, after = part.bigrams()
            total += np.bincount(of[before] * classes + of[after], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return count


def _has_turn(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Which words may move in pass ``turn``: one half in even passes, the other in odd ones."""
    return (mix(hashes) & np.uint64(1)) == np.uint64(turn % 2)


def _contexts(top_hashes: np.ndarray, top_class: np.ndarray, of_ending: np.ndarray, classes: int, bits: int, turn: int):
    """Sparse counts of the classes right (codes from 0) and left (from ``classes``) of each word that may move, and of itself.

    The endings of the rarer words count as words, too; they stand before the first bucket's. Words whose turn it is not
    have no counts.
    """
    n_codes = 2 * classes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _Part.of(batches, top_hashes):
            of = part.classes(top_class, of_ending)
            target = np.where(part.top >= 0, -1, part.endings)
            target[part.movable] = ENDINGS + np.arange(len(part.movable))
            hashes = np.concatenate([np.arange(ENDINGS, dtype=np.uint64), part.hashes[part.movable]])
            target[~np.append(_has_turn(hashes, turn), False)[target]] = -1  # the last place stands for no target
            before, after = part.bigrams()
            x, y = target[before], target[after]
            right, left, own = x >= 0, y >= 0, (x == y) & (x >= 0)
            keys = np.concatenate([x[right] * n_codes + of[after[right]], y[left] * n_codes + classes + of[before[left]], y[own] * n_codes + 2 * classes])
            keys, n = np.unique(keys, return_counts=True)
            codes, n = (keys % n_codes).astype(np.uint16), n.astype(np.uint32)
            lengths = np.bincount(keys // n_codes, minlength=ENDINGS + len(part.movable)).astype(np.uint32)
            old = np.concatenate([of_ending, of[part.movable]]).astype(np.uint8)
            edges = np.searchsorted(hashes[ENDINGS:] >> np.uint64(64 - bits), np.arange(2**bits + 1)) if bits else np.array([0, len(part.movable)])
            edges = edges + ENDINGS
            edges[0] = 0
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            rows = [(b, lo, hi, ends[lo], ends[hi]) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if hi > lo]
            blobs = [[x[lo:hi].tobytes() for _, lo, hi, _, _ in rows] for x in (hashes, old, lengths)] + [[x[p:q].tobytes() for _, _, _, p, q in rows] for x in (codes, n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([part.part] * len(rows), pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)],
                names=["bucket", "part", "hashes", "old", "lengths", "codes", "counts"],
            )

    return count


def _reassign(table: np.ndarray, classes: int, turn: int):
    """New classes for each part's words of a bucket, and (part -1) how many words each class has and the endings' classes."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["bucket"]):
            bucket = rows.column("bucket").to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                yield from one(rows.slice(lo, hi - lo), int(bucket[lo]))

    def one(rows: pa.Table, bucket: int) -> Iterator[pa.RecordBatch]:
        blobs = {c: rows.column(c).to_pylist() for c in ("hashes", "old", "lengths", "codes", "counts")}
        hashes, old, lengths, codes, counts = (np.frombuffer(b"".join(blobs[c]), t) for c, t in zip(blobs, (np.uint64, np.uint8, np.uint32, np.uint16, np.uint32)))
        known, at, place = np.unique(hashes, return_index=True, return_inverse=True)
        of = old[at].astype(np.int64)
        n_codes = 2 * classes + 1
        turns = _has_turn(known, turn)
        moving = np.flatnonzero(turns)  # the others have no contexts
        keys = np.repeat((np.cumsum(turns) - 1)[place], lengths) * n_codes + codes
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[edge], np.add.reduceat(counts, edge, dtype=np.float64) if len(edge) else np.zeros(0)
        begin = np.searchsorted(keys, np.arange(len(moving) + 1) * n_codes)
        lo = 0
        while lo < len(moving):  # blocks of words of a bounded number of context entries
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + BLOCK, "right")) - 1)
            dense = np.zeros((hi - lo) * n_codes)
            dense[keys[begin[lo] : begin[hi]] - lo * n_codes] = counts[begin[lo] : begin[hi]]
            dense = dense.reshape(-1, n_codes)
            block = moving[lo:hi]
            of[block] = best_classes(table, dense[:, :classes], dense[:, classes:-1], dense[:, -1], of[block])
            lo = hi
        new = of.astype(np.uint8)
        sizes = np.cumsum([0] + [len(h) // 8 for h in blobs["hashes"]])
        answers = new[place]
        is_ending = known < ENDINGS
        words = np.bincount(of[~is_ending], minlength=classes).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*rows.column("part").to_pylist(), -1], pa.int64()), pa.array([bucket] * (rows.num_rows + 1), pa.int32()),
             pa.array([*(answers[a:b].tobytes() for a, b in zip(sizes[:-1], sizes[1:])), new[is_ending].tobytes()], pa.binary()),
             pa.array([*[b""] * rows.num_rows, words.tobytes()], pa.binary())],
            names=["part", "bucket", "classes", "words"],
        )

    return choose


def best_classes(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The class where the likelihood is highest for each word alone, all others staying.

    ``right[w, c]`` counts class c after word w, ``left[w, c]`` before it, ``own[w]`` the word after itself (which
    the class counts hold, too); ``table`` the class bigrams.
    """
    words, classes = right.shape
    every = np.arange(words)
    freq = left.sum(1)
    logs = _xlogx(table)
    right, left = right.copy(), left.copy()
    right[every, old] -= own
    left[every, old] -= own

    def side(table: np.ndarray, logs: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """What the entries of ``near`` gain in each class; table[k, j] of class k and neighbour class j, ``logs`` its x log x."""
        w, j = np.nonzero(near)
        n, o, entry = near[w, j], old[w], np.arange(len(w))
        held, before = table.T[j], logs.T[j]
        held[entry, o] -= n
        before[entry, o] = _xlogx(held[entry, o])
        loop = np.flatnonzero(j == o)  # neighbours in the word's own class: the other side has gone from there
        held[loop] -= far[w[loop]]
        held[loop, o[loop]] -= own[w[loop]]
        before[loop] = _xlogx(held[loop])
        rise = _xlogx(held + n[:, None]) - before
        out = np.zeros((words, classes))
        has = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
        if len(has):
            out[w[has]] = np.add.reduceat(rise, has)
        return out

    gain = side(table, logs, right, left) + side(table.T, logs.T, left, right)
    held = np.repeat(table.diagonal()[None, :], words, 0)
    held[every, old] -= right[every, old] + left[every, old] + own
    gain += _xlogx(held + right + left + own[:, None]) - _xlogx(held + right) - _xlogx(held + left) + _xlogx(held)
    size = np.repeat(table.sum(0)[None, :], words, 0)
    size[every, old] -= freq
    gain -= 2.0 * (_xlogx(size + freq[:, None]) - _xlogx(size))
    best = gain.argmax(1)
    return np.where(gain[every, best] > gain[every, old] + 1e-9, best, old)


def _likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the class bigram model, but for what does not depend on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _next_state(chosen: DataFrame, rare: np.ndarray, top_class: np.ndarray, classes: int) -> _State:
    figures = chosen.where("part = -1")
    of_ending = np.frombuffer(figures.where("bucket = 0").first()["classes"], np.uint8).astype(np.int64)
    counted = figures.mapInArrow(_class_words, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    words = np.bincount(of_ending, rare, classes) + np.bincount(top_class, minlength=classes)
    for of, n in counted:
        words[of] += n
    dealt = chosen.where("part <> -1").groupBy("part").agg(F.collect_list(F.struct("bucket", "classes")).alias("chosen"))
    return _State(bucketed(dealt, "classes", "part"), of_ending, words)


def _class_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(batch.schema.get_field_index("words")).to_pylist():
            n = np.frombuffer(blob, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n)], names=["class", "n"])


def score_texts(docs: DataFrame, held_out_modulus: int = 7, held_out_rest: int = 2, classes: int = CLASSES, word_passes: int = WORD_PASSES, with_classes: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score[, classes]) for every row of ``docs``.

    Tokens are the words of the whole text (null: none), A-Z lower-cased, then one end. Training documents are those
    whose crc32(doc_id as text) modulo ``held_out_modulus`` is not ``held_out_rest`` (a null id: trained on).
    ``base_score`` is the add-one unigram log10 probability; ``score`` that of the class model, the product over tokens
    of P(class | class before) and (c + 1) / (tokens + words of the class + 1). The column ``classes`` has the class of
    each token; there are at most 256. Repeated rows each get a row (and count
    twice in training), an empty table gives none; other columns are not read. Words are told apart by 64-bit hashes.
    """
    if not 0 < classes <= 256:
        raise ValueError("classes must be from 1 to 256")
    spark = ready(docs.sparkSession)
    held = crc_of_id("doc_id", held_out_modulus) == held_out_rest
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    parts = bucketed(rows.mapInArrow(_code, _PART), "coded", "part")

    entries = parts.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(entries / BUCKET_ENTRIES, 1)))))
    asked = parts.select("part", "hashes", "counts", "endings").mapInArrow(_requests(bits), "bucket int, part long, hashes binary, counts binary, endings binary")
    asked = asked.repartition(min(2**bits, 4096), "bucket").sortWithinPartitions("bucket", "part")
    answers = staged(asked.mapInArrow(_count, "part long, bucket int, counts binary, hashes binary, words binary, endings binary"), "counts")

    figures = answers.where("part = -1")
    tops = figures.mapInArrow(_unpack, "hash long, n long, ending int").orderBy(F.desc("n"), "hash").limit(FREQUENT + 1).collect()
    frequent = sorted((int(np.int64(r[0]).view(np.uint64)), r[1], r[2]) for r in tops if r[1] > 0)
    top_hashes = np.array([f[0] for f in frequent], np.uint64)
    by_ending = figures.mapInArrow(_ending_counts, "ending int, n long").groupBy("ending").agg(F.sum("n").alias("n")).collect()
    words = np.zeros(2 * ENDINGS + 2, np.int64)
    for ending, n in by_ending:
        words[ending] = n
    words, rare, (covered, tokens) = words[:ENDINGS], words[ENDINGS:-2], words[-2:].tolist()
    clustered = covered > 0
    _log.info("words of %d occurrences and more cover %.4f of %d training tokens", MIN_COUNT, covered / max(tokens, 1), tokens)
    for _, n, ending in frequent:  # the most frequent words are clustered whatever their count
        rare[ending] -= n < MIN_COUNT
    words_of_type = np.concatenate([words, np.ones(len(frequent), np.int64)])
    for _, _, ending in frequent:
        words_of_type[ending] -= 1
    n_types, vocabulary = len(words_of_type), int(words.sum())

    replies = bucketed(answers.where("part <> -1").groupBy("part").agg(F.collect_list(F.struct("bucket", "counts")).alias("replies")), "replies", "part")
    coded = parts.join(replies.hint("shuffle_hash"), "part")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_types * n_types, np.int64)
        for part in _Part.of(batches, top_hashes):
            types = np.where(part.top >= 0, ENDINGS + part.top, part.endings)
            before, after = part.bigrams()
            total += np.bincount(types[before] * n_types + types[after], minlength=len(total))
        for lo in range(0, len(total), 64 * n_types):  # rows of the table in pieces
            at = np.flatnonzero(total[lo : lo + 64 * n_types])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at + lo), pa.array(total[at + lo])], names=["pair", "n"])

    bigrams = _square(coded.mapInArrow(pairs, "pair long, n long"), n_types)
    train_tokens = int(bigrams.sum())
    of_type = exchange_classes(bigrams, classes)
    top_class = of_type[ENDINGS:]
    state = _State(None, of_type[:ENDINGS], np.bincount(of_type, words_of_type, classes))

    # every other word of MIN_COUNT occurrences, and the endings of what is left, change classes in passes over the parts
    context_bits = max(0, int(np.ceil(np.log2(max(entries / CONTEXT_ENTRIES, 1)))))
    met, table = coded, None
    for n in range(word_passes + 1):
        met = coded if state.classes is None else coded.join(state.classes.hint("shuffle_hash"), "part", "left")
        moved = _square(met.mapInArrow(_class_pairs(top_hashes, top_class, state.endings, classes), "pair long, n long"), classes)
        _log.info("word pass %d: log-likelihood %.6f a training token", n, _likelihood(moved) / max(train_tokens, 1))
        if table is not None and _likelihood(moved) <= _likelihood(table):
            state, met = before_last
            break
        table = moved
        if n == word_passes or not clustered:
            break
        sent = met.mapInArrow(_contexts(top_hashes, top_class, state.endings, classes, context_bits, n), "bucket int, part long, hashes binary, old binary, lengths binary, codes binary, counts binary")
        sent = sent.repartition(min(2**context_bits, 4096), "bucket").sortWithinPartitions("bucket", "part")
        path = shared_path(spark, "chosen")
        chosen = staged_at(sent.mapInArrow(_reassign(table, classes, n), "part long, bucket int, classes binary, words binary"), path)
        before_last = state, met
        state = _next_state(chosen, rare, top_class, classes)
        drop_staged(spark, path)  # the state is written

    member_words, table = state.words, table + _PRIOR
    moves = np.log10(table / table.sum(1, keepdims=True))
    spread = np.log10((table - _PRIOR).sum(0) + member_words + 1.0)
    step = (moves - spread[None, :]).ravel()  # a token's transition and the denominator of its emission
    base = float(np.log10(train_tokens + vocabulary + 1.0))
    endings = state.endings
    at_end = np.searchsorted(top_hashes, END_WORD)
    start = int(top_class[at_end]) if END_WORD in top_hashes else int(endings[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _Part.of(batches, top_hashes):
            of = part.classes(top_class, endings)[part.tokens]
            begin = part.first[:-1]
            before = np.roll(of, 1)
            before[begin] = start
            n = np.diff(part.first)
            logs = np.add.reduceat(np.log10(part.counts + 1.0)[part.tokens], begin)
            gained = np.add.reduceat(step[before * classes + of], begin)
            known = np.add.reduceat((part.counts > 0)[part.tokens], begin, dtype=np.int64)
            arrays = [pa.array(part.doc_id, pa.int64()), pa.array(part.held_out), pa.array(n), pa.array(known),
                      pa.array(np.full(len(n), train_tokens, np.int64)), pa.array(logs - n * base), pa.array(logs + gained)]
            if with_classes:
                arrays.append(pa.ListArray.from_arrays(pa.array(part.first, pa.int32()), pa.array(of, pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + (", classes array<int>" if with_classes else "")
    return met.mapInArrow(score, schema)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, h, e in zip(*(batch.column(c).to_pylist() for c in ("counts", "hashes", "endings"))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(n, np.int64)), pa.array(np.frombuffer(e, np.uint16).astype(np.int32))],
                names=["hash", "n", "ending"],
            )


def _ending_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * ENDINGS + 2, np.int64)
    for batch in batches:
        for w in batch.column(batch.schema.get_field_index("words")).to_pylist():
            total += np.frombuffer(w, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["ending", "n"])
