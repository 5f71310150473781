"""Exact repeats across documents: maximal repeat groups from an enhanced suffix array.

A repeat has at least ``MIN_LENGTH`` bytes. Each window of that many bytes has a minimizer, the k-gram of least hash in
it, which depends on the window alone; windows of neighbouring starts with one minimizer form a stretch. All copies of
a window lie in stretches of the same minimizer, so the suffix array is dealt by minimizer: a task has every suffix
that can share MIN_LENGTH bytes with another one of the task. There suffixes are sorted, neighbours' common prefixes
measured, and a stack scan walks the tree of common-prefix intervals. An interval of two documents or more is a
group if the bytes before its occurrences differ or a stretch begins there; its occurrences are all its suffixes.
Long repeats come out as overlapping groups, one for each stretch that they cross.

Removal needs no groups, only the first document of each window. A key of more than HOT stretches is therefore not
sorted for it: each part sends the fingerprints of the key's distinct windows, dealt by fingerprint, with their
smallest document, and gets back which of them start in an earlier document elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_duplicates import _groups
from .shingles import inverse_powers, mix, powers, text_bytes
from .staging import bucketed, ready, staged

MIN_LENGTH = 50
GRAM = 20
SPAN = MIN_LENGTH - GRAM + 1  # k-grams of a window
#: Bytes that are hashed at a time; longer texts are cut, with an overlap that leaves every window in one cut.
CUT = 1 << 18
#: Suffixes that are sorted at a time (more only for one key); minimizers, and stretches, of one bucket.
SUFFIXES = 1 << 18
BUCKET_KEYS, BUCKET_STRETCHES = 1 << 21, 1 << 18
#: Stretches of one key from which remove_repeats deals its windows by their own hash; windows of one bucket.
HOT, BUCKET_WINDOWS = SUFFIXES // SPAN, 1 << 20
_PLACE = np.uint64(24)
_IN_CUT = np.uint64((1 << 24) - 1)
#: Most partitions of a shuffle by bucket; a task takes its buckets one after another.
TASKS = 1 << 15
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_ROW = "part long, doc_id array<long>, length array<long>, text binary, copies binary, n_keys long, n_stretches long, keys binary, flags binary, times binary, places binary"
_STRETCHES = ["n_keys", "n_stretches", "keys", "times", "places"]


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window start, number of windows) of each stretch of the texts laid end to end."""
    found = []
    for lo in range(0, max(len(data) - MIN_LENGTH + 1, 0), CUT):
        piece = data[lo : lo + CUT + MIN_LENGTH - 1]
        n = len(piece)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[piece] * powers(n), out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse_powers(n)[: n - GRAM + 1])
        low = ((grams >> _PLACE) << _PLACE) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:  # least value of each run of SPAN k-grams
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN:
            low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
        starts = np.arange(len(low), dtype=np.int64) + lo
        row = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + MIN_LENGTH <= offsets[row + 1]
        change = np.ones(len(low), bool)
        change[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        at = np.flatnonzero(change & inside)
        edge = np.flatnonzero(np.append(change | ~inside, True))
        n_windows = edge[np.searchsorted(edge, at, "right")] - at
        found.append((mix(grams[low[at] & _IN_CUT]), starts[at], n_windows))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, packed by their differences."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)), level=1)


def _keys_of(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unsqueeze(blob, (np.uint64, n))[0], dtype=np.uint64)


def _cuts(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets, by leading bits, that ascending hashes fall into."""
    if not len(hashes):
        return []
    bucket = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    edge = _edges(bucket)
    return list(zip(bucket[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()))


def _bits(entries: float, least: int = 0) -> int:
    """Leading bits that part this many entries into buckets of one."""
    return max(least, int(np.ceil(np.log2(max(entries, 1)))))


def _first_copies(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each text the row of the smallest id with the same text in this part."""
    first: dict[bytes, int] = {}
    for r in np.argsort(ids, kind="stable").tolist():
        first.setdefault(hashlib.sha256(data[offsets[r] : offsets[r + 1]]).digest(), r)
    return np.array([first[hashlib.sha256(data[offsets[r] : offsets[r + 1]]).digest()] for r in range(len(ids))], np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each batch of documents: packed texts, the row of the first copy of each, and the first copies' stretches.

    These are the distinct keys with a mark for those of two documents and how many stretches each has, and the start and
    number of windows of each stretch, by key.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys, starts, windows = stretches(data, offsets)
        copies = _first_copies(data, offsets, ids)
        row = np.searchsorted(offsets, starts, "right") - 1
        keep = copies[row] == row
        keys, starts, windows, row = keys[keep], starts[keep], windows[keep], row[keep]
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], row[order]
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(row, edge) != np.maximum.reduceat(row, edge) if len(edge) else np.zeros(0, bool)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([uuid.uuid4().int >> 65], pa.int64()),
            "doc_id": pa.array([ids.tolist()], pa.list_(pa.int64())), "length": pa.array([np.diff(offsets).tolist()], pa.list_(pa.int64())),
            "text": [zstandard.ZstdCompressor(1).compress(data.tobytes())], "copies": [copies.tobytes()],
            "n_keys": pa.array([len(edge)], pa.int64()), "n_stretches": pa.array([len(keys)], pa.int64()),
            "keys": [_pack_keys(keys[edge])], "flags": [np.packbits(several).tobytes()],
            "times": [_squeeze(np.diff(np.append(edge, len(keys))).astype(np.uint32))], "places": [_squeeze(starts[order].astype(np.uint32), windows[order].astype(np.uint8), level=1)],
        })


def _stretches_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a packed row, how many stretches each has, and start and number of windows of each stretch."""
    n, m = row["n_keys"], row["n_stretches"]
    times = _unsqueeze(row["times"], (np.uint32, n))[0]
    starts, windows = _unsqueeze(row["places"], (np.uint32, m), (np.uint8, m))
    return _keys_of(row["keys"], n), times, starts.astype(np.int64), windows.astype(np.int64)


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(row["length"])]).astype(np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    return data, offsets, np.array(row["doc_id"], np.int64)


def _squeeze(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays of numbers, like bytes of all numbers side by side, packed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level).compress(b"".join(planes))


def _unsqueeze(blob: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """Arrays of the given kinds and lengths."""
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _edges(column: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, column[1:] != column[:-1])), len(column))


def _ask(bits: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, blob, flags, times in zip(*(batch.column(i).to_pylist() for i in range(5))):
                keys = _keys_of(blob, n)
                times = _unsqueeze(times, (np.uint32, n))[0]
                flags = np.unpackbits(np.frombuffer(flags, np.uint8), count=n)
                rows = _cuts(keys, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([hi - lo for _, lo, hi in rows], pa.int64()),
                     pa.array([_pack_keys(keys[lo:hi]) for _, lo, hi in rows], pa.binary()),
                     pa.array([np.packbits(flags[lo:hi]).tobytes() for _, lo, hi in rows], pa.binary()), pa.array([_squeeze(times[lo:hi]) for _, lo, hi in rows], pa.binary())],
                    names=["bucket", "part", "n_keys", "keys", "flags", "times"],
                )

    return cut


def _answer(hot: int | None):
    """For each part's keys of a bucket whether two documents of the corpus have them, and the keys of more than ``hot`` stretches."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["bucket"]):
            edge = _edges(table.column("bucket").to_numpy())
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                rows = table.slice(lo, hi - lo)
                keys = [_keys_of(b, n) for b, n in zip(rows.column("keys").to_pylist(), rows.column("n_keys").to_pylist())]
                flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(k)) for f, k in zip(rows.column("flags").to_pylist(), keys)]
                times = [_unsqueeze(t, (np.uint32, len(k)))[0] for t, k in zip(rows.column("times").to_pylist(), keys)]
                known, place, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
                shared = (n > 1) | (np.bincount(place, np.concatenate(flags), len(n)) > 0)
                many = shared & (np.bincount(place, np.concatenate(times), len(n)) > (np.inf if hot is None else hot))
                cuts = np.cumsum([0] + [len(k) for k in keys])
                shared, many = (shared & ~many)[place], many[place]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("part").combine_chunks(), rows.column("bucket").combine_chunks(), pa.array([np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                     pa.array([k[many[a:b]].tobytes() for k, a, b in zip(keys, cuts[:-1], cuts[1:])], pa.binary())],
                    names=["part", "bucket", "flags", "hot"],
                )

    return answer


def _prints(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of data[starts : starts + size]; ``starts`` ascend. Done CUT bytes at a time."""
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CUT)))
        piece = data[starts[lo] : int((starts[hi - 1] + size[hi - 1]))]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LETTER[piece] * powers(len(piece)), out=sums[1:])
        at = starts[lo:hi] - starts[lo]
        out[lo:hi] = mix((sums[at + size[lo:hi]] - sums[at]) * inverse_powers(len(piece))[at] + size[lo:hi].astype(np.uint64))
        lo = hi
    return out


def _send(bits: int, out_bits: int):
    """The texts of stretches whose keys are shared, by key bucket; equal texts of a part once, with all places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known, times, starts, windows = _stretches_of(row)
                place = {b: (lo, hi) for b, lo, hi in _cuts(known, bits)}
                shared = np.zeros(len(known), bool)
                for answer in row["answers"] or []:
                    lo, hi = place[answer["bucket"]]
                    shared[lo:hi] = np.unpackbits(np.frombuffer(answer["flags"], np.uint8), count=hi - lo)
                if not shared.any():
                    continue
                pick = np.repeat(shared, times)
                keys, starts, windows = np.repeat(known[shared], times[shared]), starts[pick], windows[pick]
                data, offsets, ids = _texts(row)
                doc = np.searchsorted(offsets, starts, "right") - 1
                size = windows + MIN_LENGTH - 1
                ascending = np.argsort(starts)
                prints = np.empty(len(starts), np.uint64)
                prints[ascending] = _prints(data, starts[ascending], size[ascending])
                order = np.lexsort((ids[doc], prints, keys))
                keys, starts, size, doc, prints = keys[order], starts[order], size[order], doc[order], prints[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1]))
                for b, p, q in _cuts(keys, out_bits):
                    texts = np.flatnonzero(new[p:q]) + p
                    lengths = size[texts]
                    begin = np.cumsum(lengths) - lengths
                    index = np.repeat(starts[texts] - begin, lengths) + np.arange(lengths.sum())
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([b], pa.int32()), "part": pa.array([row["part"]], pa.int64()),
                        "n_texts": pa.array([len(texts)], pa.int64()), "n_places": pa.array([q - p], pa.int64()),
                        "body": [zstandard.ZstdCompressor(3).compress(data[index].tobytes())],
                        "texts": [_squeeze(np.diff(keys[texts], prepend=np.uint64(0)), lengths.astype(np.uint8), np.diff(np.append(texts, q)).astype(np.uint32))],
                        "places": [_squeeze(ids[doc[p:q]], doc[p:q].astype(np.uint32), starts[p:q] - offsets[doc[p:q]])],
                    })

    return send


_SENT = "bucket int, part long, n_texts long, n_places long, body binary, texts binary, places binary"
_FOUND = "part long, bucket int, group binary, row binary, doc binary, start binary, length binary, first_doc binary, n_docs binary"


def interval_groups(lcp: np.ndarray, before: np.ndarray, low: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of the common-prefix intervals of at least ``low`` whose left extensions differ.

    ``lcp[i]`` is the common prefix of sorted suffixes i-1 and i; ``before`` numbers the byte before each suffix,
    negative where a stretch begins, which always counts as different. A stack holds the open intervals with their
    left extension (or -1 once it has two), so each suffix is put on and taken off once.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # length, first, left extension
    for i in range(1, len(before) + 1):
        height = int(lcp[i]) if i < len(before) else 0
        height = height if height >= low else 0
        first, left = i - 1, int(before[i - 1])
        while stack and stack[-1][0] > height:
            length, first, seen = stack.pop()
            seen = seen if seen == left and seen >= 0 else -1
            if seen < 0:
                out.append((first, i - 1, length))
            left = seen
        if height:
            if stack and stack[-1][0] == height:
                stack[-1][2] = left if left == stack[-1][2] and left >= 0 else -1
            else:
                stack.append([height, first, left])
        elif not height:
            stack = []
    return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of each bucket with all their occurrences, dealt to the parts that have them."""
    for table in _groups(batches, ["bucket"]):
        edge = _edges(table.column("bucket").to_numpy())
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield from _match_bucket(table.slice(lo, hi - lo))


def _match_bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    part_ids, bucket = table.column("part").to_pylist(), table.column("bucket")[0].as_py()
    counts = list(zip(table.column("n_texts").to_pylist(), table.column("n_places").to_pylist()))
    texts = [_unsqueeze(t, (np.uint64, n), (np.uint8, n), (np.uint32, n)) for t, (n, _) in zip(table.column("texts").to_pylist(), counts)]
    places = [_unsqueeze(t, (np.int64, n), (np.uint32, n), (np.int64, n)) for t, (_, n) in zip(table.column("places").to_pylist(), counts)]
    keys = np.concatenate([np.cumsum(t[0], dtype=np.uint64) for t in texts])
    size, times = np.concatenate([t[1] for t in texts]).astype(np.int64), np.concatenate([t[2] for t in texts]).astype(np.int64)
    docs, rows, starts = (np.concatenate([p[i] for p in places]) for i in range(3))
    part = np.repeat(np.arange(len(places)), [len(p[0]) for p in places])
    body = np.frombuffer(b"".join(unpack.decompress(b) for b in table.column("body").to_pylist()), np.uint8)
    prints = _prints(body, np.cumsum(size) - size, size)
    begin = np.cumsum(size) - size
    # equal texts of different parts become one; places are sorted by text
    order = np.lexsort((size, prints, keys))
    new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (prints[order][1:] != prints[order][:-1]) | (size[order][1:] != size[order][:-1]))
    text_of = np.empty(len(order), np.int64)
    text_of[order] = np.cumsum(new) - 1
    kept = order[new]
    keys, size, begin = keys[kept], size[kept], begin[kept]
    of_place = np.repeat(text_of, times)
    sort = np.lexsort((starts, docs, of_place))
    of_place, docs, part, rows, starts = of_place[sort], docs[sort], part[sort], rows[sort], starts[sort]
    place = np.append(np.searchsorted(of_place, np.arange(len(keys))), len(of_place))
    low_doc, high_doc = docs[place[:-1]], docs[place[1:] - 1]
    group_edge = _edges(keys)
    n_texts = np.diff(group_edge)
    several = np.minimum.reduceat(low_doc, group_edge[:-1]) != np.maximum.reduceat(high_doc, group_edge[:-1])
    # (text, offset, length) lists of groups; a text alone in its key repeats as a whole
    alone = group_edge[:-1][several & (n_texts == 1)]
    member, shift, group, length = [alone], [np.zeros(len(alone), np.int64)], [np.arange(len(alone))], [size[alone]]
    n_groups = len(alone)
    mixed = np.repeat(several & (n_texts > 1), n_texts)
    texts = np.flatnonzero(mixed)
    # suffixes of the other texts in runs of bounded size that do not cut a key
    windows = size[texts] - MIN_LENGTH + 1
    total = np.cumsum(windows)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SUFFIXES, "right"))
        hi = max(hi, lo + 1)
        while hi < len(texts) and keys[texts[hi]] == keys[texts[hi - 1]]:
            hi += 1
        m, s, g, n = _suffix_groups(body, begin[texts[lo:hi]], size[texts[lo:hi]], keys[texts[lo:hi]], low_doc[texts[lo:hi]], high_doc[texts[lo:hi]])
        member.append(texts[lo:hi][m])
        shift.append(s)
        group.append(g + n_groups)
        length.append(n)
        n_groups += int(g.max()) + 1 if len(g) else 0
        lo = hi
    member, shift, group, length = (np.concatenate(x) for x in (member, shift, group, length))
    if not len(member):
        return
    # all places of the members
    n = place[member + 1] - place[member]
    at = np.repeat(place[member] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    group, length, shift = np.repeat(group, n), np.repeat(length, n), np.repeat(shift, n)
    sort = np.lexsort((docs[at], group))
    at, group, length, shift = at[sort], group[sort], length[sort], shift[sort]
    edge = _edges(group)
    first = np.repeat(docs[at][edge[:-1]], np.diff(edge))
    different = np.append(True, (group[1:] != group[:-1]) | (docs[at][1:] != docs[at][:-1]))
    n_docs = np.repeat(np.add.reduceat(different.astype(np.int64), edge[:-1]), np.diff(edge))
    by_part = np.argsort(part[at], kind="stable")
    cuts = np.searchsorted(part[at][by_part], np.arange(len(part_ids) + 1))
    for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if b > a:
            pick = by_part[a:b]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part_ids[p]], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "group": [group[pick].astype(np.uint32).tobytes()],
                "row": [rows[at[pick]].tobytes()], "doc": [docs[at[pick]].tobytes()], "start": [(starts[at[pick]] + shift[pick]).astype(np.int64).tobytes()],
                "length": [length[pick].astype(np.uint8).tobytes()], "first_doc": [first[pick].tobytes()], "n_docs": [n_docs[pick].astype(np.uint32).tobytes()],
            })


def _suffix_groups(body: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray, low_doc: np.ndarray, high_doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, offset, group, length) of the members of the groups among the suffixes of the given texts."""
    windows = size - MIN_LENGTH + 1
    text = np.repeat(np.arange(len(size)), windows)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    left = size[text] - offset  # bytes of each suffix
    n_words = (MIN_LENGTH + SPAN + 7) // 8 + 1
    # a matrix of texts, bytes raised by one so that the filling is below all of them (UTF-8 has no FF)
    wide = np.zeros((len(size), 8 * n_words + 8 + SPAN), np.uint8)
    column = np.arange(int(size.max()))
    inside = column[None, :] < size[:, None]
    wide[:, : len(column)][inside] = body[(begin[:, None] + column[None, :])[inside]] + np.uint8(1)
    base = np.lib.stride_tricks.sliding_window_view(wide, 8, axis=1)
    words = [np.ascontiguousarray(base[text, offset + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(n_words)]
    order = np.lexsort((offset, text, *reversed(words), keys[text]))
    text, offset, left = text[order], offset[order], left[order]
    common = np.zeros(len(text), np.int64)
    going = np.ones(len(text), bool)
    going[0] = False
    same_key = keys[text][1:] == keys[text][:-1]
    going[1:] &= same_key
    for w in words:
        w = w[order]
        differ = np.zeros(len(w), np.uint64)
        differ[1:] = w[1:] ^ w[:-1]
        equal = going & (differ == 0)
        common[equal] += 8
        stop = np.flatnonzero(going & (differ != 0))
        if len(stop):
            # leading zero bytes of the difference
            spread = differ[stop].astype(">u8").view(np.uint8).reshape(-1, 8) != 0
            common[stop] += spread.argmax(1)
        going = equal
    common[1:] = np.minimum(common[1:], np.minimum(left[1:], left[:-1]))
    common[0] = 0
    before = np.where(offset > 0, wide[text, np.maximum(offset - 1, 0)].astype(np.int64), -1)
    # intervals of MIN_LENGTH; only those of two documents whose left extensions differ can hold groups
    edge = np.append(np.flatnonzero(common < MIN_LENGTH), len(text))
    first, last = edge[:-1], edge[1:]
    lows, highs = np.minimum.reduceat(low_doc[text], first), np.maximum.reduceat(high_doc[text], first)
    least, most = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    live = (lows != highs) & ((least < 0) | (least != most))
    out_text, out_offset, out_group, out_length, n_groups = [], [], [], [], 0

    def add(members: np.ndarray, length: int) -> None:
        nonlocal n_groups
        if low_doc[text[members]].min() == high_doc[text[members]].max():
            return
        out_text.append(text[members])
        out_offset.append(offset[members])
        out_group.append(np.full(len(members), n_groups))
        out_length.append(np.full(len(members), length))
        n_groups += 1

    for a, b in zip(first[live].tolist(), last[live].tolist()):
        if b - a == 1:
            add(np.array([a]), int(left[a]))
            continue
        heights = common[a:b].copy()
        heights[0] = 0
        for p, q, length in interval_groups(heights, before[a:b], MIN_LENGTH):
            add(np.arange(a + p, a + q + 1), length)
        # a text of several documents repeats to its end, beyond what it shares with its neighbours
        beyond = np.maximum(heights, np.append(heights[1:], 0))
        for r in np.flatnonzero((left[a:b] > beyond) & (before[a:b] < 0)).tolist():
            add(np.array([a + r]), int(left[a + r]))
    if not out_text:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in (out_text, out_offset, out_group, out_length))


def _parts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return bucketed(rows.mapInArrow(_pack, _ROW), "packed", "part")


def _hot_windows(row: dict, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the stretches of a row's hot keys: (distinct fingerprints, smallest id of each; start and number of each window)."""
    keys, times, starts, windows = _stretches_of(row)
    pick = np.repeat(np.isin(keys, np.frombuffer(row["hot"], np.uint64)), times)
    starts, windows = starts[pick], windows[pick]
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    at.sort()
    prints, place = np.unique(_prints(data, at, np.full(len(at), MIN_LENGTH)), return_inverse=True)
    least = np.full(len(prints), np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids[np.searchsorted(offsets, at, "right") - 1])
    return prints, least, at, place


def _ask_windows(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                prints, least, _, _ = _hot_windows(row, *_texts(row))
                rows = _cuts(prints, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([row["part"]] * len(rows), pa.int64()), *(pa.array([x[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()) for x in (prints, least))],
                    names=["bucket", "part", "prints", "least"],
                )

    return ask


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part's windows of a bucket whether another part has them in a document of a smaller id."""
    for table in _groups(batches, ["bucket"]):
        edge = _edges(table.column("bucket").to_numpy())
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            rows = table.slice(lo, hi - lo)
            blobs = [rows.column(c).to_pylist() for c in ("prints", "least")]
            prints, least = (np.frombuffer(b"".join(b), k) for b, k in zip(blobs, (np.uint64, np.int64)))
            known, place = np.unique(prints, return_inverse=True)
            first = np.full(len(known), np.iinfo(np.int64).max)
            np.minimum.at(first, place, least)
            earlier = first[place] < least
            cuts = np.cumsum([0] + [len(b) // 8 for b in blobs[0]])
            yield pa.RecordBatch.from_arrays(
                [rows.column("part").combine_chunks(), rows.column("bucket").combine_chunks(), pa.array([earlier[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                names=["part", "bucket", "earlier"],
            )


def _hot_marks(parts: DataFrame, answers: DataFrame) -> DataFrame | None:
    """For each part with hot keys: these, and for its windows whether they start in an earlier document of another part."""
    hot = answers.where("octet_length(hot) > 0")
    n_parts = hot.select("part").distinct().count()
    if not n_parts:
        return None

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(k) for k in batch.column(1).to_pylist()], pa.binary())], names=["part", "hot"])

    keys = staged(hot.groupBy("part").agg(F.collect_list("hot").alias("hot")).mapInArrow(join, "part long, hot binary"), "hot")
    met = parts.select("part", "doc_id", "length", "text", *_STRETCHES).join(keys.hint("shuffle_hash"), "part")
    # a part has at most one window for each byte
    n_windows = parts.join(keys, "part", "left_semi").agg(F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0]
    bits = _bits(n_windows / BUCKET_WINDOWS)
    asked = met.mapInArrow(_ask_windows(bits), "bucket int, part long, prints binary, least binary")
    asked = asked.repartition(min(2**bits, TASKS), "bucket").sortWithinPartitions("bucket", "part")
    said = staged(asked.mapInArrow(_answer_windows, "part long, bucket int, earlier binary"), "windows")
    said = said.groupBy("part").agg(F.collect_list(F.struct("bucket", "earlier")).alias("marks"))
    return keys.join(said.hint("shuffle_hash"), "part")


def _occurrences(parts: DataFrame, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blobs of occurrences by part and bucket, and the answers for the keys; keys of more than ``hot`` stretches are left to :func:`_hot_marks`."""
    total = parts.agg(F.sum("n_keys")).first()[0] or 0
    bits = _bits(total / BUCKET_KEYS)
    asked = parts.select("part", "n_keys", "keys", "flags", "times").mapInArrow(_ask(bits), "bucket int, part long, n_keys long, keys binary, flags binary, times binary")
    asked = asked.repartition(min(2**bits, TASKS), "bucket").sortWithinPartitions("bucket", "part")
    said = staged(asked.mapInArrow(_answer(hot), "part long, bucket int, flags binary, hot binary"), "shared")
    answers = said.groupBy("part").agg(F.collect_list(F.struct("bucket", "flags")).alias("answers"))
    out_bits = _bits(total / BUCKET_STRETCHES / 4, 2)
    met = parts.select("part", "doc_id", "length", "text", *_STRETCHES).join(answers.hint("shuffle_hash"), "part", "left")
    sent = met.mapInArrow(_send(bits, out_bits), _SENT).repartition(min(2**out_bits, TASKS), "bucket").sortWithinPartitions("bucket", "part")
    return staged(sent.mapInArrow(_match, _FOUND), "repeats"), said


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(group_id, doc_id, start, length, first_doc, n_docs): every occurrence of every repeat group of two documents.

    ``start`` and ``length`` are bytes of the UTF-8 text; ``first_doc`` is the smallest doc_id of the group. Exact copies
    inside a part of the table are represented by the one of the smallest id. All stretches of one minimizer meet in one
    task here, without a bound. Null texts are empty, rows without
    a doc_id are left out, an empty table gives no rows; other columns are not read.
    """
    ready(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "group", "doc", "start", "length", "first_doc", "n_docs"))):
                kinds = (np.uint32, np.int64, np.int64, np.uint8, np.int64, np.uint32)
                group, doc, start, length, first, n = (np.frombuffer(b, k).astype(np.int64) for b, k in zip(blobs, kinds))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((bucket << 32) + group, doc, start, length, first, n)], names=["group_id", "doc_id", "start", "length", "first_doc", "n_docs"])

    return _occurrences(_parts(docs))[0].mapInArrow(rows, "group_id long, doc_id long, start long, length long, first_doc long, n_docs long")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) for every row with a doc_id.

    Each byte goes that lies in a string of MIN_LENGTH bytes which also starts in a document of a smaller doc_id,
    judged on the whole input. Null texts are empty; rows that repeat a doc_id are one document for this purpose and
    keep their bytes against each other, except that exact copies in one part follow the first. An empty table gives
    no rows; other columns are not read. ``kept_text`` may hold cut characters, as bytes.
    """
    ready(docs.sparkSession)
    parts = _parts(docs)
    spans, answers = _occurrences(parts, HOT)
    marks = _hot_marks(parts, answers)
    names = ["row", "start", "length", "first_doc", "doc"]
    spans = spans.groupBy("part").agg(F.collect_list(F.struct(*names)).alias("spans"))
    met = parts.select("part", "doc_id", "length", "text", "copies", *([] if marks is None else _STRETCHES)).join(spans.hint("shuffle_hash"), "part", "left")
    if marks is not None:
        met = met.join(marks.hint("shuffle_hash"), "part", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                data, offsets, ids = _texts(part)
                delta = np.zeros(len(data) + 1, np.int32)
                for span in part["spans"] or []:
                    row, start, length, first, doc = (np.frombuffer(span[n], k) for n, k in zip(names, (np.uint32, np.int64, np.uint8, np.int64, np.int64)))
                    earlier = first < doc
                    at = offsets[row[earlier]] + start[earlier]
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + length[earlier], -1)
                if part.get("marks"):
                    _, least, at, place = _hot_windows(part, data, offsets, ids)
                    earlier = np.frombuffer(b"".join(m["earlier"] for m in sorted(part["marks"], key=lambda m: m["bucket"])), bool)
                    at = at[earlier[place] | (least[place] < ids[np.searchsorted(offsets, at, "right") - 1])]
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + MIN_LENGTH, -1)
                gone = np.cumsum(delta[:-1]) > 0
                copies = np.frombuffer(part["copies"], np.int64)
                out = []
                for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    if b - a >= MIN_LENGTH and ids[copies[r]] < ids[r]:
                        out.append((int(ids[r]), b - a, b - a, 1, b""))
                        continue
                    own = gone[offsets[copies[r]] : offsets[copies[r] + 1]]
                    removed = int(own.sum())
                    n_spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
                    out.append((int(ids[r]), b - a, removed, n_spans, data[a:b][~own].tobytes() if removed else data[a:b].tobytes()))
                columns = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array([hashlib.sha256(t).hexdigest() for t in columns[4]])]
                labels = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays, labels = [*arrays, pa.array(columns[4], pa.binary())], [*labels, "kept_text"]
                yield pa.RecordBatch.from_arrays(arrays, names=labels)

    return met.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if with_text else ""))
