"""Licence scan: matching statistics of whole texts against a generalised suffix automaton of template tokens.

All templates and phrases make one automaton over words. A text is streamed through it: at every word the automaton knows
the longest ending that occurs in some template. Phrases are read off the suffix links of the states; longer matches that
cannot be prolonged are chained, template by template, into the spans that cover enough of the template. Only stretches
whose neighbouring words are neighbours in some template reach the automaton, which changes no match of two or more words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import CHUNK_BYTES, row_chunks, text_bytes, word_hashes
from .staging import ready

#: A match counts from so many words (a shorter template has to match as a whole); a span covers this share of its
#: template; matches further apart than MAX_GAP words belong to different spans.
MIN_MATCH, MIN_SHARE, MAX_GAP = 4, 0.75, 100

# Base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices and conditions of public licences, as their publishers word them.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

#: Digits, letters (A-Z as a-z) and all bytes beyond ASCII make words; everything else parts them.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def tokens(text: str) -> list[str]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return _FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().decode().split()


@dataclass
class State:
    length: int = 0
    link: int = -1
    go: dict[int, int] = field(default_factory=dict)
    #: Places (template, end) at which the longest string of the state ends.
    ends: list[tuple[int, int]] = field(default_factory=list)
    #: Short templates that end here, with their lengths; those of the suffix links included.
    short: list[tuple[int, int]] = field(default_factory=list)
    templates: int = 0


class Automaton:
    """Generalised suffix automaton of token sequences, with the places of every state of MIN_MATCH words and more."""

    def __init__(self, sequences: list[list[int]], min_match: int = MIN_MATCH):
        self.states, self.sizes, self.min_match = [State()], [len(s) for s in sequences], min_match
        own: dict[int, list[tuple[int, int]]] = {}
        for t, sequence in enumerate(sequences):
            last = 0
            for end, token in enumerate(sequence):
                last = self._extend(last, token)
                own.setdefault(last, []).append((t, end))
        order = sorted(range(1, len(self.states)), key=lambda v: self.states[v].length)
        for v, places in own.items():
            self.states[v].ends.extend(places)
        for v in reversed(order):  # places go up the suffix links
            s = self.states[v]
            for t, _ in s.ends:
                s.templates |= 1 << t
            if s.link > 0:
                self.states[s.link].ends.extend(s.ends)
        for t, sequence in enumerate(sequences):
            if len(sequence) < min_match:
                v = 0
                for token in sequence:
                    v = self.states[v].go[token]
                self.states[v].short.append((t, len(sequence)))
        for v in order:
            s = self.states[v]
            s.short = sorted(s.short + (self.states[s.link].short if s.link > 0 else []))
            s.ends = sorted(set(s.ends)) if s.length >= min_match else []

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        if token in states[last].go:
            q = states[last].go[token]
            return q if states[q].length == states[last].length + 1 else self._clone(last, token, q)
        states.append(State(states[last].length + 1))
        new, p = len(states) - 1, last
        while p >= 0 and token not in states[p].go:
            states[p].go[token] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        else:
            q = states[p].go[token]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, token, q)
        return new

    def _clone(self, p: int, token: int, q: int) -> int:
        states = self.states
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].go)))
        clone = len(states) - 1
        states[q].link = clone
        while p >= 0 and states[p].go.get(token) == q:
            states[p].go[token] = clone
            p = states[p].link
        return clone

    def scan(self, ids: list[int], at: int, found: Found) -> None:
        """Stream the words ``ids`` (the first is number ``at`` of its text) and report whole short templates and long matches."""
        states, v, length = self.states, 0, 0
        for i, token in enumerate(ids, at):
            was, had = v, length
            while v and token not in states[v].go:
                v = states[v].link
                length = states[v].length
            v = states[v].go.get(token, 0)
            length = length + 1 if v else 0
            if had >= self.min_match:
                gone = states[was].templates if length != had + 1 else states[was].templates & ~states[v].templates
                if gone:
                    found.match(i - 1, had, states[was].ends, gone)
            for t, size in states[v].short:
                if size <= length:
                    found.place(t, i - size + 1)
        if length >= self.min_match:
            found.match(at + len(ids) - 1, length, states[v].ends, states[v].templates)


class Chain:
    """Matches of one template in one text, chained by a programme over the template's words."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.covered = np.zeros(self.size, np.int64)
        self.start = np.zeros(self.size, np.int64)
        self.stop = np.full(self.size, -1, np.int64)
        self.best, self.last = -1, -1

    def add(self, end: int, length: int, ends: list[int]) -> None:
        """A match of ``length`` words up to ``end`` in the text, at each of ``ends`` in the template."""
        for e in reversed(ends):
            gain, start = min(length, e + 1), end - length + 1
            before = np.minimum(np.minimum(length, e - np.arange(e)), end - self.stop[:e]) if e else np.zeros(0, np.int64)
            total = np.where((self.stop[:e] >= 0) & (before > 0), self.covered[:e] + before, 0)
            if e and int(total.max()) > gain:
                j = int(total.argmax())
                gain, start = int(total[j]), int(self.start[j])
            if gain >= self.covered[e]:
                self.covered[e], self.start[e], self.stop[e] = gain, start, end
                if self.best < 0 or gain >= self.covered[self.best]:
                    self.best = e
        self.last = end

    def span(self) -> tuple[int, int, int] | None:
        """(first word, last word, words covered) of the best chain, if it covers enough of the template."""
        b = self.best
        if b < 0 or self.covered[b] < MIN_SHARE * self.size:
            return None
        return int(self.start[b]), int(self.stop[b]), int(self.covered[b])


class Found:
    """What one text holds: places of phrases and short templates, and spans of the longer ones."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.places, self.chains, self.spans = sizes, {}, {}, []

    def place(self, template: int, start: int) -> None:
        n, first, _ = self.places.get(template, (0, start, start))
        self.places[template] = (n + 1, first, start)

    def match(self, end: int, length: int, ends: list[tuple[int, int]], wanted: int) -> None:
        by: dict[int, list[int]] = {}
        for t, e in ends:
            if wanted >> t & 1:
                by.setdefault(t, []).append(e)
        for t, own in by.items():
            chain = self.chains.get(t) or self.chains.setdefault(t, Chain(self.sizes[t]))
            back = chain.best >= 0 and max(own) <= chain.best
            if chain.last >= 0 and (end - length + 1 - chain.last > MAX_GAP or (back and chain.span())):
                self.close(t, chain)
            chain.add(end, length, own)

    def close(self, template: int, chain: Chain) -> None:
        if (span := chain.span()) is not None:
            self.spans.append((template, *span))
        chain.clear()

    def result(self) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, words covered); of overlapping spans that which covers more words, then more of its template."""
        for t, chain in self.chains.items():
            self.close(t, chain)
        kept: list[tuple[int, int, int, int]] = []
        right: list[int] = []
        groups: list[list[tuple[int, int, int, int]]] = []
        for span in sorted(self.spans, key=lambda s: (s[1], s[2], s[0])):
            if groups and span[1] <= right[-1]:
                groups[-1].append(span)
                right[-1] = max(right[-1], span[2])
            else:
                groups.append([span])
                right.append(span[2])
        for group in groups:  # spans that touch one another; a few each
            taken: list[tuple[int, int, int, int]] = []
            for span in sorted(group, key=lambda s: (-s[3], -s[3] / self.sizes[s[0]], s[0], s[1])):
                if all(span[1] > t[2] or span[2] < t[1] for t in taken):
                    taken.append(span)
            kept.extend(sorted(taken, key=lambda s: s[1]))
        return kept


class Scanner:
    """Automaton and vocabulary of a set of templates; built once in each task."""

    def __init__(self, templates: list[tuple[str, str]], min_match: int):
        split = [tokens(text) for _, text in templates]
        self.vocabulary = sorted({w for s in split for w in s})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        sequences = [[number[w] for w in s] for s in split]
        joined = "".join(self.vocabulary).encode()
        offsets = np.concatenate([[0], np.cumsum([len(w.encode()) for w in self.vocabulary])]).astype(np.int64)
        hashes, _ = word_hashes(np.frombuffer(joined, np.uint8), offsets)
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.min_match = hashes[order], order.astype(np.int32), min_match
        n = len(self.vocabulary)
        #: Neighbours in some template, and in some template that is too short for a long match.
        self.pairs, self.short_pairs = np.zeros((n + 1, n + 1), bool), np.zeros((n + 1, n + 1), bool)
        self.single = np.zeros(n + 1, bool)
        for s in sequences:
            for a, b in zip(s, s[1:]):
                self.pairs[a, b] = True
                self.short_pairs[a, b] |= len(s) < min_match
            if len(s) == 1:
                self.single[s[0]] = True
        self.automaton = Automaton(sequences, min_match)

    def word_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word (that of the vocabulary's end for others) and the first word of each row."""
        hashes, first = word_hashes(_FOLD[data], offsets)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.numbers[at], len(self.vocabulary)).astype(np.int32), first

    def long_ids(self, data: np.ndarray) -> np.ndarray:
        """Words of one text in pieces of about CHUNK_BYTES that end between words."""
        out, start = [], 0
        while start < len(data):
            stop = min(len(data), start + CHUNK_BYTES)
            while stop < len(data) and _FOLD[data[stop]] != 32:
                stop += 1
            out.append(self.word_ids(data[start:stop], np.array([0, stop - start]))[0])
            start = stop
        return np.concatenate(out)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, Found]]:
        """(number of words, what was found) of each text."""
        data, offsets = text_bytes(column)
        for a, b in row_chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            if b - a == 1 and len(part) > CHUNK_BYTES:
                ids, first = self.long_ids(part), None
                first = np.array([0, len(ids)])
            else:
                ids, first = self.word_ids(part, offsets[a : b + 1] - offsets[a])
            yield from self.rows(ids, first)

    def rows(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, Found]]:
        linked = np.zeros(len(ids) + 1, bool)  # word i follows word i - 1 in some template
        short = np.zeros(len(ids) + 1, bool)
        if len(ids) > 1:
            linked[1:-1] = self.pairs[ids[:-1], ids[1:]]
            short[1:-1] = self.short_pairs[ids[:-1], ids[1:]]
        linked[first], short[first] = False, False
        begins = np.flatnonzero(~linked[:-1] & (linked[1:] | self.single[ids]))
        stops = np.flatnonzero(~linked)
        stops = stops[np.searchsorted(stops, begins + 1)]
        shorts = np.concatenate([[0], np.cumsum(short)])
        useful = (stops - begins >= self.min_match) | (shorts[stops] > shorts[begins]) | self.single[ids[begins]]
        begins, stops = begins[useful], stops[useful]
        bounds = np.searchsorted(begins, first)
        for r in range(len(first) - 1):
            found = Found(self.automaton.sizes)
            for a, b in zip(begins[bounds[r] : bounds[r + 1]].tolist(), stops[bounds[r] : bounds[r + 1]].tolist()):
                self.automaton.scan(ids[a:b].tolist(), a - int(first[r]), found)
            yield int(first[r + 1] - first[r]), found


SPANS = "array<struct<template int, label string, first_word long, last_word long, covered long, share double>>"
PLACES = "array<struct<label string, places long, first_word long, last_word long>>"


def scan_licences(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH, doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_words, phrases, spans) for every row of ``docs`` (``doc_id``, ``text``); no shuffle.

    ``phrases``: for each label of a phrase the number of its places, the first and the last (word numbers from 0).
    ``spans``: the stretches that cover MIN_SHARE of a template and more by chained matches, with the words covered;
    templates under ``min_match`` words have to match as a whole and have no spans beyond their places (share 1).
    A null or empty text has no words; repeated rows, rows without an id and any length of text are scanned alike; other
    columns are ignored. Words meet the vocabulary by 64-bit hashes.
    """
    ready(docs.sparkSession)
    named = list((PHRASES if phrases is None else phrases).items())
    everything = [(label, text) for text, label in named] + list(TEMPLATES if templates is None else templates)
    n_phrases = len(named)
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(everything, min_match)
        sizes = scanner.automaton.sizes
        for batch in batches:
            counts, hits, spans = [], [], []
            for n, found in scanner.texts(batch.column(1)):
                counts.append(n)
                places = [(everything[t][0], *found.places[t]) for t in sorted(found.places) if t < n_phrases]
                hits.append([dict(zip(("label", "places", "first_word", "last_word"), p)) for p in places])
                wide = found.result() + [(t, first, first + sizes[t] - 1, sizes[t]) for t, (_, first, _) in found.places.items() if t >= n_phrases]
                spans.append([
                    {"template": t - n_phrases, "label": everything[t][0], "first_word": a, "last_word": b, "covered": c, "share": c / sizes[t]}
                    for t, a, b, c in sorted(wide, key=lambda s: (s[1], s[0])) if t >= n_phrases
                ])
            place = pa.list_(pa.struct([("label", pa.string()), ("places", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
            span = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, place), pa.array(spans, span)], names=[doc_id, "n_words", "phrases", "spans"])

    return docs.select(doc_id, "text").mapInArrow(scan, f"`{doc_id}` {kind}, n_words long, phrases {PLACES}, spans {SPANS}")


def licence_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest covered share, 1 for a phrase) and n_spans."""
    found = scan_licences(docs)
    base, spans = F.transform("phrases", lambda p: p.label), F.transform("spans", lambda s: s.label)
    shares = F.array_max(F.transform("spans", lambda s: s.share))
    return found.select(
        "doc_id", "n_words", F.aggregate("phrases", F.lit(0).cast("long"), lambda a, p: a + p.places).alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p.first_word)).alias("first_word"), F.array_max(F.transform("phrases", lambda p: p.last_word)).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, spans))), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.least(F.coalesce(shares, F.lit(0.0)), F.lit(1.0))).alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )
