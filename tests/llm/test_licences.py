"""Licence scan against slices of the word lists, and the automaton against plain substring search."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vitrine.llm import licences
from vitrine.llm.queries import QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    own, starts, labels = words(text), [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        at = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return (len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def check_base(rows, text_of):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text_of(r)), r
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_registered_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_licence_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    check_base(rows, lambda r: texts[r.doc_id])
    notices = {"released under the MIT License": "mit", "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0", "GNU General Public License, version 3": "gpl-3.0", "Licensed under the Apache License, Version 2.0": "apache-2.0"}
    for r in rows:
        for notice, label in notices.items():
            held = " ".join(words(notice)) in " ".join(words(texts[r.doc_id]))
            assert (label in r.labels.split(",")) == held, (r, notice)


def test_automaton_against_substrings():
    dice = random.Random(3)
    for _ in range(60):
        templates = [[dice.randrange(4) for _ in range(dice.randrange(2, 12))] for _ in range(3)]
        text = [dice.randrange(4) for _ in range(60)]
        automaton = licences.Automaton(templates, 4)
        inside = lambda part, t: any(t[i : i + len(part)] == part for i in range(len(t) - len(part) + 1))
        state, length = 0, 0
        for i, token in enumerate(text):  # matching statistics
            while state and token not in automaton.states[state].go:
                state = automaton.states[state].link
                length = automaton.states[state].length
            state = automaton.states[state].go.get(token, 0)
            length = length + 1 if state else 0
            want = max(n for n in range(i + 2) if n == 0 or any(inside(text[i + 1 - n : i + 1], t) for t in templates))
            assert length == want
            ends = {(k, e) for k, t in enumerate(templates) for e in range(len(t)) if length >= 4 and t[max(0, e + 1 - length) : e + 1] == text[i + 1 - length : i + 1]}
            assert length < 4 or set(automaton.states[state].ends) == ends
        short = [[0, 1], [2, 2, 3]]
        found = licences.Found([2, 3, *map(len, templates)])
        licences.Automaton(short + templates, 4).scan(text, 7, found)
        for k, t in enumerate(short):
            at = [i + 7 for i in range(len(text)) if text[i : i + len(t)] == t]
            assert found.places.get(k) == ((len(at), at[0], at[-1]) if at else None)


def scanned(texts):
    scanner = licences.Scanner([(label, t) for t, label in BASE.items()] + licences.TEMPLATES, licences.MIN_MATCH)
    return [(n, f.places, f.result()) for n, f in scanner.texts(pa.array(texts, pa.string()))]


def test_templates_whole_broken_and_repeated():
    for k, (label, text) in enumerate(licences.TEMPLATES):
        own = words(text)
        for wrapped in (text, f"before\n# {text.upper()}\n# after", " ".join(w for i, w in enumerate(own) if i % 17 != 11)):
            (_, _, spans), = scanned([wrapped])
            assert label in {licences.TEMPLATES[t - len(BASE)][0] for t, *_ in spans}, (label, spans)
        (_, _, spans), = scanned([f"{text} and then {text} once more {text}"])
        assert len(spans) >= 3 and {licences.TEMPLATES[t - len(BASE)][0] for t, *_ in spans} == {label}
    mit = next(t for label, t in licences.TEMPLATES if label == "mit" and len(t) > 100)
    halves = words(mit)
    (_, _, spans), = scanned([" ".join(halves[:40]) + " x" * 500 + " " + " ".join(halves[40:])])
    assert not spans  # two halves far apart are no licence
    (n, _, spans), = scanned(["y " * 300_000 + mit + " z" * 300_000])
    assert n == 600_000 + len(halves) and spans == [(spans[0][0], 300_000, 300_000 + len(halves) - 1, len(halves))]


def test_pieces_of_long_texts_and_many_matches(monkeypatch):
    dice = random.Random(1)
    vocabulary = sorted({w for _, t in licences.TEMPLATES for w in words(t)})
    long = " ".join(dice.choice(vocabulary) for _ in range(20_000)) + " cc by general public license" * 500 + " é" * 100
    whole = scanned([long, "cc", "by", long])
    monkeypatch.setattr(licences, "CHUNK_BYTES", 1000)
    assert scanned([long, "cc", "by", long]) == whole
    assert whole[0][1][0][0] >= 500 and whole[1][1] == {} == whole[2][1]


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \t.,;\n"), (4, "All Rights Reserved"), (4, "All Rights Reserved"), (None, "cc-by cc by CC/BY ccby"), (5, "All rights\x00reserved. İ all rights reservedé"),
        (6, "ALL RIGHTS RESERVED ALL RIGHTS RESERVED GENERAL PUBLIC LICENSE " * 20_000), (7, "x" * 3_000_000 + " cc by"), (8, "general public"), (9, "license all rights reserved general"),
    ]
    df = spark.createDataFrame([(*r, 1, "labels", 0.5) for r in rows], "doc_id long, text string, n_words int, labels string, score double")
    out = licences.licence_digest(df.repartition(3)).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    check_base(out, lambda r: texts[r.doc_id])
    assert licences.licence_digest(df.where("false")).count() == 0
    own = licences.scan_licences(df, [("house", "general public license all")], {"reserved license": "odd"}, 4).where("doc_id = 6").first()
    assert own.spans[0].label == "house" and len(own.spans) == 19_999 and own.phrases == []


def test_word_ids_match_the_words():
    scanner = licences.Scanner(licences.TEMPLATES, 4)
    texts = ["The  License, v2.0é THE", "", "ab\x7Flicense\x00the 9the"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, first = scanner.word_ids(data, offsets)
    got = [[scanner.vocabulary[i] if i < len(scanner.vocabulary) else None for i in ids[a:b]] for a, b in zip(first, first[1:])]
    known = set(scanner.vocabulary)
    assert got == [[w if w in known else None for w in words(t)] for t in texts]
