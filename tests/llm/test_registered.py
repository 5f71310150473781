"""Registered queries without a SQL twin against brute force or held-out labels."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from vitrine.llm import class_model
from vitrine.llm.queries import QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def rest(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_pseudonyms(spark):
    before, out = texts(spark, MEDIUM), QUERIES["op1_pseudonyms"](spark, MEDIUM).collect()
    mail = r"[^\s|]+@[A-Za-z0-9.-]+\.com"
    link = {}
    for r in out:
        assert (r.n_pii == 0) == (r.text == before[r.doc_id])
        old, new = re.findall(mail, before[r.doc_id]), re.findall(mail, r.text)
        assert len(old) == len(new)
        for a, b in zip(old, new):
            assert a != b and link.setdefault(a, b) == b and re.sub(r"\d", "9", a.split("@")[1]) == re.sub(r"\d", "9", b.split("@")[1])
    assert link and len(set(link.values())) == len(link)


def test_repeats(spark):
    first, want = {}, {}
    for i, t in sorted(texts(spark, SMALL).items()):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_repeats"](spark, SMALL).collect()}
    assert got == want


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op6_language_id"](spark, MEDIUM).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(lang) and all(r.held_out == (rest(r.doc_id, 4) == 2) for r in out)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_toxicity_of_held_out_documents(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    out = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, MEDIUM).collect()}
    assert all(r.held_out == (rest(i, 4) == 2) and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [(out[i].score, t) for i, t in toxic.items() if rest(i, 4) == 2 and t is not None]
    high, low = np.array([s for s, t in held if t]), np.array([s for s, t in held if not t])
    assert (high[:, None] > low).mean() + 0.5 * (high[:, None] == low).mean() > 0.85


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_class_model(spark, folder):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + [None] for i, t in texts(spark, folder).items()}
    counts = collections.Counter(w for i, ws in tokens.items() if rest(i, 7) != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    score = base = 0.0
    for r in QUERIES["op9_class_model"](spark, folder).collect():
        own = tokens[r.doc_id]
        want = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        assert abs(r.base_score - want) < 1e-9 * len(own) + 1e-9
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(r.doc_id, 7) == 2, len(own), sum(counts[w] > 0 for w in own), total)
        if r.held_out:
            score, base = score + r.score, base + r.base_score
    assert score > base


def test_class_scores_from_the_reported_classes(spark):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) + [None] for i, t in texts(spark, SMALL).items()}
    got = {r.doc_id: r for r in class_model.score_texts(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), with_classes=True).collect()}
    counts = collections.Counter(w for i, ws in tokens.items() if rest(i, 7) != 2 for w in ws)
    of, moves, size = {}, collections.Counter(), collections.Counter()
    for i, ws in tokens.items():
        assert len(got[i].classes) == len(ws)
        for w, k in zip(ws, got[i].classes):
            assert of.setdefault(w, k) == k  # a word has one class
    end = of[None]
    for i, ws in tokens.items():
        if rest(i, 7) != 2:
            own = [of[w] for w in ws]
            moves.update(zip([end, *own], own))
            size.update(own)
    words = collections.Counter(of[w] for w in counts)
    leaving = collections.Counter()
    for (a, _), n in moves.items():
        leaving[a] += n
    n_classes = class_model.CLASSES
    assert len(set(of.values())) > n_classes / 2
    for i, ws in tokens.items():
        own = [of[w] for w in ws]
        steps = sum(math.log10((moves[a, b] + 0.1) / (leaving[a] + 0.1 * n_classes)) for a, b in zip([end, *own], own))
        emitted = sum(math.log10((counts[w] + 1) / (size[k] + words[k] + 1)) for w, k in zip(ws, own))
        assert abs(got[i].score - steps - emitted) < 1e-8 * len(ws) + 1e-8
    with pytest.raises(ValueError):
        class_model.score_texts(spark.createDataFrame([], "doc_id long, text string"), classes=300)
