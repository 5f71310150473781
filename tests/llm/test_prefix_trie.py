"""Trie of common beginnings against a dictionary of prefixes: random, long, hot and odd conversations."""

import hashlib
import random
import re
import zlib

import pytest

from vitrine.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, hi string, words int"


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [r[3:] for r in sorted(rs)] for c, rs in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    return out


def trie(rows):
    members, ends, kids, last = {}, {}, {}, {}
    for c, turns in rebuilt(rows).items():
        key = ()
        for d in range(len(turns) + 1):
            if d:
                kids.setdefault(key, set()).add(new := hash((key, turns[d - 1])))
                key, up = new, key
                last[key] = (d, turns[d - 1], up)
            else:
                last[key] = (0, None, None)
            members.setdefault(key, []).append(c)
        ends.setdefault(key, []).append(c)
    leaves, saved = {}, {}
    for key in sorted(members, key=lambda k: -last[k][0]):
        leaves[key] = sum(leaves[k] for k in kids.get(key, ())) or 1
        own = (len(members[key]) - 1) * (n_words(last[key][1][1]) if last[key][1] else 0)
        saved[key] = own + sum(saved[k] for k in kids.get(key, ()))
    return sorted(
        (min(m), last[k][0], None if last[k][2] is None else min(members[last[k][2]]), len(m), len(kids.get(k, ())), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    )


def spark_trie(df):
    out = prefix_trie.conversation_trie(df).drop("hi", "lo").collect()
    return sorted(tuple(r) for r in out)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)


def test_random_conversations(spark):
    dice, rows = random.Random(4), []
    for c in list(range(0, 70)) + [-3, -20, 10**12]:
        for t in range(dice.randrange(1, 22)):
            rows.append((c, t if dice.random() < 0.95 else None, dice.choice(["user", "assistant", None]), dice.choice(["a", "b c", None, "", "a"])))
    assert spark_trie(made(spark, rows)) == trie(rows)


def test_long_hot_and_odd_conversations(spark):
    long = [(40, t, "user", f"turn {t % 7}") for t in range(130)] + [(41, t, "user", f"turn {t % 7}" if t < 100 else "other") for t in range(120)]
    hot = [(c, t, "user", "same words here") for c in range(200, 500) for t in range(9)]
    odd = [(None, 0, "user", "lost"), (1, 0, "user", "x " * 30_000), (2, 0, "user", "x " * 30_000), (60, 0, None, None), (61, 0, "", ""), (5, 1, "a", "b"), (5, 1, "a", "b"), (5, 1, "ab", "")]
    rows = long + hot + odd
    want = trie(rows)
    assert max(r[1] for r in want) == 130
    assert spark_trie(made(spark, rows)) == want


def test_turnless_members_and_empty_table(spark):
    lone = next(c for c in range(1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "gone"), (lone, 1, "user", "gone too")]
    assert spark_trie(made(spark, rows)) == trie(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert prefix_trie.conversation_trie(made(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_pieces_of_a_digest(spark, n, monkeypatch):
    from vitrine.llm import digests

    monkeypatch.setattr(digests, "PIECE_CHARS", 5)
    df = spark.createDataFrame([(i % n, i, f"v{i}") for i in range(50)], "k long, at long, v string").repartition(7)
    pieces = digests.joined_pieces(df, ["k"], "at", "v", ",")
    got = {r.k: r.sha256 for r in digests.ordered_sha256(pieces, ["k"], "at", "v", ",").collect()}
    assert got == {k: hashlib.sha256(",".join(f"v{i}" for i in range(50) if i % n == k).encode()).hexdigest() for k in range(n)} and pieces.count() > n
