"""Conversation repair against a listing of all edit sequences, and the registered query against a row-by-row version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from vitrine.llm import structure_repair
from vitrine.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
ORDER = re.compile(r"(s?(ua)+)?")
DELETED, WHITE = "bd", " \t\n\v\f\r"


def every_repair(symbols, most=3):
    """(cost, audit) by listing every choice for each row and up to ``most`` insertions in each gap."""
    best = None
    inserts = ["".join(p) for n in range(most + 1) for p in itertools.product("ua", repeat=n)]
    rows = [[("D", "", 3)] + ([] if s[1] in DELETED else [("K", s[0], s[1] == "t"), ("R", "u", 2 + (s[1] == "t")), ("R", "a", 2 + (s[1] == "t"))]) for s in symbols]
    for chosen in itertools.product(*rows):
        for gaps in itertools.product(inserts, repeat=len(symbols) + 1):
            roles = gaps[0] + "".join(c[1] + g for c, g in zip(chosen, gaps[1:]))
            if ORDER.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(c[0] + "I" * len(g) for c, g in zip(chosen, gaps[1:]))
                found = (sum(c[2] for c in chosen) + 2 * sum(map(len, gaps)), audit)
                best = found if best is None else min(best, found)
    return best


def row_by_row(symbols):
    """(cost, audit) by a forward programme that carries whole audits."""
    step, kept = structure_repair.STEP, structure_repair.KEPT
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                best[step[q]] = min(best.get(step[q], (10**9, "")), (c + 2, a + "I"))
        return best

    for role, fault in symbols:
        new = {}
        for q, (c, a) in inserted(best).items():
            ways = [(q, c + 3, "D")]
            if fault not in DELETED:
                ways.append((step[q], c + 2 + (fault == "t"), "R"))
                if q in kept.get(role, {}):
                    ways.append((kept[role][q], c + (fault == "t"), "K"))
            for r, cost, letter in ways:
                new[r] = min(new.get(r, (10**9, "")), (cost, a + letter))
        best = new
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def runs(symbols):
    return [(s, len(list(g))) for s, g in itertools.groupby(symbols)]


def test_edits_against_every_sequence():
    every = [r + f for r in "suax" for f in "-tb"]
    dice = random.Random(5)
    cases = [[]] + [[s] for s in every] + [list(p) for p in itertools.product(every, repeat=2)] + [[dice.choice(every) for _ in range(3)] for _ in range(40)]
    programme = structure_repair.Programme()
    for symbols in cases:
        want = every_repair(symbols, 2)
        assert programme.cheapest_edits(runs(symbols)) == want == row_by_row(symbols), symbols


def test_long_runs_and_mixed_rows():
    dice, programme = random.Random(8), structure_repair.Programme()
    every = [r + f for r in "suax" for f in "-tbd"]
    for _ in range(300):
        symbols = [s for _ in range(dice.randrange(12)) for s in [dice.choice(every)] * dice.choice([1, 1, 2, 9])]
        assert programme.cheapest_edits(runs(symbols)) == row_by_row(symbols), symbols
    assert programme.cheapest_edits([("s-", 1), ("u-", 9_001)]) == row_by_row(["s-"] + ["u-"] * 9_001)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rs in out.items()}


def expected(rows):
    seen, symbols, counts = set(), [], {"b": 0, "d": 0, "t": 0, "-": 0}
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        counts[fault] += 1
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "x") + fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = row_by_row(symbols)
    left = len(audit) - audit.count("D")
    lines, i = [], 0
    for letter in audit:
        if letter != "I":
            _, role, text = rows[i]
            i += 1
        else:
            text = ""
        if letter != "D":
            if letter != "K":
                role = "user" if (len(lines) + left) % 2 == 0 else "assistant"
            lines.append(f"{role}:{text}")
    assert ORDER.fullmatch("".join(x[0] for x in lines))
    return (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(got, rows):
    want = {c: expected(rs) for c, rs in damaged(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    return want


@pytest.mark.parametrize("folder", [SMALL])
def test_registered_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = check(QUERIES["op13_structure_repair"](spark, folder).collect(), rows)
    assert any("D" in v[6] for v in want.values()) and any("R" in v[6] or "I" in v[6] for v in want.values())


def test_edge_cases(spark):
    long = "word " * 60_000
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be good."), (1, 9, None, None),
        (2, None, None, None), (2, None, "user", "a"), (3, 5, "tool", "x!"), (3, 6, "", "y?"), (3, 7, "user", " \t\n"), (4, 0, "user", long), (4, 1, "assistant", long + "."),
        (None, 0, "user", "lost"), (-7, 3, "Übung", "é."), *[(5, t, "user", f"say {t}.") for t in range(200)], *[(6, 1, "user", "same.")] * 30,
    ]
    df = spark.createDataFrame([(*r, "clash", "k", 1) for r in rows], "conv_id long, turn long, role string, text string, source string, edit string, position int")
    want = check(structure_repair.repair_digest(df.repartition(3)).collect(), [r for r in rows if r[0] is not None])
    assert want[5][5] > 100 and want[6][2] >= 29
    assert structure_repair.repair_digest(df.where("false")).count() == 0
    summary, kept = structure_repair.repair(df)
    assert summary.where("conv_id = 6").first().cost == 29 * 3 + 2
    assert kept.where("conv_id = 6").count() == 2 and kept.where("edit = 'I'").where("text <> ''").count() == 0


def test_conversation_without_rows_after_damage(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert tuple(structure_repair.repair_digest(df).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
