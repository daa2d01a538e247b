"""Conversation repair against a search through all edits, and on odd rows."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from replen.llm import turns

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def searched(role, fault):
    """Least (cost, audit) by trying every edit at every turn, for every target of up to n + 3 symbols."""
    n, best = len(role), None
    for target in ["", *("s" * s + "ua" * k for s in (0, 1) for k in range(1, (n + 4) // 2 + 1))]:

        @cache
        def go(i, j):
            if i == n and j == len(target):
                return 0, ""
            found = []
            if i < n:
                found.append((3, "D", go(i + 1, j)))
            if j < len(target) and target[j] != "s":
                found.append((2, "I", go(i, j + 1)))
            if i < n and j < len(target) and fault[i] != 2:
                if role[i] == target[j]:
                    found.append((int(fault[i] == 1), "K", go(i + 1, j + 1)))
                if target[j] != "s" and role[i] != target[j]:
                    found.append((2 + (fault[i] == 1), "R", go(i + 1, j + 1)))
            return min((c + rest[0], e + rest[1]) for c, e, rest in found if rest) if any(f[2] for f in found) else None

        got = go(0, 0)
        if got and (best is None or got < best):
            best = got
    return best


def test_alignment_equals_search():
    r = random.Random(3)
    for case in range(1500):
        n = r.randint(0, 7)
        role, fault = [r.choice("suuaax") for _ in range(n)], [r.choice([0, 0, 0, 1, 2]) for _ in range(n)]
        codes = "".join(turns.CODES[3 * "suax".index(a) + f] for a, f in zip(role, fault))
        want = searched(role, fault)
        x, y = turns.turned(codes)
        assert turns.aligned(x, y) == want, (role, fault)
        assert turns.automaton(x.tolist(), y.tolist()) == want, (role, fault)


def test_long_conversations_either_way():
    r = random.Random(4)
    for n in (60, 400, 1500):
        role = [0, *[(1 + i % 2) if r.random() < 0.9 else r.randint(0, 3) for i in range(n)]]
        fault = [r.choice([0] * 12 + [1, 2]) for _ in role]
        x, y = turns.turned("".join(turns.CODES[3 * a + f] for a, f in zip(role, fault)))
        assert turns.aligned(x, y) == turns.automaton(role, fault)


def repaired(rows):
    """conv_id to the whole result, from (conv_id, turn, role, text) rows before damage."""
    found = {}
    for conv, turn, role, text in rows:
        here = found.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        role = "user" if hit == 4 else role
        here += [(turn is not None, turn or 0, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv, here in found.items():
        here.sort()
        seen, fault, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in here:
            bare = text.strip(WHITE)
            name = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            fault.append({"blank": 2, "duplicate": 2, "truncated": 1, None: 0}[name])
            if name:
                count[name] += 1
        initial = [r[:1] for _, _, r, _ in here]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:]))
        numbers = [t for known, t, _, _ in here if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = searched([x if x in ("s", "u", "a") else "x" for x in initial], fault)
        lines, i, due = [], 0, 0
        for e in audit:
            name = ("user", "assistant")[due]
            if e == "I":
                lines.append(f"{name}:")
                due = 1 - due
                continue
            role, text = here[i][2:]
            i += 1
            if e == "D":
                continue
            lines.append(f"{role if e == 'K' else name}:{text}")
            due = due if e == "K" and role[:1] == "s" else 1 - due
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, dropped2 int, codes string, kind int, cost string"


def test_query_equals_brute_force(spark):
    r = random.Random(5)
    text = lambda: r.choice(["Yes.", "No?", "cut off", "", " \n", "Well . ", "é!", "a\x0bb\x0c", "Same.", "Same."])
    rows = []
    for conv in range(150):
        order = list(range(r.randint(1, 7)))
        r.shuffle(order)
        rows += [(conv, t if r.random() < 0.95 else None, r.choice(["system", "user", "user", "assistant", "assistant", "", "tool", None]), text() if r.random() < 0.97 else None) for t in order]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (2**62 + 1, None, None, None), (-5, 7, "user", "x" * 200_000 + ".")]
    rows += [(5000, t, "user", "All the same.") for t in (3, 3, 3)]
    gone = next(c for c in range(6000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Dropped."))
    data = spark.createDataFrame([(*x, 1, "q", 2, "z") for x in rows], SCHEMA)
    found = turns.repair(turns.damaged(data))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {x[0]: tuple(x)[1:] for x in found.collect()}
    want = repaired(rows)
    assert len(got) == found.count() and got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turns.repair(turns.damaged(data.where("false"))).count() == 0


def test_cut_into_batches_and_blocks(spark, monkeypatch):
    """Conversations that are longer than a batch, a block of codes or the alignment's bound give the same rows."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t}.") for c in range(3) for t in range(700)]
    data = turns.damaged(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    want = {tuple(x) for x in turns.repair(data).collect()}
    monkeypatch.setattr(turns, "MOST_ALIGNED", 50)
    monkeypatch.setattr(turns, "BLOCK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert {tuple(x) for x in turns.repair(data).collect()} == want and len(want) == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("codes,want", [("", (0, "")), ("a", (3, "D")), ("d", (2, "KI")), ("adg", (0, "KKK")), ("lll", (9, "DDD")), ("g", (2, "IK"))])
def test_small_cases(codes, want):
    x, y = turns.turned(codes)
    assert turns.aligned(x, y) == want == turns.automaton(x.tolist(), y.tolist())
