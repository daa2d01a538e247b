"""Spelling variants against a comparison of all words, in one round of filters and in many."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from replen.llm import spelling
from replen.llm.common import drop_stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(rows, every=199):
    count = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= 5 and len(w) >= 6}
    forms, nears = {}, {}
    for w, n in words.items():
        by = [v for v in words if near(v, w)]
        nears[w] = len(by)
        best = min(by, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, words[w], nears[w], words[forms[w]] if forms[w] else None)
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    base = ["".join(r.choice("abcdeé×ÀÉzAZ") for _ in range(r.randint(6, 11))) for _ in range(40)] + ["aaaaaaa", "chainab", "ÿÿÿÿÿÿ"]
    words = Counter()
    for w in base:
        words[w] += r.choice([5, 9, 30, 160, 900])
        for _ in range(r.randint(0, 12)):
            v, i = list(w), r.randrange(len(w))
            kind = r.randrange(3)
            v[i : i + (kind != 1)] = [] if kind == 0 else [r.choice("abcé÷")]
            words["".join(v)] += r.choice([4, 5, 6, 7, 12, 28])
    for n, w in ((900, "chainab"), (150, "chainac"), (28, "chainacd"), (5, "chainadd"), (5, "chainacde")):
        words[w] = n
    flat = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(flat)
    rows = [(i, " ".join(flat[i * 40 : i * 40 + 40]).replace(" ", r.choice([" ", "-", "1", "\n", "š"]))) for i in range(len(flat) // 40 + 1)]
    rows += [(None, "Nullid nullid " * 8), (7, None), (8, ""), (9, "short " * 20), (11, "x" * 30_000 + " " + "longword " * 3000), (12, ("y" * 5000 + " ") * 6 + ("y" * 4999 + " ") * 40)]
    return rows + rows[:3]


def test_equals_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", 3, "b") for i, t in texts], "doc_id long, text string, word string, n int, near string")
    want = grouped(texts)
    assert sum(x[0] is not None for x in want.values()) > 10 and any(want[x[1]][0] is None and want[w][0] not in (None, x[1]) for w, x in want.items())
    for p in (spelling.SpellingParams(), spelling.SpellingParams(blocks=7, bits=8, probes=300)):
        found = spelling.group_variants(docs, p, every=199)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        got = {x[0]: tuple(x)[1:] for x in found.collect()}
        assert found.count() == len(got) and got == want
    assert spelling.group_variants(docs.where("false")).count() == 0
    drop_stored(spark)


def test_edits_are_the_words_one_edit_away():
    letters = np.array(sorted(map(ord, "abc")), np.uint64)
    for w in ("abcabc", "aabbcc", "aaaaaa"):
        codes = spelling.code_points([w], len(w))
        got = []
        for replaced, (_, at, new, h) in spelling.edits(codes, letters, 4):
            made = [w[:i] + (chr(c) if replaced else "") + w[i + 1 :] for i, c in zip(at.tolist(), new.tolist())]
            for m, x in zip(made, h.tolist()):
                assert x == int(spelling.sums(spelling.code_points([m], len(m)))[0])
            got += made
        assert len(set(got)) == len(got)
        assert set(got) == {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc" if c > w[i]}


def test_rounds_cover_every_block_once():
    sizes, parts = spelling.rounds({6: 1000, 7: 3, 9: 70}, spelling.SpellingParams(blocks=64, bits=16))
    assert sizes == {6: 250, 7: 1, 9: 18} and all(sum(e - s for _, s, e in part) <= 64 for part in parts)
    assert sorted((k, b) for part in parts for k, s, e in part for b in range(s, e)) == [(k, b) for k in sizes for b in range(sizes[k])]
