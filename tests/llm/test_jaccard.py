"""The Jaccard join against all pairs, on sets of all sizes and on every document of a table."""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from replen.llm import jaccard
from replen.llm.minhash import NearParams

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    return out


def grouped(rows, k=4, percent=85):
    """doc_id to (n_shingles, component_id), by counting shared shingles of all pairs that share one."""
    sets, with_shingle = sets_of(rows, k), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            with_shingle[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = 0
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in with_shingle[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}, links


@pytest.fixture(scope="module")
def rows():
    r = np.random.RandomState(2)
    texts = [None, "", " \n\t ", "one", "ONE", "a b c", "a b c d", "A b c D e", "É b c d", "é b c d"]
    passage = [f"p{i}" for i in range(60)]
    for base in range(90):
        w = [f"w{x}" for x in r.randint(0, 3000, int(r.choice([6, 9, 12, 20, 35, 60, 120, 400])))]
        if base % 3 == 0:
            w += passage  # a passage that a third of all texts share
        for _ in range(int(r.randint(1, 9))):
            c = list(w)
            for at in r.randint(0, len(c), int(len(c) * r.choice([0.0, 0.01, 0.02, 0.03, 0.04]) + r.randint(0, 2))):
                c[at] = f"new{r.randint(1e6)}"
            c = c[int(r.choice([0, 0, 1, len(c) * 0.05])) :] + [f"tail{r.randint(1e6)}"] * int(r.choice([0, 0, 1, 3]))
            texts.append(" ".join(c))
            if r.rand() < 0.3:
                w = c
    long = [f"l{x}" for x in r.randint(0, 9000, 25_000)]
    texts += [" ".join(long), " ".join(long[1500:]), " ".join(long[4500:]), *texts[8:20]]
    return [(int(i) * 3 - 50, t) for i, t in zip(r.permutation(len(texts)), texts)]


@pytest.mark.parametrize("params", [jaccard.JOIN, NearParams(percent=85, shingle=4, block=3, weight=40), NearParams(percent=60, shingle=2)])
def test_equals_all_pairs(spark, rows, params):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n_shingles int, tiles string, bitmap string")
    want, links = grouped(rows, params.shingle, params.percent)
    assert links > 150
    found = jaccard.jaccard_join(docs, params)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == want and found.count() == len(rows)


def test_linked_sets_meet_in_a_tile():
    """Of sets of every small size, each pair that is linked shares a tile key, whatever the elements."""
    r = np.random.RandomState(3)
    pairs = 0
    for percent in (60, 85):
        for n in [*range(1, 60), 90, 150, 400, 5000]:
            for _ in range(30):
                a = np.unique(r.randint(0, 2**63, n).astype(np.uint64))
                most = jaccard.most_apart(n, percent)
                gone = r.randint(0, most + 1) if most else 0
                more = r.randint(0, most - gone + 1) if most else 0
                b = np.unique(np.r_[a[r.permutation(n)[gone:]], r.randint(0, 2**63, more).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    pairs += 1
                    assert set(jaccard.tile_keys(a, percent).tolist()) & set(jaccard.tile_keys(b, percent).tolist())
                    x, y = jaccard.folded(pd.Series([jaccard.bitmap(a), jaccard.bitmap(b)]), jaccard.BITS)
                    assert jaccard.bits_apart(x, y) <= len(a) + len(b) - 2 * both <= min(jaccard.most_apart(len(a), percent), jaccard.most_apart(len(b), percent))
    assert pairs > 2000


def test_all_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, _ = grouped([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()} == want


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text + " more"), (None, text), (None, None), (3, None), (3, text)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got.collect() if r.component_id is not None) == [(0, 47, 1), (1, 47, 1), (1, 47, 1), (2, 48, 1), (3, 0, 3), (3, 47, 1)]
    assert got.where("component_id is null").count() == 1
    with pytest.raises(TypeError):
        jaccard.jaccard_join(empty.select(F.col("doc_id").cast("string"), "text"))
