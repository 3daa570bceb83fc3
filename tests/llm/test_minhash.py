"""Circulant MinHash against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from streetgrove.llm import minhash as m


def brute(rows, shingle, percent=80):
    sets = [m.shingle_set((t or "").encode().lower().split(), shingle) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(n // 8):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 6, 30, 80]))]
        for _ in range(8):
            edited = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.06, 0.12, 0.3]) else w for w in base]
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(edited).upper() if rng.random() < 0.2 else " ".join(edited)))
            i += 3
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(5000 + k, passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([4, 10, 25])))) for k in range(60)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "a\xa0b c"), (9006, "word " * 3000)]


@pytest.mark.parametrize(("seed", "shingle"), [(1, 2), (2, 5)])
def test_equals_all_pairs(spark, seed, shingle):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string").repartition(3)
    got = sorted(tuple(r) for r in m.near_duplicates(docs, shingle=shingle).collect())
    assert got == brute(rows, shingle)


def test_full_bucket_loses_no_link(spark, monkeypatch):
    """One bucket for all: the leader links few, the rarest shingles must find every other link."""
    monkeypatch.setattr(m, "buckets_of", lambda low, bands: np.zeros(1, np.int64))
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    rows, at = [], 0
    for _ in range(5):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(5):
            base = [rng.choice(words) if rng.random() < 0.04 else w for w in base]
            rows.append((at, " ".join(base)))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in m.near_duplicates(docs, shingle=2).collect()) == brute(rows, 2)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(none).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, "alone here with nobody else around")]
    got = sorted((tuple(r) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 2, None, True)], key=str)


def test_signature_estimates_likeness():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)))
    same = np.mean(m.signature(a, 1024) == m.signature(b, 1024))
    assert abs(same - 800 / 1200) < 0.06
