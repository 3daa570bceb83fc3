"""Winnowing against a walk over all windows."""

import hashlib
import random

import numpy as np
import pytest

from streetgrove.llm import winnow as w


def brute(text, gram, window):
    if not text:
        return []
    if len(text) < gram:
        return [(int(w.rolling(np.array([ord(c) for c in text], np.uint32), len(text))[0]), 0)]
    h = [int(w.rolling(np.array([ord(c) for c in text[i : i + gram]], np.uint32), gram)[0]) for i in range(len(text) - gram + 1)]
    size, kept = min(window, len(h)), []
    for i in range(len(h) - size + 1):
        low = min(h[i : i + size])
        at = max(j for j in range(i, i + size) if h[j] == low)
        if not kept or kept[-1][1] != at:
            kept.append((low, at))
    return kept


@pytest.mark.parametrize("segment", [7, 1 << 18])
def test_equals_walk(segment, monkeypatch):
    monkeypatch.setattr(w, "SEGMENT", segment)
    rng = random.Random(3)
    for gram, window in ((12, 16), (3, 5), (1, 1), (4, 7)):
        for text in ["", "a", "abc", "a" * 60, "é漢\U0001f600" * 20, *("".join(rng.choice("ab ") for _ in range(rng.randint(0, 90))) for _ in range(25))]:
            h, p = w.winnow(text, gram, window)
            assert list(zip(h.tolist(), p.tolist(), strict=True)) == brute(text, gram, window)
            assert w.read(w.write(h, p)) == brute(text, gram, window)


def test_guarantee():
    rng = random.Random(4)
    common = "".join(rng.choice("abcdefgh") for _ in range(27))
    for _ in range(50):
        a, b = ("".join(rng.choice("ijklmnop") for _ in range(rng.randint(30, 99))) for _ in range(2))
        assert set(w.winnow(a + common + b)[0].tolist()) & set(w.winnow(b + common + a)[0].tolist())


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, e, n = (set(w.winnow(x)[0].tolist()) for x in (t, edited, nxt))
        jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), w.write(*w.winnow(t)), w.write(*w.winnow(edited)), jac(a, e), jac(a, n)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_neighbours_over_buckets(spark, buckets):
    rng = random.Random(buckets)
    rows = [(k * rng.randint(1, 9), "".join(rng.choice("abc é\U0001f600") for _ in range(rng.choice([0, 1, 2, 40, 300])))) for k in range(60)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(-5, None), (10**12, "same " * 30), (10**12 + 1, "same " * 30), (None, "no id"), (7, "tie b"), (7, "tie a")]
    rows = [r for k, r in enumerate(rows) if r[0] != 7 or r[1].startswith("tie")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string").repartition(4)
    got = sorted([tuple(r) for r in w.edited_likeness(docs, buckets=buckets).collect()], key=str)
    assert got == expected(rows)


def test_one_and_none(spark):
    one = spark.createDataFrame([(3, "alone in the table")], "doc_id long, text string")
    assert [tuple(r) for r in w.edited_likeness(one).collect()] == expected([(3, "alone in the table")])
    assert w.edited_likeness(one.limit(0)).count() == 0


def test_fingerprints(spark):
    docs = spark.createDataFrame([(1, "the same text here, the same"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: list(zip(r.hashes, r.positions, strict=True)) for r in w.fingerprints(docs).collect()}
    assert got == {1: brute("the same text here, the same", 12, 16), 2: []}
