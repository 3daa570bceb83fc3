"""The network's gradients against differences, its windows against a loop, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from streetgrove.llm import toxicity as t


def test_gradients_equal_differences():
    net = t.Network.fresh({"idiot": 1}, dtype=np.float64)
    windows, y = [["hello", "idiot", "x"], ["ab"], ["hello", "abc", "d", "ef", "idiot"]], np.array([1.0, 0, 1])
    _, grads = t.gradients(net, windows, y)
    rng = np.random.default_rng(0)
    for p, g in zip(net.parts(), grads, strict=True):
        for name, values in p.items():
            for _ in range(3):
                at = tuple(rng.integers(0, s) for s in values.shape)
                if name == "char":
                    at = (ord(rng.choice(list("abdefhilotx"))), at[1])
                losses = []
                for step in (1e-5, -2e-5):
                    values[at] += step
                    losses.append(t.gradients(net, windows, y)[0])
                values[at] += 1e-5
                assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-7


def test_windows_overlap_and_cover():
    sizes = [0, 1, 32, 64, 65, 96, 97, 1000]
    row, start, size = t.windows_of(sizes)
    base = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes):
        own = [(int(s - base[k]), int(z)) for r, s, z in zip(row, start, size, strict=True) if r == k]
        want, s = [], 0
        while n:
            want.append((s, min(t.WINDOW, n - s)))
            if s + t.WINDOW >= n:
                break
            s += t.STRIDE
        assert own == want


def test_score_of_a_window_does_not_depend_on_the_batch():
    net = t.Network.fresh({"a": 1})
    found = [["a", "bb", "ccc"] * k for k in (1, 30, 90)] + [[]]
    alone = [float(t.Scorer(net)([ws])[0]) for ws in found]
    np.testing.assert_allclose(t.Scorer(net)(found), alone, rtol=1e-4)
    assert np.isnan(alone[3])


def corpus(n):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["an", "the", "or", "ing", "é", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([5, 40, 150]))]
        toxic = rng.random() < 0.3
        if toxic:  # a stem with endings that differ, and a word
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["scum", "zoq" + rng.choice(["an", "the", "or", "ing", "é", "sh"]) * rng.randint(1, 2)])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learns_and_holds_out(spark):
    rows = corpus(700)
    docs = spark.createDataFrame([(i, text, "x") for i, text, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (9003, "!!!", "x"), (None, "the sh", "x"), (9004, "scum" * 9000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    learned = t.learned_rows(docs, labels)
    outside = {r.doc_id for r in docs.where(t.held_out(docs["doc_id"])).collect()}
    texts = {r.text for r in learned.collect()}
    assert not texts & {text for i, text, _ in rows if i in outside}
    model = t.fit(learned)
    got = {r.doc_id: r for r in t.score(docs, model).collect()}
    assert len(got) == 705
    wrong = sum(got[i].predicted != y for i, _, y in rows if i in outside)
    assert wrong <= 0.06 * len(outside)
    assert got[9001].score == got[9002].score == got[9003].score == model.share
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.fit(t.learned_rows(docs, labels))
    assert [r.score for r in t.score(docs, model).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")
    many = spark.createDataFrame([(k, "text") for k in range(20)], "doc_id long, text string")
    assert {r.score for r in t.score(many, t.fit(t.learned_rows(many, one))).collect()} == {1.0}
    assert t.score(docs.limit(0), model).count() == 0


def test_long_texts_teach(spark):
    rng = random.Random(3)
    long = lambda k: " ".join(["scum"] * (k % 2) + [rng.choice(["the", "tree", "street", "grows", "beside", "walk"]) for _ in range(600)])
    rows = [(k, long(k)) for k in range(120)]
    assert min(len(text) for _, text in rows) > 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    model = t.fit(t.learned_rows(docs, labels))
    assert model.net is not None
    got = {r.doc_id: r.predicted for r in t.score(docs, model).collect()}
    assert sum(got[k] == k % 2 for k, _ in rows) >= 100  # a constant score has 60


def test_passages_reach_over_the_text(spark):
    text = " ".join(str(k) for k in range(5000))
    docs = spark.createDataFrame([(text,), ("short one",)], "text string")
    long, short = (r[0] for r in docs.select(t.passages(F.col("text"), F.char_length("text"), 4096)).collect())
    assert short == "short one" and len(long) == 8 * 512 + 7 and long.startswith("0 1 ") and long.endswith(" 4999")
    assert t.share_out([10, 2, 10], 12) == 5 and t.share_out([3, 4], 100) == 4 and t.share_out([], 5) == 1
