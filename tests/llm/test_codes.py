"""Vector codes over metric trees against every distance."""

import hashlib
import random

import numpy as np
import pytest

from streetgrove.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, who string, x int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, "c", "w", 1) for i, v, label in rows], SCHEMA).repartition(parts)


def brute(rows, parts, entries, rounds, scale):
    good = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return []
    lengths = [len(v) for _, v, _ in good]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    good = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label) for i, v, label in good if len(v) == width]
    first = [v for _, v, _ in sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))][:entries]
    step = width // parts
    books = [[v[p * step : (p + 1) * step] for v in first] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in good:
                piece = v[p * step : (p + 1) * step]
                own[near(p, piece)[1]].append(piece)
            books[p] = [[sum(c) // len(c) for c in zip(*g, strict=True)] if g else e for g, e in zip(own, books[p], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in good:
        found = [near(p, v[p * step : (p + 1) * step]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


def random_rows(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(9)]
    return [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)], rng.choice([None, 1, 2])) for k in range(n)]


def test_equals_every_distance(spark):
    rows = random_rows(600, 16, 3)
    odd = [
        (None, [0.5] * 16, 3), (None, [0.25] * 16, None), (7, [0.0] * 16, 1), (7, [0.0] * 16, 1), (9000, None, 1), (9001, [None] * 16, 1),
        (9002, [float("nan")] + [0.0] * 15, 1), (9003, [float("inf")] * 16, 1), (9004, [-float("inf")] * 16, 1), (9005, [], 1), (9006, [1.0] * 8, 2), (9007, [1.0] * 15, 2),
    ]
    hot = [(5000 + k, [0.125, -0.125] * 8, 4) for k in range(300)]
    rows = rows + odd + hot
    random.Random(1).shuffle(rows)
    got = sorted([tuple(r) for r in codes.encode(table(spark, rows), parts=4, entries=6, rounds=4, scale=64).collect()], key=str)
    assert got == brute(rows, 4, 6, 4, 64)


def test_few_vectors_ties_and_equal_entries(spark):
    rows = [(k, [float(k % 2)] * 8, None) for k in range(5)]
    got = sorted([tuple(r) for r in codes.encode(table(spark, rows, 2)).collect()], key=str)
    assert got == brute(rows, 8, 16, 6, 4096)
    assert codes.encode(table(spark, [], 1)).count() == 0
    assert codes.encode(table(spark, [(1, None, 1), (2, [float("nan")] * 8, 1)], 1)).count() == 0


def test_many_labels_are_joined_in_salted_parts(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 1)
    rows = random_rows(200, 8, 5)
    got = sorted([tuple(r) for r in codes.encode(table(spark, rows), parts=2, entries=4, rounds=2, scale=64).collect()], key=str)
    assert got == brute(rows, 2, 4, 2, 64)


def test_lengths_that_do_not_divide_are_refused(spark):
    with pytest.raises(ValueError, match="do not divide"):
        codes.encode(table(spark, [(1, [1.0] * 7, 1)], 1), parts=2)


@pytest.mark.parametrize("spread", [0.02, 1.0, 30.0])
def test_balls_hold_their_points_and_walks_lose_none(spread):
    points = np.array([[int(64 * x) for x in v] for _, v, _ in random_rows(1500, 6, 8, spread)], np.int64)
    points[200:500] = points[200]
    tree = codes.grow(points)
    assert (tree.points == points[tree.order]).all()
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for k in range(len(tree.start)):
        own = tree.points[tree.start[k] : tree.end[k]].astype(np.int64)
        assert (own.sum(0) == tree.total[k]).all()
        assert (np.sqrt(((own - tree.center[k]) ** 2).sum(1)) <= tree.radius[k] + 1e-9).all()
        below = range(tree.child[k], tree.child[k] + tree.children[k])
        assert not len(below) or (min(tree.start[c] for c in below), max(tree.end[c] for c in below)) == (tree.start[k], tree.end[k])
    book = np.concatenate((points[:7], points[3:4], points[200:201] + 1))
    square = ((points[:, None, :] - book[None]) ** 2).sum(2)
    chosen, error = codes.assign(tree, book)
    assert (chosen == square.argmin(1)).all() and (error == square.min(1)).all()
    total, n = codes.sums(tree, book)
    assert (n == np.bincount(chosen, minlength=len(book))).all()
    assert all((total[k] == points[chosen == k].sum(0)).all() for k in range(len(book)))


def test_distant_groups_are_owned_whole():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-20, 20, (400, 4)) + 10_000 * k for k in range(5)])
    tree = codes.grow(points)
    owned, at, _ = codes.walk(tree, points[::400].copy())
    assert len(at) == 0 and sum(len(b) for b, _ in owned) <= 40


def test_long_components_are_compared_in_integers():
    points = np.array([[1 << 26, 0], [(1 << 26) - 1, 0], [-(1 << 26), 5]], np.int64)
    assert (codes.squares(points, points) == ((points[:, None, :] - points[None]) ** 2).sum(2)).all()
