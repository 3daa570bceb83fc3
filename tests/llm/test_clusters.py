"""Clusters with simplex bounds against every distance."""

import hashlib
import random

import numpy as np
import pytest

from streetgrove.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, x string, hash string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", "h") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, width, scale, k, rounds):
    good = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return []
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order][:k]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in good:
            own[near(v)[1]].append(v)
        centroids = [[sum(c) // len(c) for c in zip(*g, strict=True)] if g else c for g, c in zip(own, centroids, strict=True)]
    found = [(i, *near(v)) for i, v in good]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for _, d, _ in found)
    return sorted(((i, n, d, sum(e for _, e, m in found if m == n), total, names[n]) for i, d, n in found), key=str)


def random_rows(n, width, seed):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(7)]
    return [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)]) for k in range(n)]


def test_equals_every_distance(spark):
    rows = random_rows(400, 12, 2) + [(5000 + k, [0.125, -0.125] * 6) for k in range(200)]
    rows += [
        (None, [0.5] * 12), (None, [0.25] * 12), (7, [0.0] * 12), (7, [0.0] * 12), (9000, None), (9001, [None] * 12), (9002, [float("nan")] + [0.0] * 11),
        (9003, [float("inf")] * 12), (9004, [-float("inf")] * 12), (9005, []), (9006, [1.0] * 11), (9007, [1.0] * 13),
    ]
    random.Random(1).shuffle(rows)
    got = sorted([tuple(r) for r in clusters.cluster(table(spark, rows), width=12, rounds=5, pivots=6).collect()], key=str)
    assert got == brute(rows, 12, 1024, 8, 5)


def test_few_vectors_ties_repeats_and_empty_tables(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(5)]
    got = sorted([tuple(r) for r in clusters.cluster(table(spark, rows, 2)).collect()], key=str)
    assert got == brute(rows, 64, 1024, 8, 10)
    assert clusters.cluster(table(spark, [], 1)).count() == 0
    assert clusters.cluster(table(spark, [(1, None), (2, [1.0])], 1)).count() == 0


def test_components_whose_squares_fit_no_long_stop_the_job(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        clusters.cluster(table(spark, [(1, [1e300] * 64)], 1)).count()


@pytest.mark.parametrize("width", [3, 12, 64])
def test_bounds_hold_and_filter(width):
    rng = np.random.default_rng(width)
    x = rng.integers(-300, 300, (500, width))
    x[:50] = x[0]
    simplex = clusters.Simplex(x[40:70])
    apexes = simplex.apex(simplex.distances(x))
    low, high = clusters.bounds(apexes, apexes[:80])
    square = ((x[:, None, :] - x[None, :80, :]) ** 2).sum(2)
    slack = clusters.SLACK * (1 + (apexes**2).sum(1)[:, None] + (apexes[:80] ** 2).sum(1)[None, :])
    assert (low - slack <= square).all() and (square <= high + slack).all()
    chosen, taken = clusters.nearest(x, apexes, x[100:108], simplex.apex(simplex.distances(x[100:108])))
    own = ((x[:, None, :] - x[None, 100:108, :]) ** 2).sum(2)
    assert (chosen == own.argmin(1)).all()
    if width == 3:  # the pivots span the space, so the bounds are the distances
        assert taken < 0.2 * own.size


def test_equal_centroids_go_to_the_smaller_number():
    x = np.arange(40).reshape(10, 4)
    simplex = clusters.Simplex(x[:1])
    c = np.array([x[3], x[3], x[8], x[8]])
    chosen, _ = clusters.nearest(x, simplex.apex(simplex.distances(x)), c, simplex.apex(simplex.distances(c)))
    assert set(chosen.tolist()) == {0, 2}
