"""Thinning in tiles, best cover and searches at sizes and corners where rounds or products used to grow."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetgrove.functions import likeness
from streetgrove.operators import graph
from streetgrove.operators import quality as Q
from streetgrove.operators import rules as R
from streetgrove.operators import spatial, tiles
from streetgrove.plans.queries import selection

POINT = "site_id long, point_id long, x double, y double"


def walk(points, gap, groups=None):
    """Points in order, each kept unless one kept before is nearer than the gap or of its group."""
    kept, used = {}, set()
    for site, i, x, y in points:
        if groups and (site, groups[i]) in used:
            continue
        cell = (site, math.floor(x / gap), math.floor(y / gap))
        around = (kept.get((site, cell[1] + a, cell[2] + b), ()) for a in (-1, 0, 1) for b in (-1, 0, 1))
        if all(math.hypot(x - p, y - q) >= gap for ps in around for _, p, q in ps):
            kept.setdefault(cell, []).append((i, x, y))
            if groups:
                used.add((site, groups[i]))
    return {i for ps in kept.values() for i, *_ in ps}


@pytest.mark.parametrize("tile_points", [12, 60, 100_000])
def test_tiles_equal_the_sequential_walk(spark, tile_points):
    rng = random.Random(tile_points)
    points = [(k % 2, k, round(rng.uniform(-150, 150), 3), round(rng.uniform(-150, 150), 3)) for k in range(1500)]
    points += [(0, 2000 + k, 7.0, 7.0) for k in range(10)] + [(0, 2100 + k, 7.0, 7.001) for k in range(10)]
    frame = spark.createDataFrame(points, POINT)
    got = {r.point_id for r in graph.first_spaced_points(frame, 6.0, tile_points=tile_points).collect()}
    assert got == walk(points, 6.0)


@pytest.mark.parametrize("tile_points", [15, 100_000])
def test_tiles_with_options_of_a_station_far_apart(spark, tile_points):
    rng = random.Random(9)
    points = [(0, k, round(rng.uniform(0, 400), 3), round(rng.uniform(0, 400), 3)) for k in range(900)]
    groups = {p[1]: rng.randint(0, 250) for p in points}
    frame = spark.createDataFrame([(*p, groups[p[1]]) for p in points], f"{POINT}, station long")
    got = {r.point_id for r in graph.first_spaced_points(frame, 9.0, group="station", tile_points=tile_points).collect()}
    assert got == walk(points, 9.0, groups)


def test_kerb_of_dependent_stations_in_few_rounds(spark):
    """Every station hangs on the one before it, over 20 km of kerb."""
    points = [(0, k, 2.0 * k, 3.0) for k in range(10_000)]
    frame, sides = spark.createDataFrame(points, POINT), []
    got = {r.point_id for r in graph.first_spaced_points(frame, 5.0, seen=sides.append).collect()}
    assert got == set(range(0, 10_000, 3)) and len(sides) == 1
    sides.clear()
    got = {r.point_id for r in graph.first_spaced_points(frame, 5.0, tile_points=2500, seen=sides.append).collect()}
    assert got == set(range(0, 10_000, 3)) and len(sides) <= 10


def test_a_spot_with_more_points_than_a_tile_may_hold(spark):
    rng = random.Random(1)
    points = [(0, k, 7.0, 7.0) if k % 3 == 0 else (0, k, round(rng.uniform(0, 60), 3), round(rng.uniform(0, 60), 3)) for k in range(600)]
    groups = {p[1]: p[1] // 2 for p in points}
    frame, sides = spark.createDataFrame([(*p, groups[p[1]]) for p in points], f"{POINT}, station long"), []
    got = {r.point_id for r in graph.first_spaced_points(frame, 4.0, tile_points=100, seen=sides.append).collect()}
    assert got == walk(points, 4.0) and sides == [0.0]
    got = {r.point_id for r in graph.first_spaced_points(frame, 4.0, tile_points=100, group="station").collect()}
    assert got == walk(points, 4.0, groups)


def test_points_without_a_place_are_not_kept(spark):
    frame = spark.createDataFrame([(0, 1, None, 1.0), (0, 2, float("nan"), 1.0), (0, 3, 1.0, float("inf")), (0, 4, 1.0, 1.0)], POINT)
    assert [r.point_id for r in graph.first_spaced_points(frame, 5.0).collect()] == [4]
    assert graph.first_spaced_points(frame.limit(0), 5.0).count() == 0


def brute_cover(rows):
    """Per (site, segment): length of each elementary stretch times the best weight over it."""
    total = {}
    for key in {r[:2] for r in rows}:
        own = [r[2:] for r in rows if r[:2] == key and r[4] is not None and r[4] > 0]
        ends = sorted({e for a, b, _ in own for e in (a, b)})
        for p, q in zip(ends, ends[1:], strict=False):
            total[key[0]] = total.get(key[0], 0.0) + (q - p) * max((w for a, b, w in own if a <= p and b >= q), default=0.0)
    return total


def test_best_cover_equals_elementary_stretches(spark):
    rng = random.Random(6)
    rows = []
    for site in range(2):
        for segment in range(4):
            for _ in range(60):
                a = rng.uniform(0, 300)
                rows.append((site, segment, a, a + rng.choice([0.0, 0.5, 20.0, 170.0]), rng.choice([0.0, 0.25, 0.5, 0.75, 1.0, rng.random()])))
    rows += [(0, 0, 64.0, 128.0, 0.9)] * 40 + [(0, 9, 1.0, 2.0, None), (1, 9, 5.0, 4.0, 1.0)]
    frame = spark.createDataFrame(rows, "site_id long, feature_id long, a double, b double, weight double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.site_id: r.weighted_m for r in Q.weighted_cover(frame, segment=("feature_id",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_cover(rows)
    assert set(got) == {s for s, v in want.items() if v}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_skyline_of_many_equal_weights_is_short():
    a = np.sort(np.random.default_rng(0).random(20_000))
    group, p, q, w = Q.skyline(np.zeros(20_000, np.int64), a, a + 1.0, np.ones(20_000))
    assert len(p) == 1 and (p[0], q[0], w[0]) == (a[0], a[-1] + 1.0, 1.0)
    assert all(len(x) == 0 for x in Q.skyline(*(np.zeros(0) for _ in range(4))))


def test_searches_end_for_points_without_a_place(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, None, 0.0), (1, 3, 5.0, float("nan")), (1, 4, float("inf"), 0.0), (2, 5, 0.0, 0.0)], POINT)
    roads = spark.createDataFrame(
        [(1, 7, 900.0, 0.0, 900.0, 10.0), (1, 8, None, 0.0, 1.0, 1.0), (1, 9, float("nan"), 0.0, 1.0, 1.0)], "site_id long, feature_id long, x1 double, y1 double, x2 double, y2 double")
    for rings in ((30.0,), ()):
        got = {r.point_id: (r.distance, r.feature_id) for r in spatial.nearest_segment(points, roads, rings).collect()}
        assert got == {1: (900.0, 7), 2: (None, None), 3: (None, None), 4: (None, None)}
    segments = roads.withColumns({"object_class": F.lit("curb"), "error_m": F.lit(0.0), "diameter_m": F.lit(0.0)})
    got = {r.point_id: r.axis_m for r in R.nearest_clearance(points, segments).collect()}
    assert got == {1: 900.0, 2: None, 3: None, 4: None}


def test_a_planting_without_a_place_has_no_data_for_its_norms(spark):
    points = spark.createDataFrame([(0, 1, "tree", 0.0, 9.0), (0, 2, "tree", None, 9.0)], "site_id long, point_id long, planting_type string, x double, y double")
    curb = spark.createDataFrame([(0, 9, "curb", -50.0, 0.0, 50.0, 0.0, 0.0, 0.0)], "site_id long, feature_id long, object_class string, x1 double, y1 double, x2 double, y2 double, error_m double, diameter_m double")
    book = spark.createDataFrame(
        [("C", "curb", "tree", 2.0, "edge", "forbid", "A")], "rule_id string, object_class string, planting_type string, min_distance_m double, measure_to string, severity string, act_id string")
    presence = R.utility_presence(curb, spark.createDataFrame([(0,)], "site_id long"))
    for clearance in (R.nearest_clearance(points, curb), R.nearest_clearance(points, curb, reach={"curb": 2.0})):
        facts = R.checks(points, book, clearance, presence)
        assert {r.point_id: r.outcome for r in facts.collect()} == {1: "pass", 2: "no_data"}
        assert {r.point_id: r.verdict for r in R.verdicts(facts).collect()} == {1: "allowed", 2: "needs_approval"}


@pytest.mark.parametrize("span", [6.0, 60.0])
def test_crowded_classes_are_met_in_narrow_rings(spark, span, monkeypatch):
    """A hundred objects and more near a point: each ring meets a few, and values and ids are those of all pairs."""
    rng = random.Random(int(span))
    points = [(0, k, rng.uniform(0, span), rng.uniform(0, span)) for k in range(60)] + [(0, 7, 1.0, 1.0), (0, 99, None, 1.0)]
    rows = []
    for k in range(400):
        x, y, far = rng.uniform(0, span), rng.uniform(0, span), rng.uniform(-3, 3)
        rows.append((0, 1000 - k, "curb" if k % 8 else "fence", x, y, x + far, y + rng.uniform(-3, 3), 0.0 if k % 3 else 0.05, 0.4 if k % 2 else None))
    rows += [(0, 2000 + i, *r[2:]) for i, r in enumerate(rows[:20])] + [(0, 5, "pole", span + 80.0, 0.0, span + 80.0, 1.0, 0.0, 0.0)]
    segments = spark.createDataFrame(rows, "site_id long, feature_id long, object_class string, x1 double, y1 double, x2 double, y2 double, error_m double, diameter_m double")
    frame = spark.createDataFrame(points, POINT)
    narrow = [({"curb": 0.2, "fence": 0.5, "pole": 0.9}, 1.0), ({"curb": 0.5, "fence": 1.25, "pole": 1.0}, 2.5)]
    dense = spatial.crowded_radii(frame.where("x is not null"), segments.unionAll(segments.crossJoin(spark.range(200).select())), {"curb": 20.0, "fence": 20.0, "pole": 1.0})
    assert len(dense) == 2 and dense[0][0]["curb"] < dense[1][0]["curb"] < 20.0
    monkeypatch.setattr(spatial, "crowded_radii", lambda *a, **k: narrow)
    for reach in (None, {"curb": 2.0, "fence": 4.0, "pole": 1.0}):
        got = sorted((r.point_id, r.object_class, r.axis_m, r.axis_id, r.wall_m, r.wall_id) for r in R.nearest_clearance(frame, segments, reach=reach).collect() if r.axis_m is not None)
        want, asked = [], [p for p in points if p[2] is not None]
        for cls in ("curb", "fence", "pole"):
            for p in asked if reach is None else {q[1]: q for q in asked}.values():
                twins = [q for q in asked if q[1] == p[1]]
                near = [(distance(q, r), r) for q in twins for r in rows if r[2] == cls]
                near = [(d, r) for d, r in near if reach is None or d <= reach[cls] + r[7] + (r[8] or 0.0) / 2]
                if near:
                    a = min((max(0.0, d - r[7]), r[1]) for d, r in near)
                    w = min((max(0.0, d - r[7] - (r[8] or 0.0) / 2), r[1]) for d, r in near)
                    want.append((p[1], cls, *a, *w))
        assert [(g[0], g[1], g[3], g[5]) for g in got] == [(w[0], w[1], w[3], w[5]) for w in sorted(want)]
        assert all(abs(g[2] - w[2]) < 1e-9 and abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, sorted(want), strict=True))


def distance(p, r):
    (x, y), (x1, y1, x2, y2) = p[2:4], r[3:7]
    dx, dy = x2 - x1, y2 - y1
    t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def test_areas_over_one_another_are_not_listed_a_point(spark):
    rng = random.Random(4)
    points = [(k % 2, k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(400)] + [(0, 900, None, 1.0), (0, 2, 50.0, 50.0)]
    boxes = [(k % 2, k, ("a", "b", "c")[k % 3], rng.uniform(-20, 80), rng.uniform(-20, 80), rng.uniform(5, 80), rng.uniform(5, 80)) for k in range(120)]
    boxes += [boxes[7], (0, 8, boxes[8][2], 10.0, 10.0, 30.0, 30.0)]  # drawn twice; a second ring of one area is a hole where they overlap
    edges = []
    for s, f, c, x, y, w, d in boxes:
        ring = [(x, y), (x + w, y), (x + w, y + d), (x, y + d), (x, y)]
        edges += [(s, f, c, *a, *b) for a, b in zip(ring, ring[1:], strict=False)]
    edges += [(0, 500, "c", 5.0, 0.0, 5.0, 90.0), (0, 501, "c", None, 0.0, 5.0, 9.0)]  # do not close
    rings = spark.createDataFrame(edges, "site_id long, feature_id long, object_class string, x1 double, y1 double, x2 double, y2 double")
    frame = spark.createDataFrame(points, POINT)
    want = {(r.site_id, r.point_id, r.object_class): r.f for r in spatial.contained(frame, rings, point_key=("point_id",), area_key=("feature_id", "object_class")).groupBy(
        "site_id", "point_id", "object_class").agg(F.min("feature_id").alias("f")).collect()}
    for many in (0.0, 1e9):
        rows = spatial.lowest_areas(frame, rings, many=many).collect()
        assert {(r.site_id, r.point_id, r.object_class): r.feature_id for r in rows} == want and len(rows) == len(want)
    held = {k for k in want if k[1] < 900 and k[1] != 2}
    inside = {(p[0], p[1], b[2]) for p in points[:400] for b in boxes if p[1] != 2 and b[1] not in (7, 8) and b[0] == p[0] and b[3] < p[2] < b[3] + b[5] and b[4] < p[3] < b[4] + b[6]}
    assert inside <= held


def test_nearest_clearance_searches_a_dense_site_once(spark, monkeypatch):
    """Points and segments meet once in tiles, hot ones dealt to several groups; no pairs of a ring are joined, and values and ids are those of all pairs."""
    rng = random.Random(5)
    points = [(s, s * 1000 + k, rng.uniform(0, 90), rng.uniform(0, 90)) for s in (1, 2) for k in range(150)]
    rows = []
    for k in range(1500):
        x, y, far = rng.uniform(-5, 95), rng.uniform(-5, 95), rng.choice((0.0, 9.0, -9.0))
        rows.append((1 + k % 2, 5000 - k // 2 * 2, "curb" if k % 3 else "fence", x, y, x + far, y + (0.0 if far else 9.0), 0.01 if k % 5 else None, 0.4 if k % 7 else None))
    segments = spark.createDataFrame(rows, "site_id long, feature_id long, object_class string, x1 double, y1 double, x2 double, y2 double, error_m double, diameter_m double")
    monkeypatch.setattr(tiles, "HOT_POINTS", 20)
    monkeypatch.setattr(tiles, "TILE_POINTS", 60)
    monkeypatch.setattr(tiles, "PAIRS", 50)
    joined = []
    whole = spatial.near_segments
    monkeypatch.setattr(spatial, "near_segments", lambda *a, **k: joined.append(1) or whole(*a, **k))
    for reach in (None, {"curb": 3.0, "fence": 1.0}):
        got = {(r.point_id, r.object_class): (r.axis_m, r.axis_id, r.wall_m, r.wall_id) for r in R.nearest_clearance(spark.createDataFrame(points, POINT), segments, reach=reach).collect()}
        want = {}
        for p in points:
            for cls in ("curb", "fence"):
                near = [(distance(p, r), r[7] or 0.0, (r[8] or 0.0) / 2, r[1]) for r in rows if r[0] == p[0] and r[2] == cls]
                near = [n for n in near if reach is None or n[0] <= reach[cls] + n[1] + n[2]]
                if near:
                    want[p[1], cls] = (*min((max(0.0, d - e), i) for d, e, _, i in near), *min((max(0.0, d - e - h), i) for d, e, h, i in near))
        assert got.keys() == want.keys()
        assert all(abs(got[k][i] - want[k][i]) < 1e-9 and got[k][i + 1] == want[k][i + 1] for k in got for i in (0, 2))
        assert reach is None or not joined
        joined.clear()


def test_likeness_lists_no_pairs_within_its_cap(spark, monkeypatch):
    """The nearest object of each class decides; the objects within 40 m of a place are never listed."""
    rng = random.Random(8)
    points = [(1, k, rng.uniform(0, 60), rng.uniform(0, 60)) for k in range(40)]
    rows = []
    for k in range(600):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        rows.append((1, k, ("curb", "fence", "pole")[k % 3], x, y, x + rng.uniform(0, 4), y, 0.5, 0.4))
    tables = SimpleNamespace(
        spark=spark, points=spark.createDataFrame(points, POINT),
        segments=spark.createDataFrame(rows, "site_id long, feature_id long, object_class string, x1 double, y1 double, x2 double, y2 double, error_m double, diameter_m double"))
    monkeypatch.setattr(spatial, "near_segments", lambda *a, **k: pytest.fail("pairs are listed"))
    got = {r.point_id: r.likeness for r in selection.likeness_score(tables).collect()}
    bins = likeness.rows()
    for p in points:
        logit = likeness.INTERCEPT
        for cls, terms in likeness.TERMS.items():
            d = min((distance(p, r) for r in rows if r[2] == cls), default=likeness.CAP_M + 1)
            logit += next((w for c, low, high, w in bins if c == cls and low <= d < high), terms[-1]) if d <= likeness.CAP_M else terms[-1]
        assert abs(got[p[1]] - 1 / (1 + math.exp(-logit))) <= 1e-5
