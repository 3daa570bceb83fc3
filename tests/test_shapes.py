"""Lists, rings, axes, quantiles, rays, walls and discs against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetgrove.operators import chains, names, scan, spatial
from streetgrove.operators import drawing as D

EDGE = "site_id long, feature_id long, x1 double, y1 double, x2 double, y2 double"


def test_lists_of_any_length_are_ranked(spark):
    arcs = [(k, k + 1 if k < 500 else None, 1.0) for k in range(501)]  # an open list
    arcs += [(1000 + k, 1000 + (k + 7) % 300, 2.0) for k in range(300)] + [(5000, 5000, 3.0), (6000, None, 4.0)]  # a ring, a loop, one alone
    got = {r.arc: r for r in chains.rank_lists(spark.createDataFrame(arcs, "arc long, hop long, length_m double").repartition(5)).collect()}
    assert all(got[k].steps == 501 - k and got[k].head == 500 and not got[k].ring for k in range(501))
    at, seen = 1000, []
    for _ in range(300):
        seen.append(at)
        at = 1000 + (at - 1000 + 7) % 300
    assert [got[a].steps for a in seen] == list(range(300, 0, -1)) and all(got[a].ring and got[a].length_m == 2.0 * got[a].steps for a in seen)
    assert got[5000].ring and got[5000].steps == 1 and not got[6000].ring and got[6000].length_m == 4.0


def strokes(ring, first, site=0, shuffle=None, close=True):
    """Pieces of a polygon in any order and direction."""
    ends = list(zip(ring, ring[1:] + ring[:1], strict=True))[: None if close else -1]
    rows = [(site, first + k, *(a + b if shuffle is None or shuffle.random() < 0.5 else b + a)) for k, (a, b) in enumerate(ends)]
    if shuffle:
        shuffle.shuffle(rows)
    return rows


def shoelace(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_rings_are_put_together_and_shrunk(spark):
    rng = random.Random(3)
    star = [(round(50 + (30 if k % 2 else 18) * math.cos(0.4 * k), 3), round(50 + (30 if k % 2 else 18) * math.sin(0.4 * k), 3)) for k in range(15)]
    box, gapped = [(200.0, 0.0), (260.0, 0.0), (260.0, 40.0), (230.0, 40.0), (200.0, 40.0)], [(300.0, 0.0), (400.0, 0.0), (400.0, 100.0), (300.0, 100.0), (300.0, 1.0)]
    wide, lone = [(500.0, 0.0), (540.0, 0.0), (540.0, 30.0)], [(600.0, 0.0), (610.0, 0.0)]
    rows = strokes(star, 0, shuffle=rng) + strokes(box, 100, shuffle=rng) + strokes(gapped, 200, shuffle=rng, close=False) + strokes(wide, 300, shuffle=rng, close=False) + strokes(lone, 400, close=False)
    rows += strokes([(p[0], p[1]) for p in box], 1000, site=1) + [(0, 900, None, 0.0, 1.0, 1.0), (0, 901, 5.0, 5.0, 5.0, 5.0)]
    pieces = spark.createDataFrame(rows, "site_id long, piece_id long, x1 double, y1 double, x2 double, y2 double")
    lines = chains.lines_of_pieces(pieces)
    ordered = {}
    for r in sorted(lines.collect(), key=lambda r: r.place):
        ordered.setdefault((r.site_id, r.line), []).append(r)
    assert {k: (len(v), v[0].closed) for k, v in ordered.items()} == {(0, 0): (15, True), (0, 100): (5, True), (0, 200): (4, False), (0, 300): (2, False), (0, 400): (1, False), (1, 1000): (5, True)}
    for own in ordered.values():
        assert all((a.x2, a.y2) == (b.x1, b.y1) for a, b in zip(own, own[1:], strict=False))
        assert not own[0].closed or (own[-1].x2, own[-1].y2) == (own[0].x1, own[0].y1)
    errors = spark.createDataFrame([(0, 0.0), (100, 2.0), (200, 0.5), (1000, 25.0)], "line long, error_m double")
    got = {r.line: r for r in chains.closed_areas(lines, errors, D.bridgeable).collect()}
    assert abs(got[0].area_m2 - shoelace(star)) < 1e-6 and got[0].gap_m == 0 and got[0].closed
    assert abs(got[100].area_m2 - 56 * 36) < 1e-6 and got[1000].area_m2 == 0.0
    assert got[200].closed and abs(got[200].gap_m - 1) < 1e-9 and abs(got[200].area_m2 - 99 * 99) < 1e-6
    assert not got[300].closed and got[300].area_m2 is None and not got[400].closed
    assert chains.lines_of_pieces(pieces.limit(0)).count() == 0


def test_shrinking_with_inward_and_outward_corners(spark):
    """An L gives up strips that share squares at outer corners, and a quarter of a disc at the inner one."""
    ring = [(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0), (10.0, 30.0), (0.0, 30.0)]
    for corners in (ring, ring[::-1]):
        lines = chains.lines_of_pieces(spark.createDataFrame(strokes(corners, 0), "site_id long, piece_id long, x1 double, y1 double, x2 double, y2 double"))
        (row,) = chains.closed_areas(lines, spark.createDataFrame([(0, 1.0)], "line long, error_m double"), D.bridgeable).collect()
        assert abs(row.area_m2 - (400 - 100 + 5 - math.pi / 4)) < 1e-9


def test_axis_follows_a_bend(spark):
    bend = [(5.0 * k, 3.0) for k in range(100)] + [(500.0, 5.0 * k) for k in range(100)]
    straight = [(5.0 * k, 2000.0 + 12 * (k % 2)) for k in range(200)]
    rows = [(0, *p) for p in bend] + [(1, *p) for p in straight] + [(2, 1.0, 1.0), (3, 0.0, 0.0), (3, 900.0, 900.0)]
    frame = spark.createDataFrame(rows, "site_id long, x double, y double")
    got = {r.site_id: (r.cell_m, r.length_m) for r in chains.axis_lengths(frame).collect()}
    assert 920 < got[0][1] < 1010 and 920 < got[1][1] < 1010 and got[2][1] == 0.0 and got[3][1] == 0.0
    principal = math.hypot(500, 500)
    assert got[0][1] > 1.25 * principal
    coarse = {r.site_id: (r.cell_m, r.length_m) for r in chains.axis_lengths(frame, most=12).collect()}
    assert coarse[0][0] == 100.0 and coarse[2][0] == 25.0 and 800 < coarse[0][1] < 1010


@pytest.mark.parametrize("shares", [(0.5,), (0.0, 0.05, 0.5, 0.95, 1.0)])
def test_quantiles_equal_sorting(spark, shares):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=4001) * 10.0 ** rng.integers(-9, 9, 4001), "b": np.repeat([1.0, 2.0, 7.0], [500, 1, 500]), "c": np.array([3.5]), "d": np.array([1.0, 2.0]), "e": np.full(900, -0.25), "f": np.array([-1.7e308, 0.0, 1.7e308, 5.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("z", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in scan.order_statistics(frame, "v", shares, by=("g",)).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        want = np.quantile(values, shares)
        assert got[g].n == len(values) and np.allclose([got[g][f"q{k}"] for k in range(len(shares))], want, rtol=1e-12, atol=0, equal_nan=True) or g == "f"
    whole = scan.order_statistics(frame, "v", (0.5,), by=()).first()
    assert abs(whole.q0 - np.median(np.concatenate(list(groups.values())))) < 1e-12
    assert scan.order_statistics(frame.limit(0), "v", (0.5,), by=("g",)).count() == 0


def hit_of(ray, lines, own):
    """Nearest hit of a ray by exact arithmetic on parameters."""
    ax, ay, bx, by = ray
    n = math.hypot(bx - ax, by - ay)
    ux, uy = (bx - ax) / n, (by - ay) / n
    best = None
    for _, f, x1, y1, x2, y2 in lines:
        if f == own:
            continue
        ex, ey = x2 - x1, y2 - y1
        across = ux * ey - uy * ex
        if across == 0:
            if abs((x1 - ax) * uy - (y1 - ay) * ux) > 1e-6:
                continue
            ends = sorted(((x1 - ax) * ux + (y1 - ay) * uy, (x2 - ax) * ux + (y2 - ay) * uy))
            at = max(0.0, ends[0]) if ends[1] >= 0 else None
        else:
            part = ((x1 - ax) * uy - (y1 - ay) * ux) / across
            at = ((x1 - ax) * ey - (y1 - ay) * ex) / across if 0 <= part <= 1 else None
        if at is not None and 1e-6 < at <= n and (best is None or (at, f) < best):
            best = (at, f)
    return best


def test_rays_end_at_the_first_line(spark):
    rng = random.Random(5)
    lines = [(0, f, *(round(rng.uniform(-60, 60), 2) for _ in range(4))) for f in range(80)] + [(0, 100, 0.0, 0.0, 10.0, 0.0), (0, 101, 13.0, 0.0, 15.0, 0.0), (0, 102, 12.0, -3.0, 12.0, -1.0)]
    rays = [(0, k, k, round(rng.uniform(-60, 60), 2), round(rng.uniform(-60, 60), 2), round(rng.uniform(-60, 60), 2), round(rng.uniform(-60, 60), 2)) for k in range(40)] + [(0, 900, 100, 10.0, 0.0, 40.0, 0.0)]
    got = spatial.first_hits(spark.createDataFrame(rays, "site_id long, ray long, feature_id long, ax double, ay double, bx double, by double"), spark.createDataFrame(lines, EDGE), key=("site_id", "ray"), cell=7.0)
    found = {r.ray: (round(r.along_m, 9), r.hit) for r in got.collect()}
    want = {k: hit_of(ray, lines, own) for _, k, own, *ray in rays}
    assert found == {k: (round(h[0], 9), h[1]) for k, h in want.items() if h}


def test_hanging_end_is_run_on(spark):
    lines = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 0.0), (0, 2, 11.5, -5.0, 11.5, 5.0), (0, 3, 0.0, 1.2, -9.0, 1.2), (0, 4, 12.9, 0.0, 30.0, 0.0)], EDGE)
    kept = D.match_ends(D.gap_pairs(lines, 2.0), ("distance", "a_end_id", "b_end_id"))
    got = {(r.end_id, round(r.along_m, 6), r.hit) for r in D.extensions(lines, lines, kept, 2.0).collect()}
    assert got == {(3, 1.5, 2), (8, 1.4, 2)}


def brute_walls(edges, gap):
    total = {}
    for _, fa, *a in edges:
        for _, fb, *b in edges:
            if fa >= fb:
                continue
            la = math.hypot(a[2] - a[0], a[3] - a[1])
            ux, uy = (a[2] - a[0]) / la, (a[3] - a[1]) / la
            lb = math.hypot(b[2] - b[0], b[3] - b[1])
            if abs(ux * (b[3] - b[1]) - uy * (b[2] - b[0])) / lb > 1e-6:
                continue
            if abs(((b[0] + b[2]) / 2 - a[0]) * uy - ((b[1] + b[3]) / 2 - a[1]) * ux) > gap:
                continue
            ends = sorted(((x - a[0]) * ux + (y - a[1]) * uy) for x, y in ((b[0], b[1]), (b[2], b[3])))
            common = min(la, ends[1]) - max(0.0, ends[0])
            if common > 1e-9:
                total[fa, fb] = total.get((fa, fb), 0.0) + common
    return total


def test_shared_walls_of_turned_houses(spark):
    edges = []
    for k, angle in enumerate((0.0, 0.3, math.pi / 2, -1.2, 1.5707963, 3.0)):
        for i in range(6):
            x0, w, d = i * 11.0, 11.0, 6.0 + 3 * (i % 3)
            ring = [(x0, 0.0), (x0 + w, 0.0), (x0 + w, d), (x0, d)]
            turned = [(1000.0 * k + x * math.cos(angle) - y * math.sin(angle), 700.0 + x * math.sin(angle) + y * math.cos(angle)) for x, y in ring]
            way = turned if i % 2 else turned[::-1]
            edges += [(0, 100 * k + i, *a, *b) for a, b in zip(way, way[1:] + way[:1], strict=True)]
    edges += [(0, 5000, 0.0, -50.0, 600.0, -50.0), (0, 5001, 590.0, -50.01, 640.0, -50.01), (0, 5002, 590.0, -50.05, 640.0, -50.05)]
    got = {(r.a, r.b): r.shared_m for r in spatial.shared_walls(spark.createDataFrame(edges, EDGE.replace("feature_id", "face"))).collect()}
    want = brute_walls(edges, 0.02)
    assert {k: round(v, 4) for k, v in got.items() if v > 0.1} == {k: round(v, 4) for k, v in want.items() if v > 0.1}
    assert got[5000, 5001] == pytest.approx(10.0) and (5000, 5002) not in got


def plan_size(frame):
    return len(frame._jdf.queryExecution().optimizedPlan().toString())


def test_plan_of_walls_names_its_columns(spark):
    """Corners that are terms themselves are not repeated in every term made of them, and an edge is entered under few values."""
    corner = [(F.col(c) + F.col("face") * 1000 / 7).alias(c) for c in ("x1", "y1", "x2", "y2")]
    edges = spark.createDataFrame([(0, 1, 0.0, 0.0, 24.0, 0.0), (0, 2, 24.0, 0.0, 24.0, 9.0)], EDGE.replace("feature_id", "face")).select("site_id", "face", *corner)
    assert plan_size(spatial.shared_walls(edges)) < 30_000


def greedy_bridges(lines, offers):
    ends = []
    for _, f, x1, y1, x2, y2 in lines:
        n = math.hypot(x2 - x1, y2 - y1)
        ends += [(2 * f, f, x1, y1, (x1 - x2) / n, (y1 - y2) / n), (2 * f + 1, f, x2, y2, (x2 - x1) / n, (y2 - y1) / n)]
    pairs = [(math.hypot(a[2] - b[2], a[3] - b[3]), a, b) for a in ends for b in ends if a[0] < b[0] and a[1] != b[1]]
    used = {e[0] for d, *ab in pairs if d <= 1e-6 for e in ab}
    found = set()
    for number, (gap, fits) in enumerate(offers):
        for d, a, b in sorted((p for p in pairs if p[0] <= gap and fits(*p)), key=lambda p: (p[0], p[1][0], p[2][0])):
            if not used & {a[0], b[0]}:
                used |= {a[0], b[0]}
                found.add((a[0], b[0], number))
    return found


def test_bridges_equal_the_sequential_greedy(spark):
    """Dense ends are matched in stages and chains of equal gaps one after another; the listed pairs stay few."""
    rng = random.Random(8)
    lines = []
    for f in range(400):
        x, y = round(rng.uniform(0, 30), 1), round(rng.uniform(0, 30), 1)
        lines.append((0, f, x, y, x + (2.0 if f % 2 else 0.0), y + (0.0 if f % 2 else 2.0)))
    lines += [(0, 500 + k, 100.0 + 3.0 * k, 0.0, 102.0 + 3.0 * k, 0.0) for k in range(12)]
    frame = spark.createDataFrame(lines, EDGE)
    got = D.bridges(frame, [(4.0, F.lit(True))])[0]
    assert {(r.a_end_id, r.b_end_id, r.offer) for r in got.collect()} == greedy_bridges(lines, [(4.0, lambda *p: True)])

    def straight(d, a, b):
        tx, ty = (b[2] - a[2]) / d, (b[3] - a[3]) / d
        return a[4] * tx + a[5] * ty >= 0.5 and -(b[4] * tx + b[5] * ty) >= 0.5 and -(a[4] * b[4] + a[5] * b[5]) >= 0.5

    ahead = F.coalesce(D.continues(0.5), F.lit(False))
    got = D.bridges(frame, [(6.0, ahead), (3.0, ~ahead)])[0]
    want = greedy_bridges(lines, [(6.0, lambda d, a, b: d > 1e-6 and straight(d, a, b)), (3.0, lambda d, a, b: d > 1e-6 and not straight(d, a, b))])
    assert {(r.a_end_id, r.b_end_id, r.offer) for r in got.collect()} == want


def test_storeys_come_from_the_longest_shared_wall(spark):
    faces = [(1, 50.0, 9, None, None, False, False), (2, 50.0, None, None, None, False, False), (3, 50.0, 3, None, None, False, False), (4, 50.0, None, "brick", None, False, False), (5, 700.0, None, None, None, False, False), (6, 50.0, None, None, None, True, False)]
    walls = [(1, 2, 4.0), (2, 3, 6.0), (2, 4, 9.0), (3, 4, 1.9), (1, 6, 9.0), (4, 5, 8.0)]
    got = {r.face: (r.floors, r.source, r.height_m) for r in names.heights(
        spark.createDataFrame(faces, "face long, area double, floors int, wall string, use string, porch boolean, container boolean"), spark.createDataFrame(walls, "a long, b long, shared_m double")).collect()}
    assert got == {1: (9, "label", 28.2), 2: (3, "neighbor", 10.2), 3: (3, "label", 10.2), 4: (1, "letter", 4.0), 5: (5, "assumed", 16.2), 6: (None, "letter", 0.45)}


def test_discs_covered_by_touching_areas(spark):
    def box(f, x0, y0, x1, y1):
        return [(0, f, x0, y0, x1, y0), (0, f, x1, y0, x1, y1), (0, f, x1, y1, x0, y1), (0, f, x0, y1, x0, y0)]

    rings = box(1, 0.0, 0.0, 10.0, 10.0) + box(2, 10.0, 0.0, 20.0, 10.0) + box(3, 20.0, 4.0, 30.0, 10.0) + box(4, 18.0, 8.0, 26.0, 20.0) + box(5, 0.0, 0.0, 10.0, 10.0)
    rings += box(6, 40.0, 0.0, 60.0, 20.0) + box(6, 49.0, 9.0, 51.0, 11.0)  # with a hole
    rng = random.Random(2)
    discs = [(0, k, round(rng.uniform(-2, 62), 3), round(rng.uniform(-2, 22), 3), rng.choice([0.5, 1.24, 3.0])) for k in range(600)]
    discs += [(0, 1000, 10.0, 5.0, 3.0), (0, 1001, 20.0, 5.5, 1.4), (0, 1002, 20.0, 4.5, 1.4), (0, 1003, 50.0, 13.0, 1.9), (0, 1004, 50.0, 13.0, 2.1), (0, 1005, 50.0, 10.0, 0.5), (0, 1006, None, 1.0, 1.0)]
    areas = spark.createDataFrame(rings, EDGE)
    got = {r.point_id for r in spatial.discs_covered(spark.createDataFrame(discs, "site_id long, point_id long, x double, y double, radius double"), areas, widest=3.0).collect()}
    solid, hole = [(0, 0, 10, 10), (10, 0, 20, 10), (20, 4, 30, 10), (18, 8, 26, 20), (40, 0, 60, 20)], (49, 9, 51, 11)

    def covered(x, y, r):
        xs, ys = ({c - r, c + r} | {float(v) for b in (*solid, hole) for v in b[i::2] if abs(v - c) < r} for i, c in ((0, x), (1, y)))
        xs, ys = sorted(xs), sorted(ys)
        for x0, x1 in zip(xs, xs[1:], strict=False):
            for y0, y1 in zip(ys, ys[1:], strict=False):
                if math.hypot(max(x0 - x, x - x1, 0), max(y0 - y, y - y1, 0)) < r - 1e-9:
                    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
                    if not any(a <= mx <= c and b <= my <= d for a, b, c, d in solid) or (hole[0] < mx < hole[2] and hole[1] < my < hole[3]):
                        return False
        return True

    want = {k for _, k, x, y, r in discs if x is not None and covered(x, y, r)}
    assert got == want and {1000, 1001, 1003} <= got and not {1002, 1004, 1005, 1006} & got
