"""Operators against brute force on dense fixtures, corner cases and the stream against the batch."""

import math
import random

import pytest
from pyspark.sql import functions as F

from streetgrove.functions import sun
from streetgrove.operators import edits as E
from streetgrove.operators import graph, names, planting, rules, scan, spatial, surface

SEG = "site_id long, feature_id long, object_class string, x1 double, y1 double, x2 double, y2 double, error_m double, diameter_m double"


def scatter(n, span, seed):
    rng = random.Random(seed)
    return [(0, i, round(rng.uniform(0, span), 3), round(rng.uniform(0, span), 3)) for i in range(n)]


def walk(points, gap, groups=None):
    kept, used = [], set()
    for _, i, x, y in points:
        if groups and groups[i] in used:
            continue
        if all(math.hypot(x - a, y - b) >= gap for _, _, a, b in kept):
            kept.append((0, i, x, y))
            if groups:
                used.add(groups[i])
    return {p[1] for p in kept}


@pytest.mark.parametrize("hot", [False, True])
def test_thinning_equals_the_sequential_walk(spark, hot):
    points = scatter(300, 40, 3)
    if hot:  # a third of the points in one spot
        points = [(0, i, 7.0, 7.0) if i % 3 == 0 else p for i, p in enumerate(points)]
        points = [(0, i, p[2], p[3]) for i, p in enumerate(points)]
    df = spark.createDataFrame(points, "site_id long, point_id long, x double, y double")
    got = {r.point_id for r in graph.first_spaced_points(df, 5.0).collect()}
    assert got == walk(points, 5.0)


def test_thinning_with_one_option_per_station(spark):
    points = scatter(120, 30, 5)
    groups = {i: i // 3 for _, i, *_ in points}
    df = spark.createDataFrame([(*p, groups[p[1]]) for p in points], "site_id long, point_id long, x double, y double, station long")
    got = {r.point_id for r in graph.first_spaced_points(df, 5.0, group="station").collect()}
    assert got == walk(points, 5.0, groups)


def test_independent_set_on_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(10)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert sorted(r.id for r in graph.first_independent_set(nodes, edges, order=("id",)).collect()) == [0, 2, 4, 6, 8]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 140), 999]], "id long")
    rows = graph.connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r.id: r.component for r in rows}
    assert {label[i] for i in range(41)} == {0} and {label[i] for i in range(100, 140)} == {100} and label[999] == 999


def point_segment(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / n))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def test_near_segments_and_clearance_equal_all_pairs(spark):
    rng = random.Random(11)
    points = scatter(60, 60, 7)
    segments = []
    for i in range(40):
        x, y, a, length = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 6.3), rng.choice([0.0, 3.0, 50.0])
        segments.append((0, i, "utility.water", x, y, x + length * math.cos(a), y + length * math.sin(a), rng.choice([0.0, 0.3]), rng.choice([0.0, 1.6])))
    p = spark.createDataFrame(points, "site_id long, point_id long, x double, y double")
    s = spark.createDataFrame(segments, SEG)
    got = {(r.point_id, r.feature_id) for r in spatial.near_segments(p, s, 4.0, hot_rows=5).collect()}
    want = {(q[1], g[1]) for q in points for g in segments if point_segment(q[2], q[3], *g[3:7]) <= 4.0}
    assert got == want
    best = {r.point_id: (round(r.axis_m, 6), round(r.wall_m, 6)) for r in rules.nearest_clearance(p, s, rings=(3.0, 20.0, 500.0)).collect()}
    for _, i, x, y in points:
        axis = min(max(0, point_segment(x, y, *g[3:7]) - g[7]) for g in segments)
        wall = min(max(0, point_segment(x, y, *g[3:7]) - g[7] - g[8] / 2) for g in segments)
        assert best[i] == (round(axis, 6), round(wall, 6))


def test_norms_at_the_threshold_and_without_data(spark):
    points = spark.createDataFrame([(0, 1, "tree", 0.0, 2.0), (0, 2, "tree", 0.0, 1.999), (0, 3, "tree", 0.0, 1.997), (1, 4, "tree", 0.0, 0.0)], "site_id long, point_id long, planting_type string, x double, y double")
    pipe = spark.createDataFrame([(0, 9, "curb", -50.0, 0.0, 50.0, 0.0, 0.0, 0.0)], SEG)
    book = spark.createDataFrame(
        [("C", "curb", "tree", 2.0, "edge", "forbid", "A", None, [], None, [], True), ("W", "utility.water", "tree", 2.0, "outer_wall", "forbid", "A", None, [], None, [], True)],
        "rule_id string, object_class string, planting_type string, min_distance_m double, measure_to string, severity string, act_id string, edition string, genera array<string>, min_crown_m double, traits array<string>, table91 boolean")
    sites = spark.createDataFrame([(0,), (1,)], "site_id long")
    presence = rules.utility_presence(pipe, sites)
    facts = rules.checks(points, book, rules.nearest_clearance(points, pipe, reach={"curb": 2.0}), presence)
    out = {(r.point_id, r.rule_id): r.outcome for r in facts.collect()}
    assert out[1, "C"] == "pass" and out[2, "C"] == "pass" and out[3, "C"] == "fail"  # 1 mm of tolerance
    assert out[4, "C"] == "pass" and out[4, "W"] == "no_data"  # class absent, no network known
    verdicts = {r.point_id: r.verdict for r in rules.verdicts(facts).collect()}
    assert verdicts[3] == "forbidden" and verdicts[1] == "needs_approval"


def test_prefix_sum_over_a_hot_group(spark):
    rows = [("hot", i, 1) for i in range(500)] + [("cold", i, 2) for i in range(3)]
    out = scan.prefix_sum(spark.createDataFrame(rows, "g string, k long, v long"), "v", by=("g",), order=("k",)).collect()
    assert all(r.running == (r.k + 1) * r.v for r in out) and len(out) == 503


def test_hole_of_a_polygon_is_outside(spark):
    ring = lambda a, b, i: [(0, 1, i, a, a, b, a), (0, 1, i, b, a, b, b), (0, 1, i, b, b, a, b), (0, 1, i, a, b, a, a)]
    rings = spark.createDataFrame(ring(0.0, 100.0, 0) + ring(40.0, 60.0, 1), "site_id long, feature_id long, ring_id int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(0, 1, 50.0, 50.0), (0, 2, 20.0, 50.0), (0, 3, 120.0, 50.0)], "site_id long, point_id long, x double, y double")
    assert [r.point_id for r in spatial.contained(points, rings, point_key=("point_id",), area_key=("feature_id",)).collect()] == [2]


def test_cell_components_and_spread(spark):
    free = [(0, r, c) for r in range(6) for c in range(6) if c != 3 or r == 5]  # a wall with a gate
    cells = spark.createDataFrame(free, "site_id long, row int, col int")
    assert surface.components(cells).select("face").distinct().count() == 1
    seeds = spark.createDataFrame([(0, 0, 0, "soil"), (0, 0, 5, "paved")], "site_id long, row int, col int, kind string")
    cost = {(r.row, r.col, r.kind): r.cost for r in surface.spread(cells, seeds, 20).collect()}
    assert cost[0, 2, "soil"] == 2 and cost[0, 4, "soil"] == 14 and cost[5, 3, "paved"] == 7


def test_names_speak_the_project_grammar(spark):
    words = {
        "Газон за счёт АБ ТР": "lawn", "ГЗН-АБ ТР": "lawn", "АБ ТР-ГЗН": "sidewalk", "Деревья проект": "ignore", "Деревья сущ": "existing_tree", "Кабель связи": "utility.telecom",
        "край дороги": "curb", "подпись газона": "ignore", "контур": "contour", "бр100": "curb",
    }
    df = spark.createDataFrame([(n,) for n in words], "name string")
    got = {r.name: r.object_class for r in names.vocabulary_class(df).collect()}
    assert got == words


def test_given_counts_equal_the_sequential_walk(spark):
    rng = random.Random(2)
    units = [(0, f"u{i:02d}", rng.randint(1, 6)) for i in range(25)]
    options = [(0, u, s, rng.randint(1, size), rng.randint(1, 50)) for _, u, size in units for s in range(4) if rng.random() < 0.7]
    caps = {0: 9, 1: 14, 2: 5, 3: 11}
    left, want = dict(caps), {}
    for _, u, _ in sorted(units, key=lambda r: (-r[2], r[1])):
        for _, _, s, places, _ in sorted((o for o in options if o[1] == u), key=lambda o: (-o[3], -o[4], o[2])):
            if left[s] > 0:
                want[u] = (s, min(places, left[s]))
                left[s] -= want[u][1]
                break
    got = planting.fill_given(
        spark.createDataFrame(units, "site_id long, unit string, size long"), spark.createDataFrame(options, "site_id long, unit string, species_no long, places long, score long"),
        spark.createDataFrame(list(caps.items()), "species_no long, cap long"))
    assert {r.unit: (r.species_no, r.n) for r in got.collect()} == want


def test_stream_decides_like_the_batch(spark, tmp_path):
    from streetgrove.streaming import journal

    rng = random.Random(4)
    rows = [(0, s, rng.randint(0, 5), rng.choice(["move", "add", "delete"])) for s in range(60)]
    source = tmp_path / "edits"
    schema = "run_id long, seq long, target long, kind string"
    for part in range(3):
        spark.createDataFrame(rows[part * 20:(part + 1) * 20] + rows[part * 20:part * 20 + 2], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source)).withColumn("starts", F.col("target") % 2 == 0)
    query = journal.decisions(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.seq, r.accepted) for r in spark.table("decided").collect()}
    batch = E.replay(E.once(spark.createDataFrame(rows, schema)), F.col("target") % 2 == 0)
    assert got == {(r.seq, r.accepted) for r in batch.collect()}


def test_late_edits_are_refused_not_lost(spark, tmp_path):
    from streetgrove.streaming import journal

    source, schema = tmp_path / "late", "run_id long, seq long, target long, kind string"
    for part in ([(0, 5, 1, "move")], [(0, 3, 1, "delete"), (0, 6, 1, "move")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)).withColumn("starts", F.lit(True))
    query = journal.decisions(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.seq, r.accepted, r.late) for r in spark.table("late").collect()} == {(5, True, False), (3, False, True), (6, True, False)}


def test_sun_is_highest_at_noon_in_the_south():
    elevation, azimuth = sun.position(172, 12.5)
    assert 56 < elevation < 59 and 170 < azimuth < 190
