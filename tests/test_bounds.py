"""Searches and rounds that used to stop early go on until every row has its answer."""

import json
import math
import random

from pyspark.sql import functions as F

from streetgrove.operators import drawing as D
from streetgrove.operators import planting as L
from streetgrove.operators import quality as Q
from streetgrove.operators import rules as R
from streetgrove.operators import selection as C
from streetgrove.operators import spatial
from streetgrove.operators import surface as U
from streetgrove.sources import geojson


def test_nearest_goes_beyond_the_last_ring(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 9000.0, 0.0), (2, 3, 0.0, 0.0)], "site_id long, point_id long, x double, y double")
    roads = spark.createDataFrame([(1, 7, 20000.0, 0.0, 20000.0, 10.0)], "site_id long, feature_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.point_id: r.distance for r in spatial.nearest_segment(points, roads, (30.0, 120.0)).collect()}
    assert got == {1: 20000.0, 2: 11000.0}
    segments = roads.withColumns({"object_class": F.lit("curb"), "error_m": F.lit(0.0), "diameter_m": F.lit(0.0)})
    got = {r.point_id: r.axis_m for r in R.nearest_clearance(points, segments).collect()}
    assert got == {1: 20000.0, 2: 11000.0}


def test_wide_crowns_are_searched_by_their_own_radius(spark):
    curb = spark.createDataFrame([(1, 5, 0.0, 0.0, 100.0, 0.0)], "site_id long, feature_id long, x1 double, y1 double, x2 double, y2 double")
    crown = spark.createDataFrame([(1, 9, 50.0, 24.0, 30.0)], "site_id long, point_id long, x double, y double, radius double")
    (row,) = Q.cover_intervals(curb, crown).collect()
    assert (round(row.a, 6), round(row.b, 6)) == (32.0, 68.0)
    from streetgrove.plans.queries.quality import covered_crowns

    shrubs = spark.createDataFrame([(1, 50.0, 53.9), (1, 50.0, 54.1)], "site_id long, x double, y double")
    assert covered_crowns(crown, shrubs.limit(1), "point_id").count() == 1
    assert covered_crowns(crown, shrubs.where("y > 54"), "point_id").count() == 0


def test_soil_depth_without_a_limit(spark):
    rng = random.Random(3)
    n = 40
    soil = {(r, c): rng.random() > 0.004 for r in range(n) for c in range(n)}
    cells = spark.createDataFrame([(1, r, c, s) for (r, c), s in soil.items()], "site_id long, row int, col int, soil boolean")
    got = {(r.row, r.col): round(r.distance_m, 6) for r in U.distance_to_other(cells, 5.0).collect()}
    others = [k for k, s in soil.items() if not s]
    want = {}
    for (r, c), s in soil.items():
        if s:
            edge = min(r + 1, n - r, c + 1, n - c)
            want[r, c] = round(5.0 * math.sqrt(min([edge * edge, *((r - a) ** 2 + (c - b) ** 2 for a, b in others)])), 6)
    assert got == want and max(got.values()) > 20


def test_row_of_trees_longer_than_the_first_walk(spark):
    stems = spark.createDataFrame([(1, k, 5.0 * k, 100.0) for k in range(200) if k != 150], "site_id long, stem_id long, x double, y double")
    got = {(r.x, r.y) for r in C.rows_of_stems(stems, steps=4).collect()}
    want = {(750.0, 100.0)} | {(5.0 * k, 100.0) for k in [*range(-6, 0), *range(200, 206)]}
    assert want <= got
    assert got == {(r.x, r.y) for r in C.rows_of_stems(stems, steps=1000).collect()}


def test_rounds_of_filling_end_for_want_of_room_only(spark):
    """One unit a round fits the only key with room, so the rounds outnumber any fixed count."""
    units = spark.createDataFrame([(1, f"u{k:03d}", 1) for k in range(90)], "site_id long, unit string, size long")
    species = spark.createDataFrame([(k, f"g{k}", f"f{k}", False) for k in range(90)], "species_no long, genus string, family string, conifer boolean")
    options = units.select("site_id", "unit").crossJoin(species.select("species_no")).withColumn("score", F.lit(1.0) - F.col("species_no") / 1000)
    shares = {"species": 0.01, "genus": 0.01, "family": 0.01, "conifer": 1.0}
    got = L.fill_by_room(units, options, species, shares).collect()
    assert len(got) == 90 and len({r.species_no for r in got}) == 90
    none = L.fill_by_room(units, options.limit(0), species, shares)
    assert none.count() == 0 and set(none.columns) == {"site_id", "unit", "species_no", "size", "score"}
    caps = spark.createDataFrame([(0, 3)], "species_no long, cap long")
    empty = options.limit(0).withColumn("places", F.lit(1).cast("long"))
    assert L.fill_given(units, empty, caps).count() == 0


def test_all_geometries_become_segments(spark):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = {
        "Polygon": [square], "MultiPolygon": [[square], [square]], "LineString": square, "MultiLineString": [square, square[:2]], "Point": [3, 4], "MultiPoint": [[3, 4], [5, 6]],
    }
    rows = [(json.dumps({"type": "Feature", "geometry": {"type": k, "coordinates": v}, "properties": {"k": k}}),) for k, v in shapes.items()]
    got = geojson.rings(geojson.records(spark.createDataFrame(rows, "text string")))
    counts = {r.geometry_type: r["count"] for r in got.groupBy("geometry_type").count().collect()}
    assert counts == {"Polygon": 3, "MultiPolygon": 6, "LineString": 3, "MultiLineString": 4, "Point": 1, "MultiPoint": 2}
    point = got.where("geometry_type = 'Point'").first()
    assert (point.x1, point.y1, point.x2, point.y2) == (3.0, 4.0, 3.0, 4.0)


def test_arrow_in_a_busy_node(spark):
    lines = [(1, 0, 0.0, 0.0, 6.0, 0.0), (1, 1, 0.0, 0.0, 0.5, 0.3), (1, 2, 0.0, 0.0, 0.5, -0.3)]
    lines += [(1, 10 + k, 0.0, 0.0, 9 * math.cos(a), 9 * math.sin(a)) for k, a in enumerate(math.pi * (0.6 + 0.1 * j) for j in range(7))]
    frame = spark.createDataFrame(lines, "site_id long, feature_id long, x1 double, y1 double, x2 double, y2 double")
    labels = spark.createDataFrame([(1, 7.0, 1.0)], "site_id long, x double, y double")
    got = {r.shaft: r.through for r in D.arrows(frame, labels).collect()}
    assert set(got) == {0} and got[0] > 0
