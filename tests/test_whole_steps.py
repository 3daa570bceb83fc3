"""Steps of a named method that were left out: checks without data, crowding of edited plantings, all terms of the reserve."""

from types import SimpleNamespace

from streetgrove.plans.queries import explain, journal, quality

SEGMENT = "site_id long, feature_id long, ring_id int, seg_no int, object_class string, diameter_m double, error_m double, is_area int, x1 double, y1 double, x2 double, y2 double"


def test_the_first_norm_without_data_follows_the_closest_checks(spark):
    """a street without networks; the kerb is measured, distances to networks are not known."""
    points = spark.createDataFrame([(0, 1, "tree", 0.0, 9.0), (0, 2, "tree", None, 9.0)], "site_id long, point_id long, planting_type string, x double, y double")
    curb = spark.createDataFrame([(0, 9, 0, 0, "curb", 0.0, 0.0, 0, -50.0, 0.0, 50.0, 0.0)], SEGMENT)
    tables = SimpleNamespace(spark=spark, points=points, segments=curb, features=curb, sites=spark.createDataFrame([(0,)], "site_id long"))
    got = {}
    for r in explain.closest_checks(tables).collect():
        got.setdefault(r.point_id, []).append((r.place, r.rule_id, r.margin_m))
    facts = explain.shared.facts(tables).collect()
    for point in (1, 2):
        own = [f for f in facts if f.point_id == point]
        near = sorted((round(f.measured_m - f.threshold_m, 3), f.rule_id) for f in own if f.measured_m is not None)[:4]
        blind = min(f.rule_id for f in own if f.outcome == "no_data")
        want = [(i, rule, margin) for i, (margin, rule) in enumerate(near, 1)] + [(len(near) + 1, blind, None)]
        assert sorted(got[point], key=lambda v: v[0]) == want
    assert any(m is not None for _, _, m in got[1]) and got[2] == [(1, got[2][0][1], None)]


def test_an_edited_planting_that_crowds_its_neighbours_goes(spark):
    """beside the street's plantings the edited one goes, of two edited ones of a run the later, and those that follow in a row stay."""
    kind = "site_id long, run_id int, point_id long, seq long, x double, y double"
    edited = [(0, 0, 1, 10, 0.0, 0.0), (0, 0, 2, 11, 4.9, 0.0), (0, 0, 3, 12, 9.8, 0.0), (0, 5, 4, 13, 1.0, 0.0), (0, 0, 5, 14, 50.0, 0.0), (0, 0, 6, 15, 80.0, 0.0), (0, 0, 7, 16, 95.0, 0.0), (0, 0, 8, 17, 100.0, 0.0)]
    standing = spark.createDataFrame([(0, "tree", 54.9, 0.0), (0, "shrub", 81.7, 0.0), (1, "tree", 0.0, 0.0), (0, "shrub", 96.75, 0.0)], "site_id long, planting_type string, x double, y double")
    got = {r.point_id for r in journal.uncrowded(spark.createDataFrame(edited, kind), standing).collect()}
    assert got == {1, 3, 4, 7, 8}


def test_the_reserve_counts_all_ten_terms_and_harmful_plantings(spark, monkeypatch):
    """the margin to networks is a term like the others."""
    def scored(value):
        return lambda t: spark.createDataFrame([(0, value)], "site_id long, score double")

    for name in ("density", "fit", "category", "diversity", "season", "rows_frame", "tiers", "canopy", "dust"):
        monkeypatch.setattr(quality, name, scored(0.9))
    monkeypatch.setattr(quality, "tiers", scored(0.5))
    monkeypatch.setattr(quality, "margin", scored(0.2))
    monkeypatch.setattr(quality, "goals", lambda t: spark.createDataFrame([(0,)], "site_id long"))
    changes = spark.createDataFrame([(0, 1, -0.01), (0, 2, 0.02), (0, 3, -0.5)], "site_id long, point_id long, delta double")
    monkeypatch.setattr(quality, "removal_changes", lambda t: changes, raising=False)
    got = sorted((r.term, r.gain, r.harmful) for r in quality.index_reserve(SimpleNamespace(spark=spark)).collect())
    assert got == [("margin", 0.08, 2), ("tiers", 0.05, 2)]
