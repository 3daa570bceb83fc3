"""Conflicting candidates, each pair once."""

from streetgrove.operators import selection


def test_pairs_are_listed_once_without_a_shuffle_of_pairs(spark):
    rows = [(0, 1, 0.0, 0.0, "a"), (0, 2, 1.0, 0.0, "a"), (0, 3, 90.0, 0.0, "a"), (0, 4, 91.0, 0.0, "b"), (0, 5, None, 0.0, "b")]
    schema = "site_id long, point_id long, x double, y double, stop string"
    pairs = selection.conflicts(spark.createDataFrame(rows, schema), 5.0)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    wanted = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5)]
    assert sorted((r.a, r.b) for r in pairs.collect()) == wanted
    assert sorted((r.a, r.b) for r in selection.conflicts(spark.createDataFrame(rows + rows[:2], schema), 5.0).collect()) == wanted
