"""Rules are laid beside points after their clearances are gathered."""

from streetgrove.functions import rulebook
from streetgrove.operators import rules as R


def test_facts_are_not_dealt_out(spark):
    """Points, clearances and sites are; what rules make of them is not."""
    points = spark.createDataFrame([(0, 1, "tree", 1.0, 1.0), (0, 1, "tree", 2.0, 2.0), (0, 2, "shrub", 1.0, 1.0), (None, 3, "tree", 0.0, 0.0)], "site_id long, point_id long, planting_type string, x double, y double")
    known = spark.createDataFrame([(0, 1, "curb", 0.5, 7, 0.4, 8), (0, 1, "curb", 9.0, 9, 9.0, 9), (0, 2, "building", 0.1, 5, 0.1, 5)],
                                  "site_id long, point_id long, object_class string, axis_m double, axis_id long, wall_m double, wall_id long")
    presence = spark.createDataFrame([(0, True)], "site_id long, has_utility_data boolean")
    rules = R.general(R.in_edition(rulebook.distance_rules(spark), "2016"))
    facts = R.checks(points, rules, known, presence)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("_known")]
    assert "Join LeftOuter" not in above.split("Generate")[0]
    curb = [(r.point_id, r.measured_m) for r in facts.where("object_class = 'curb' and site_id = 0 and point_id = 1").collect()]
    n = rules.where("object_class = 'curb' and planting_type = 'tree'").count()
    assert n and sorted(curb) == sorted([(1, 0.5), (1, 9.0)] * 2 * n)
