"""Least clearances within reach of a class, against every pair."""

import math
import random

from streetgrove.operators import tiles


def test_least_clearances_within_reach(spark):
    rng = random.Random(8)
    points = [(0, k % 200, round(rng.uniform(0, 60), 3), round(rng.uniform(0, 60), 3), f"v{k}") for k in range(260)] + [(0, 900, None, 1.0, "v"), (None, 901, 1.0, 1.0, "v")]
    lines = []
    for k in range(150):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        lines.append((0, k, rng.choice(["road", "curb", "fence"]), x, y, x + rng.uniform(-9, 9), y, rng.choice([0.0, 0.4, None]), rng.choice([0.0, 1.0, None])))
    frame = spark.createDataFrame(lines, "site_id long, feature_id long, object_class string, x1 double, y1 double, x2 double, y2 double, error_m double, diameter_m double")
    reach = {"road": 3.0, "curb": 1.0, "pole": 2.0}
    got = tiles.within(spark.createDataFrame(points, "site_id long, point_id long, x double, y double, note string"), frame, reach, carry=("note",)).collect()
    wanted = {}
    for _, i, x, y, note in points[:260]:
        for _, _, c, x1, y1, x2, _, err, wide in lines:
            if c in reach and err is not None:
                d, half = math.hypot(max(min(x1, x2) - x, 0, x - max(x1, x2)), y - y1), (wide or 0.0) / 2
                if d <= reach[c] + err + half:
                    old = wanted.get((i, note, c), (9e9, 9e9))
                    wanted[i, note, c] = (min(old[0], max(0, d - err)), min(old[1], max(0, d - err - half)))
    assert {(r.point_id, r.note, r.object_class): (round(r.axis_m, 6), round(r.wall_m, 6)) for r in got} == {k: (round(a, 6), round(b, 6)) for k, (a, b) in wanted.items()}
    assert len(got) == len(wanted) > 100
