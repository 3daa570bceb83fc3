"""Species of places by class of place, against the whole product with the catalogue."""

import random

from pyspark.sql import functions as F

from streetgrove.operators import scan
from streetgrove.operators import species as P

SPECIES = """species_no long, species_code string, planting_type string, territory string, norm_block string, height_m double, hardiness_zone int, light string, salt int, gas int, compaction int,
    allergen int, use_row boolean, use_group boolean, use_single boolean, evergreen boolean, lifespan_years int, care_level int, pilot_streets int, category_mark string, life_type string, crown_mature_m double"""


def places(spark, few):
    """Places, some of them twice, clearances, a catalogue of which little is admitted, and norms by distance."""
    rng = random.Random(5)
    either = lambda *values: rng.choice(values)
    points = [(k % 2, either(k, k, 3), either("tree", "shrub", None), either("street", "yard"), either(True, False, None), either(0.2, 0.5, 0.9, None), rng.randrange(8), either("row", "group", None)) for k in range(500)]
    by_class = [(s, p, c, float(either(0, 1, 4, 9))) for s in (0, 1) for p in range(500) for c in ("road", "curb", "building") if rng.random() < 0.5]
    catalogue = [
        (n, f"s{n}", either("tree", "shrub"), land, either("invasive", None, None), either(3.0, 9.0), either(4, 4, 6) if few else 4, either("sun", "shade"), either(0, 1), 1, 1, either(0, 2), True, False, either(True, False),
         either(True, False), 80, either(1, 2, 3), either(0, 7), either("plus", "limited", None), "tree", 6.0)
        for n in range(8) for land in ("street", "yard")]
    rules = [(n, c, f"{c}-{either(1, 2)}", float(either(2, 5)), "forbid") for n in range(8) for c in ("road", "building") if rng.random() < (0.9 if few else 0.3)]
    return (
        spark.createDataFrame(points, "site_id long, point_id long, planting_type string, territory string, under_line boolean, shade double, own_no long, structure_kind string"),
        spark.createDataFrame(by_class, "site_id long, point_id long, object_class string, measured_m double"), spark.createDataFrame(catalogue, SPECIES),
        spark.createDataFrame(rules, "species_no long, object_class string, rule_id string, min_distance_m double, severity string"))


def test_best_species_of_a_place_equal_the_whole_product(spark):
    given = places(spark, few=False)
    order = (F.desc("score"), F.col("species_no"))
    whole = P.hard_filter(*given).where("reason is null and species_no <> own_no").withColumn("score", F.round(P.suitability(), 4))
    wanted = scan.top_k(whole, 3, by=("site_id", "point_id"), order=order).select("site_id", "point_id", "rank", "species_no", "score")
    own = P.best_admitted(*given, 3, F.round(P.suitability(), 4), carry=("structure_kind",))
    got = scan.top_k(own, 3, by=("site_id", "point_id"), order=order).select("site_id", "point_id", "rank", "species_no", "score")
    assert wanted.count() > 60 and sorted(got.collect()) == sorted(wanted.collect())
    assert own.count() <= 3 * given[0].count()


def test_reasons_of_places_equal_the_whole_product(spark):
    given = places(spark, few=True)
    whole = P.hard_filter(*given).groupBy("site_id", "point_id").agg(F.max(F.col("reason").isNull()).alias("ok"), F.min("reason").alias("why"))
    wanted = whole.select("site_id", "point_id", "ok", F.when(~F.col("ok"), F.col("why")).alias("why")).collect()
    got = P.planted_or_why(*given).select("site_id", "point_id", "ok", F.when(~F.col("ok"), F.col("why")).alias("why")).collect()
    key = lambda r: (r.site_id, r.point_id)
    assert {r.ok for r in wanted} == {True, False} and sorted(got, key=key) == sorted(wanted, key=key)
