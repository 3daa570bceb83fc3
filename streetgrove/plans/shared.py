"""Stages that several queries share, on the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetgrove.functions import rulebook
from streetgrove.operators import rules as R
from streetgrove.operators import spatial
from streetgrove.operators import species as P
from streetgrove.plans.registry import Tables


def area_rings(t: Tables) -> DataFrame:
    return t.segments.where("is_area = 1")


def inside_areas(t: Tables) -> DataFrame:
    """The lowest area of each class that a planting stands in."""
    return spatial.lowest_areas(t.points, area_rings(t))


def clearance(t: Tables, **options) -> DataFrame:
    return R.nearest_clearance(t.points, t.segments, inside=inside_areas(t), **options)


def norm_reach(extra: float = 0.0, *, general: bool = True, floor: dict[str, float] | None = None) -> dict[str, float]:
    """How far each class has to be searched: its largest norm plus an allowance."""
    out: dict[str, float] = dict(floor or {})
    for row in rulebook.distance_rule_rows():
        if general and (row[8] or row[9] is not None or row[10]):
            continue
        out[row[1]] = max(out.get(row[1], 0.0), row[3] + extra)
    return out


GENERAL_REACH = norm_reach()


def species_reach(t: Tables) -> dict[str, float]:
    """Norms widened by half of what the widest crown of the catalogue exceeds 5 m; salt is felt to 5 m."""
    widest = t.species.agg(F.max("crown_mature_m").alias("m")).first()["m"] or 0.0
    reach = norm_reach(max(0.0, widest - 5.0) / 2 + 0.01, general=False)
    return reach | {c: max(reach[c], P.SALT_ZONE_M + 0.01) for c in ("road", "curb") if c in reach}


def presence(t: Tables) -> DataFrame:
    return R.utility_presence(t.features, t.sites)


def strict_rules(t: Tables) -> DataFrame:
    rules = rulebook.distance_rules(t.spark)
    return R.general(R.enabled(R.in_edition(rules, "2016"), rulebook.STRICT_DISABLED))


def facts(t: Tables, **options) -> DataFrame:
    points = t.points.select("site_id", "point_id", "planting_type", "x", "y")
    return R.checks(points, strict_rules(t), clearance(t, **options), presence(t))


def audit_facts(t: Tables) -> DataFrame:
    """Norm control with root barriers considered at the stricter distance."""
    points = t.points.select("site_id", "point_id", "planting_type", "x", "y")
    return R.checks(points, R.act_rules(rulebook.distance_rules(t.spark)), clearance(t, reach=GENERAL_REACH), presence(t), barrier_m=R.FAR_BARRIER_M)


def species(t: Tables) -> DataFrame:
    """The catalogue with its trait set; at most 58 rows by construction, so it may be broadcast."""
    return t.species.withColumn(
        "traits", F.when(F.col("thorny"), F.array(F.lit("thorny"))).otherwise(F.array().cast("array<string>"))
    ).withColumn("planting_type", F.col("life_type"))


def species_rules(t: Tables) -> DataFrame:
    """(species_no, rule) with the threshold widened by the crown."""
    rules = R.enabled(R.in_edition(rulebook.distance_rules(t.spark), "2016"), rulebook.STRICT_DISABLED)
    fit = R.applicable(species(t).select("species_no", "genus", "crown_mature_m", "height_m", "traits", "planting_type"), rules)
    return fit.withColumn("min_distance_m", R.crown_threshold())
