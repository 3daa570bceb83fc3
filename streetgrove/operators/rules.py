"""Distance-rule engine: clearances, checks, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetgrove.functions import geom, rulebook
from streetgrove.operators import spatial, tiles
from streetgrove.session import cut

NEAR_BARRIER_M = 0.5  # fixed values: shortest distances with a root barrier and the crown heights
FAR_BARRIER_M = 1.0
LOW_CROWN_M = 5.0
HIGH_CROWN_M = 20.0


def is_utility(object_class: str = "object_class") -> Column:
    c = F.col(object_class)
    return c.startswith("utility.") & (c != "utility.access")


def is_relaxable(object_class: str = "object_class") -> Column:
    return is_utility(object_class) | F.col(object_class).isin("curb", "road")


def in_edition(rules: DataFrame, edition: str) -> DataFrame:
    return rules.where(F.col("edition").isNull() | (F.col("edition") == edition))


def enabled(rules: DataFrame, disabled: Sequence[str]) -> DataFrame:
    return rules.where(~F.col("rule_id").isin(*disabled)) if disabled else rules


def general(rules: DataFrame) -> DataFrame:
    """Rules that apply before a species is chosen."""
    return rules.where((F.size("genera") == 0) & (F.size("traits") == 0) & F.col("min_crown_m").isNull())


def applicable(species: DataFrame, rules: DataFrame) -> DataFrame:
    """(species, rule) rows: genus, crown and traits of the species satisfy the rule."""
    s, r = species.alias("s"), F.broadcast(rules).alias("r")
    fits = (
        (F.col("s.planting_type") == F.col("r.planting_type"))
        & (F.col("r.min_crown_m").isNull() | (F.col("s.crown_mature_m") > F.col("r.min_crown_m")))
        & ((F.size("r.genera") == 0) | F.array_contains("r.genera", F.lower("s.genus")))
        & (F.size(F.array_except("r.traits", "s.traits")) == 0)
    )
    return s.join(r, fits).select("s.*", *[F.col(f"r.{c}") for c in rules.columns if c != "planting_type"])


def crown_threshold(extra_per_m: float = 0.5, classes: Sequence[str] = ()) -> Column:
    """Norm widened by half of what the mature crown exceeds 5 m, for the table that asks for it."""
    widened = F.col("min_distance_m") + F.greatest(F.lit(0.0), F.col("crown_mature_m") - 5.0) * F.lit(extra_per_m)
    widen = (F.col("severity") == "forbid") & F.col("table91")
    if classes:
        widen = widen & F.col("object_class").isin(*classes)
    return F.when(widen, widened).otherwise(F.col("min_distance_m"))


def utility_presence(features: DataFrame, sites: DataFrame) -> DataFrame:
    known = features.groupBy("site_id").agg(
        F.max(F.when(is_utility() & (F.col("object_class") != "utility.unknown"), 1).otherwise(0)).alias("n")
    )
    return sites.select("site_id").join(known, "site_id", "left").select(
        "site_id", (F.coalesce("n", F.lit(0)) == 1).alias("has_utility_data")
    )


def nearest_clearance(
    points: DataFrame, segments: DataFrame, *, rings: Sequence[float] = (30.0, 120.0), inside: DataFrame | None = None,
    reach: Mapping[str, float] | None = None,
) -> DataFrame:
    """Smallest clearance of every point to every class of its site, by axis and by outer wall.

    Clearance is distance - geometry error (- half diameter for the outer wall), floored at 0;
    a tie goes to the lowest feature id. Objects are searched within the ring plus their own
    reserve, so a clearance found inside a ring is final: the nearest wall need not belong to the
    nearest axis. Points and segments meet once in tiles, where rings as narrow as their class is dense are searched
    (``tiles.nearest``); only pairs of point and class without an answer there go on to wide rings, which
    widen until every point has an answer for every class of its site, or cover the site. A point without finite
    coordinates has a row of nulls for every class searched on its site; a segment without them is none, a null error is 0.
    A wide ring is a bucketed equi-join whose minima are combined before the shuffle. A caller that
    only compares with norms passes ``reach``, the largest norm of each class, instead: then a
    class is searched no further than its own norm, classes without a norm are not searched, and a
    missing row means "proven farther". ``inside`` (site_id, point_id, feature_id, object_class) gives clearance 0
    inside areas.
    """
    key = ["site_id", "point_id", "object_class"]
    segments = segments.select(
        "site_id", "feature_id", "object_class", "x1", "y1", "x2", "y2",
        F.col("error_m").alias("_err"), (F.coalesce("diameter_m", F.lit(0.0)) / 2).alias("_half"),
    )
    axis_v = F.greatest(F.lit(0.0), F.col("distance") - F.col("_err"))
    wall_v = F.greatest(F.lit(0.0), F.col("distance") - F.col("_err") - F.col("_half"))
    axis, wall = F.struct(axis_v.alias("v"), F.col("feature_id")), F.struct(wall_v.alias("v"), F.col("feature_id"))
    segments = segments.where(spatial.finite("x1", "y1", "x2", "y2")).withColumn("_err", F.coalesce("_err", F.lit(0.0)))
    asked = points.select("site_id", "point_id", "x", "y")
    todo = asked.where(spatial.finite("x", "y"))
    if reach is not None:
        segments = segments.where(F.col("object_class").isin(*reach))
    else:
        todo = todo.where(F.col("point_id").isNotNull())
    n, area, held = tiles.densities(todo, segments)
    repeated = not todo.groupBy("site_id", "point_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    found, searched = [], False
    if n and held:
        kinds = sorted(held)
        wide = {c: tiles.radius_of(*held[c], area, tiles.SURE_NEAR) for c in kinds}
        widest = {c: float(reach[c]) if reach is not None else min(wide[c], *rings) if len(rings) == 1 else min(wide[c], max(rings, default=wide[c])) for c in kinds}
        first = {c: tiles.radius_of(*held[c], area, spatial.FEW_NEAR) for c in kinds}
        rows = tiles.nearest(todo, segments, kinds, first, widest, tiles.tile_edge(n, area, held, max(widest.values())), all_rows=reach is None)
        name = F.array(*[F.lit(c) for c in kinds])
        rows = rows.select(
            "site_id", "point_id", "x", "y", name[F.col("kind")].alias("object_class"), F.struct(F.col("axis").alias("v"), F.col("axis_id").alias("feature_id")).alias("axis"),
            F.struct(F.col("wall").alias("v"), F.col("wall_id").alias("feature_id")).alias("wall"))
        if repeated:  # rows of one key share their least clearances
            rows = cut(rows, "tile-rows")
            low = rows.where("axis.v is not null").groupBy(*key).agg(F.min("axis").alias("axis"), F.min("wall").alias("wall"))
            rows = low if reach is not None else rows.drop("axis", "wall").join(low, key, "left")
        if reach is None:
            # One written table: it is read as "settled" and as "still to search".
            state = cut(rows, "ring")
            within = F.create_map(*[v for c, metres in widest.items() for v in (F.lit(c), F.lit(metres))])[F.col("object_class")]
            settled = F.coalesce(F.col("axis.v") <= within - 1e-6, F.lit(False))
            rows, todo, searched = state.where(settled), state.where(~settled).select(*key, "x", "y"), True
        found.append(rows.select(*key, "axis", "wall"))
    if reach is None and not todo.isEmpty():
        for i, radius in enumerate(spatial.widening(rings, lambda: spatial.farthest(todo, segments))):
            on = ("site_id",) if i == 0 and not searched else ("site_id", "object_class")
            pairs = spatial.near_segments(todo, segments, radius, on=on, spread=("point_id",), reserve=F.col("_err") + F.col("_half"))
            best = pairs.groupBy(*key).agg(F.min(axis).alias("axis"), F.min(wall).alias("wall"))
            if i == 0 and not searched:
                todo = todo.join(segments.select("site_id", "object_class").distinct(), "site_id")
            state = cut(todo.join(best, key, "left"), "ring")
            settled = F.coalesce(F.col("axis.v") <= radius, F.lit(False))
            found.append(state.where(settled).select(*key, "axis", "wall"))
            todo = state.where(~settled).select(*key, "x", "y")
            if todo.isEmpty():
                break
    if not found:
        none = segments.withColumns({"x": F.col("x1"), "y": F.col("y1"), "distance": F.lit(0.0)}).join(asked.select("site_id", "point_id"), "site_id").where(F.lit(False))
        found.append(none.select(*key, axis.alias("axis"), wall.alias("wall")))
    found = reduce(DataFrame.unionByName, found)
    classes = segments.select("site_id", "object_class").distinct()
    nowhere = asked.where(~spatial.finite("x", "y")).join(classes, "site_id").select(*key)
    result = found.unionByName(nowhere, allowMissingColumns=True).select(
        "site_id", "point_id", "object_class",
        F.col("axis.v").alias("axis_m"), F.col("axis.feature_id").alias("axis_id"),
        F.col("wall.v").alias("wall_m"), F.col("wall.feature_id").alias("wall_id"),
    )
    if inside is None:
        return result
    within = inside.groupBy("site_id", "point_id", "object_class").agg(F.min("feature_id").alias("in_id"))
    # A point deep inside an area may have no edge within reach, so the join keeps both sides.
    return result.join(within, ["site_id", "point_id", "object_class"], "full").select(
        "site_id", "point_id", "object_class",
        F.when(F.col("in_id").isNotNull(), 0.0).otherwise(F.col("axis_m")).alias("axis_m"),
        F.coalesce("in_id", "axis_id").alias("axis_id"),
        F.when(F.col("in_id").isNotNull(), 0.0).otherwise(F.col("wall_m")).alias("wall_m"),
        F.coalesce("in_id", "wall_id").alias("wall_id"),
    )


def checks(
    points: DataFrame, rules: DataFrame, clearance: DataFrame, presence: DataFrame, *,
    margin_m: float = 0.0, barrier_m: Column | float | None = None, by: Sequence[str] = ("planting_type",),
) -> DataFrame:
    """The fact table: one row per (point, rule) with outcome, threshold and measure.

    A point without finite coordinates has no data for any rule. ``rules`` may be general (joined on the planting type) or per species (``by`` names the key).
    Clearances are gathered by point before the rules are laid beside it, so the facts themselves are never dealt out.
    """
    measured = F.when(F.col("measure_to") == "outer_wall", F.col("wall_m")).otherwise(F.col("axis_m"))
    nearest = F.when(F.col("measure_to") == "outer_wall", F.col("wall_id")).otherwise(F.col("axis_id"))
    own = ["axis_m", "axis_id", "wall_m", "wall_id"]
    known = clearance.where(F.col("object_class").isNotNull()).groupBy("site_id", "point_id").agg(F.collect_list(F.struct("object_class", *own)).alias("_known"))  # a few of each class
    of_class = F.filter("_known", lambda c: c["object_class"] == F.col("object_class"))
    rows = (
        points.join(presence, "site_id", "left")
        .join(known, ["site_id", "point_id"], "left")
        .join(F.broadcast(rules), list(by))
        .withColumn("_own", F.explode_outer(of_class)).drop("_known")
        .select("*", *[F.col(f"_own.{c}").alias(c) for c in own]).drop("_own")
    )
    passes = measured >= F.col("min_distance_m") + F.lit(margin_m) - geom.EPS_M
    outcome = (
        F.when(~spatial.finite("x", "y"), "no_data")
        .when(measured.isNull() & is_utility() & ~F.coalesce("has_utility_data", F.lit(False)), "no_data")
        .when(measured.isNull(), "pass").when(passes, "pass")
    )
    if barrier_m is not None:
        barrier = barrier_m if isinstance(barrier_m, Column) else F.lit(float(barrier_m))
        relaxed = (
            barrier.isNotNull() & (F.col("planting_type") == "tree") & (F.col("severity") == "forbid") & is_relaxable()
            & (F.col("min_distance_m") > barrier) & (measured >= barrier + F.lit(margin_m) - geom.EPS_M)
        )
        outcome = outcome.when(relaxed, "barrier")
    keep = [c for c in points.columns if c not in ("x", "y")]
    return rows.select(
        *keep, "rule_id", "object_class", "severity", "act_id", outcome.otherwise("fail").alias("outcome"),
        F.col("min_distance_m").alias("threshold_m"), F.round(measured, 3).alias("measured_m"), nearest.alias("nearest_id"),
    )


def verdicts(facts: DataFrame, *, key: Sequence[str] = ("site_id", "point_id"), require_utility_data: bool = False) -> DataFrame:
    failed = F.col("outcome") == "fail"
    missing = "unknown" if require_utility_data else "needs_approval"
    flags = facts.groupBy(*key).agg(
        F.max(F.when(failed & (F.col("severity") == "forbid"), 1).otherwise(0)).alias("_forbid"),
        F.max(F.when(F.col("outcome") == "no_data", 1).otherwise(0)).alias("_nodata"),
        F.max(F.when(failed & (F.col("severity") != "forbid"), 1).otherwise(0)).alias("_approval"),
        F.max(F.when(F.col("outcome") == "barrier", 1).otherwise(0)).alias("_barrier"),
    )
    verdict = (
        F.when(F.col("_forbid") == 1, "forbidden").when(F.col("_nodata") == 1, missing)
        .when(F.col("_approval") == 1, "needs_approval").otherwise("allowed")
    )
    return flags.select(*key, verdict.alias("verdict"), (F.col("_barrier") == 1).alias("needs_barrier"))


def slack_to_network(facts: DataFrame, *, key: Sequence[str] = ("site_id", "point_id")) -> DataFrame:
    """Least measured-minus-norm over networks; null stands for minus infinity (nothing measured)."""
    counted = F.col("measured_m").isNotNull() & (F.col("outcome") != "no_data") & (F.col("threshold_m") > 0) & is_utility()
    return facts.groupBy(*key).agg(F.round(F.min(F.when(counted, F.col("measured_m") - F.col("threshold_m"))), 3).alias("slack_m"))


def barrier_distance(height: Column) -> Column:
    return F.when(height < LOW_CROWN_M, NEAR_BARRIER_M).when(height <= HIGH_CROWN_M, FAR_BARRIER_M)


def barrier_option(facts: DataFrame, *, key: Sequence[str] = ("site_id", "point_id")) -> DataFrame:
    """Forbidden places a root barrier would open: nearest distance and the tree height it allows."""
    failed = facts.where((F.col("outcome") == "fail") & (F.col("severity") == "forbid"))
    relaxable = (
        (F.col("planting_type") == "tree") & is_relaxable() & F.col("measured_m").isNotNull()
        & (F.col("measured_m") >= NEAR_BARRIER_M - geom.EPS_M)
    )
    grouped = failed.groupBy(*key).agg(
        F.min(F.when(relaxable, 1).otherwise(0)).alias("_every"), F.min("measured_m").alias("barrier_m")
    )
    limit = F.when(F.col("barrier_m") < FAR_BARRIER_M - geom.EPS_M, LOW_CROWN_M).otherwise(HIGH_CROWN_M)
    return grouped.where(F.col("_every") == 1).select(*key, "barrier_m", limit.alias("height_limit_m"))


def plantable(
    points: DataFrame, hard_edges: DataFrame, sites: DataFrame, radius: Column | float, *, max_radius: float, margin_m: float = 0.0,
) -> DataFrame:
    """Points whose footprint lies off hard surfaces and inside the square work boundary.

    ``hard_edges`` are the rings of hard areas; a point inside one or nearer than its radius goes.
    """
    reach = radius if isinstance(radius, Column) else F.lit(float(radius))
    reach = reach + F.lit(float(margin_m))
    near = (
        spatial.near_segments(points, hard_edges.select("site_id", "feature_id", "x1", "y1", "x2", "y2"), max_radius + margin_m)
        .where(F.col("distance") <= reach).select("site_id", "point_id").distinct()
    )
    inside = spatial.lowest_areas(points, hard_edges.withColumn("_kind", F.lit(0)), kind="_kind").select("site_id", "point_id").distinct()
    edge = F.least(F.col("x") - F.col("x0"), F.col("x1") - F.col("x"), F.col("y") - F.col("y0"), F.col("y1") - F.col("y"))
    return (
        points.join(sites.select("site_id", "x0", "x1", "y0", "y1"), "site_id").where((edge > 0) & (edge >= reach))
        .select(points.columns).join(near, ["site_id", "point_id"], "left_anti").join(inside, ["site_id", "point_id"], "left_anti")
    )


def act_rules(rules: DataFrame, disabled: Sequence[str] = rulebook.STRICT_DISABLED, edition: str = "2016") -> DataFrame:
    """Rules of a norm control: from an act, not a project parameter, no step to existing plants."""
    return general(enabled(in_edition(rules, edition), disabled)).where(
        (F.col("act_id") != "PROJECT") & ~F.col("object_class").isin("existing_tree", "existing_shrub")
    )
