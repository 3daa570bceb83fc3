"""Assignment of species to structures, shrub tiers and moves of weak plantings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.functions import geom
from streetgrove.operators import scan, spatial
from streetgrove.operators import species as P
from streetgrove.session import Growing, cut

# Fixed values.
PATCH_SIZE = 10
UNDERSTORY_RADII_M = (2.2, 2.6, 3.0)
UNDERSTORY_SIZE = 3
UNDERSTORY_GAP_M = 1.002
DIRECTIONS = 12
MOVE_STEPS_M = (0.3, 0.6, 1.0)
MOVE_MIN_GAIN_M = 0.1
MARGIN_M = 0.5
ROW_OFFSETS_M = (1.3, 1.0)
ROW_MIN_M = 3.0
ROW_GAP_M = 2.5
ROW_TRIM_M = 5.0
SHRUBS_PER_KM_MAX = 720.0


def patches(members: DataFrame, cluster: Sequence[str], size: int = PATCH_SIZE, *, id_col: str = "point_id") -> DataFrame:
    """Clusters larger than ``size`` halved along their principal axis until every part fits.

    All clusters are halved together; the place of a member in its part is a distributed prefix
    sum, so even a street-long cluster is never ordered in one task.
    """
    keys = [*cluster, "patch"]
    rows = cut(members.withColumn("patch", F.lit("0")), "patches")
    while True:
        frame = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.covar_pop("x", "x").alias("_xx"), F.covar_pop("y", "y").alias("_yy"), F.covar_pop("x", "y").alias("_xy"))
        large = cut(frame.where(F.col("_n") > size), "large")
        if large.isEmpty():
            return rows
        angle = 0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))
        along = F.round((F.col("x") - F.col("_mx")) * F.cos(angle) + (F.col("y") - F.col("_my")) * F.sin(angle), 6)
        split = scan.prefix_sum(rows.join(large, keys).withColumn("_t", along), F.lit(1), by=keys, order=("_t", id_col), name="_rank")
        halves = split.withColumn("patch", F.concat("patch", F.when(F.col("_rank") <= F.floor(F.col("_n") / 2), "0").otherwise("1"))).select(rows.columns)
        rows = cut(rows.join(large.select(*keys), keys, "left_anti").unionByName(halves), "patches")


def fill_by_room(units: DataFrame, options: DataFrame, species: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One species per structure within the quotas: rounds of the tightest-first greedy.

    ``units(site_id, unit, size)``, ``options(site_id, unit, species_no, score)``. In a round every
    open structure asks for the species with most room (then score); requests for a quota key are
    accumulated in the order of tightness by a distributed prefix sum and accepted while they fit
    all keys of the species. The rounds end when one accepts nothing, so a structure stays empty for want of room only.
    No claim of an optimum.
    """
    dim = P.quota_keys(species.select(F.lit(0).alias("site_id"), "species_no", "genus", "family", "conifer"), carry=("species_no",)).drop("site_id", "share")
    share = F.create_map(*[v for k, s in shares.items() for v in (F.lit(k), F.lit(s))])
    planned = units.groupBy("site_id").agg(F.sum("size").alias("planned"))
    # Keys per street: at most the catalogue's species, genera and families.
    limits = cut(planned.crossJoin(F.broadcast(dim.select("level", "key").distinct())).withColumn("limit", P.allowance(share[F.col("level")], F.col("planned"))), "limits")
    used = limits.select("site_id", "level", "key", F.lit(0).cast("long").alias("used"))
    tight = options.groupBy("site_id", "unit").agg(F.countDistinct("species_no").alias("choices"))
    open_units = cut(units.join(tight, ["site_id", "unit"]).withColumn("_big", -F.col("size")), "open")
    choices = cut(options, "choices")
    taken = Growing("assigned")
    while True:
        left = limits.join(used, ["site_id", "level", "key"]).withColumn("left", F.col("limit") - F.col("used")).select("site_id", "level", "key", "left")
        room = left.join(F.broadcast(dim), ["level", "key"]).groupBy("site_id", "species_no").agg(F.min("left").alias("room"))
        asked = choices.join(open_units, ["site_id", "unit"]).join(room, ["site_id", "species_no"]).where(F.col("room") >= F.col("size"))
        wish = asked.groupBy("site_id", "unit", "size", "choices", "_big").agg(F.max(F.struct("room", "score", "species_no")).alias("w")).select("site_id", "unit", "size", "choices", "_big", "w.species_no", "w.score")
        per_key = wish.join(F.broadcast(dim), "species_no").join(left, ["site_id", "level", "key"])
        summed = scan.prefix_sum(per_key, F.col("size"), by=("site_id", "level", "key"), order=("choices", "_big", "unit"))
        fit = summed.groupBy("site_id", "unit", "species_no", "size", "score").agg(F.min((F.col("running") <= F.col("left")).cast("int")).alias("ok")).where("ok = 1").drop("ok")
        got = taken.add(fit)
        if got.isEmpty():
            return taken.all()
        open_units = cut(open_units.join(got.select("site_id", "unit"), ["site_id", "unit"], "left_anti"), "open")
        spent = got.join(F.broadcast(dim), "species_no").groupBy("site_id", "level", "key").agg(F.sum("size").alias("more"))
        used = cut(used.join(spent, ["site_id", "level", "key"], "left").select("site_id", "level", "key", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used")), "used")


def fill_given(units: DataFrame, options: DataFrame, caps: DataFrame) -> DataFrame:
    """Given counts are caps: structures, largest first, take the species that covers most of them.

    ``options(site_id, unit, species_no, places, score)``, ``caps(species_no, cap)``. What a
    structure asks for changes only when a species runs out, so each round accepts every structure
    up to the first that exhausts its species. That is the sequential answer, in at most one round
    per species.
    """
    sites = units.select("site_id").distinct()
    left = cut(sites.crossJoin(F.broadcast(caps)).withColumnRenamed("cap", "left"), "left")  # a short given list per street
    todo = cut(units.withColumn("_big", -F.col("size")), "units")
    options = cut(options, "options")
    taken = Growing("given")
    while True:
        alive = options.join(todo, ["site_id", "unit"]).join(left.where("left > 0"), ["site_id", "species_no"])
        wish = alive.groupBy("site_id", "unit", "_big").agg(
            F.min(F.struct((-F.col("places")).alias("p"), (-F.col("score")).alias("s"), "species_no", "left")).alias("w")).select("site_id", "unit", "_big", "w.species_no", (-F.col("w.p")).alias("places"), "w.left")
        asked = cut(scan.prefix_sum(wish, F.col("places"), by=("site_id", "species_no"), order=("_big", "unit")), "asked")
        if asked.isEmpty():
            return taken.all() if taken.rounds else asked.select("site_id", "unit", "species_no", F.col("places").alias("n"))
        stop = asked.where("running >= left").groupBy("site_id").agg(F.min(F.struct("_big", "unit")).alias("stop"))
        ready = asked.join(stop, "site_id", "left").where(F.col("stop").isNull() | (F.struct("_big", "unit") <= F.col("stop")))
        got = taken.add(ready.select("site_id", "unit", "species_no", F.least("places", F.col("left") - (F.col("running") - F.col("places"))).alias("n")).where("n > 0"))
        spent = got.groupBy("site_id", "species_no").agg(F.sum("n").alias("n"))
        left = cut(left.join(spent, ["site_id", "species_no"], "left").select("site_id", "species_no", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")), "left")
        todo = cut(todo.join(got.select("site_id", "unit"), ["site_id", "unit"], "left_anti"), "units")


def ring_offsets(radii: Sequence[float], directions: int = DIRECTIONS) -> list[tuple[float, float, float]]:
    """(radius, dx, dy) ring by ring."""
    return [(r, r * math.cos(2 * math.pi * k / directions), r * math.sin(2 * math.pi * k / directions)) for r in radii for k in range(directions)]


def at_offsets(points: DataFrame, offsets: Sequence[tuple[float, float, float]]) -> DataFrame:
    array = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for r, dx, dy in offsets])
    rows = points.select("*", F.posexplode(array).alias("k", "o"))
    return rows.withColumn("r", F.col("o.r")).withColumn("x", F.round(F.col("x") + F.col("o.dx"), 3)).withColumn("y", F.round(F.col("y") + F.col("o.dy"), 3)).drop("o")


def clear_of(points: DataFrame, others: DataFrame, gap: float, key: Sequence[str]) -> DataFrame:
    """Points not nearer than ``gap`` to any of ``others``; the points are written once because the
    search reads them three times."""
    points = cut(points, "points")
    near = spatial.near_points(points.select("site_id", *key, "x", "y"), others.select("site_id", F.col("x").alias("bx"), F.col("y").alias("by")), gap, spread=key).where(F.col("distance") < gap)
    return points.join(near.select("site_id", *key).distinct(), ["site_id", *key], "left_anti")


def open_runs(stations: DataFrame, by: Sequence[str], step: float) -> DataFrame:
    """Runs of consecutive open stations (k) with their length after trimming at wide gaps.

    Beside a gap of 2.5 m and more a run gives up 5 m; runs shorter than 3 m are dropped.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("k")
    marked = stations.withColumn("_new", F.when(F.col("k") - F.lag("k").over(w) == 1, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*by, "run").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    r = Window.partitionBy(*by).orderBy("run")
    before = (F.col("k0") - F.lag("k1").over(r)) * step
    after = (F.lead("k0").over(r) - F.col("k1")) * step
    trim = F.when(F.coalesce(before >= ROW_GAP_M, F.lit(False)), ROW_TRIM_M).otherwise(0.0) + F.when(F.coalesce(after >= ROW_GAP_M, F.lit(False)), ROW_TRIM_M).otherwise(0.0)
    return runs.withColumn("length_m", (F.col("k1") - F.col("k0")) * step - trim).where(F.col("length_m") >= ROW_MIN_M)


def take_longest(segments: DataFrame, budget: DataFrame, *, key: str, max_rounds: int = 200) -> DataFrame:
    """Segments of each street, longest first, skipping any that no longer fits the budget.

    A round takes the prefix that fits and then drops all segments longer than what is left,
    which are exactly those the sequential walk would skip.
    """
    todo = cut(segments.join(budget, "site_id").where(F.col("length_m") <= F.col("budget_m")).withColumn("_back", -F.col("length_m")), "hedge")
    taken = None
    for _ in range(max_rounds):
        summed = cut(scan.prefix_sum(todo, F.col("length_m"), by=("site_id",), order=("_back", key)), "hedge")
        got = cut(summed.where(F.col("running") <= F.col("budget_m")).select("site_id", key, "length_m"), "hedge")
        taken = got if taken is None else taken.unionByName(got)
        spent = got.groupBy("site_id").agg(F.sum("length_m").alias("spent"))
        rest = summed.join(got.select("site_id", key), ["site_id", key], "left_anti").join(spent, "site_id", "left").withColumn("budget_m", F.col("budget_m") - F.coalesce("spent", F.lit(0.0)))
        todo = cut(rest.where(F.col("length_m") <= F.col("budget_m")).select("site_id", key, "length_m", "budget_m", "_back"), "hedge")
        if todo.isEmpty():
            return taken
    raise RuntimeError("hedges did not settle; raise max_rounds")


def capped_gain(before: Column, after: Column) -> Column:
    return F.least(after, F.lit(MARGIN_M)) - before


def moved_distance(ax: str, ay: str) -> Column:
    return geom.point_distance("x", "y", ax, ay)
