"""Species admission, suitability and composition of a plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.functions import rulebook
from streetgrove.operators import graph, spatial
from streetgrove.session import cut

# Weights of suitability factors, scales and steps.
SUITABILITY_WEIGHTS = {
    "site": 0.30, "function": 0.20, "decor": 0.15, "longevity": 0.15, "care": 0.10, "pilot": 0.10, "category": 0.20, "shade": 0.15,
}
SALT_ZONE_M = 5.0
OVERHEAD = "power_line_overhead"
REGION_ZONE = 4
MAX_HEIGHT_UNDER_LINES_M = 4.0
SHADE_SUN_MAX = 0.5
CANOPY_CROWN_M = 8.0
EVERGREEN_BONUS = 0.25
REFERENCE_LIFESPAN = 150.0
PILOT_STREETS = 7.0
TREE_STEP_MIN_M = 5.0
STEP_TOLERANCE = 0.95
CROWN_OVERLAP = 0.25
GROUP_STEP_MAX_M = 7.0
CLUSTER_FACTOR = 1.5
STRICT_QUOTAS = {"species": 0.40, "genus": 0.50, "family": 0.70, "conifer": 0.50}
ROW_MODES = ("alley", "shrub_row", "curb_hedge")
GROUP_MODES = ("shrub_group", "understory", "shrub_fill")


def invasive_check(species: DataFrame, listed: DataFrame, territory: str, groups=rulebook.INVASIVE_GROUPS) -> DataFrame:
    """Exact species, or a whole genus where the list names one, with the decision of its group."""
    latin = F.lower(F.col("species_lat"))
    by_name = listed.where(F.instr(F.col("species_lat"), " ") > 0).select(latin.alias("_lat"), F.col("rule_id").alias("_r1"), F.col("grp").alias("_g1"))
    by_genus = listed.where(F.instr(F.col("species_lat"), " ") == 0).select(latin.alias("_gen"), F.col("rule_id").alias("_r2"), F.col("grp").alias("_g2"))
    conditional = [g for g, _, lands in groups if territory in lands]
    joined = (
        species.join(F.broadcast(by_name), F.lower("name_lat") == F.col("_lat"), "left")
        .join(F.broadcast(by_genus), F.lower("genus") == F.col("_gen"), "left")
        .withColumn("invasive_rule", F.coalesce("_r1", "_r2")).withColumn("invasive_group", F.coalesce("_g1", "_g2"))
    )
    decision = F.when(F.col("invasive_group").isNull(), F.lit(None).cast("string")).when(
        F.col("invasive_group").isin(*conditional), "conditional"
    ).otherwise("forbidden")
    return joined.withColumn("invasive_decision", decision).drop("_lat", "_gen", "_r1", "_r2", "_g1", "_g2")


def species_norms(checked: DataFrame, *, allergen_act_priority: bool = True) -> DataFrame:
    """First norm that forbids the species at all, on top of ``invasive_check``."""
    mark = F.col("category_mark")
    allergen = (F.col("allergen") >= 2) & ~(mark.isin("plus", "limited") & F.lit(allergen_act_priority) & mark.isNotNull())
    block = (
        F.when(F.col("invasive_decision") == "forbidden", "invasive").when(mark == "minus", "planting_category")
        .when(F.col("fluff") & ~F.col("male_clone"), "female_fluff").when(F.col("fruit_litter"), "fruit_litter")
        .when(F.coalesce(allergen, F.col("allergen") >= 2), "mass_allergen")
    )
    conditions = F.array_compact(F.array(
        F.when(F.col("invasive_decision") == "conditional", "invasive_condition"),
        F.when(mark == "limited", "limited_category"), F.when(F.col("fluff") & F.col("male_clone"), "male_clones_only"),
    ))
    return checked.withColumn("norm_block", block).withColumn("conditions", conditions)


def under_lines(facts: DataFrame, key: Sequence[str] = ("site_id", "point_id")) -> DataFrame:
    """(key..., under_line): does a planting break the distance to an overhead line?"""
    return facts.where(F.col("object_class") == OVERHEAD).groupBy(*key).agg(F.max(F.col("outcome") == "fail").alias("under_line"))


def salt_distance(by_class: DataFrame, key: Sequence[str]) -> DataFrame:
    return by_class.where(F.col("object_class").isin("road", "curb")).groupBy(*key).agg(F.min("measured_m").alias("salt_m"))


def blocked_pairs(points: DataFrame, by_class: DataFrame, species: DataFrame, species_rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., species_no, distance_rule): the first norm by name that keeps a species off a place; only measured pairs are looked at.

    Clearances are dealt by planting once; the norms are laid beside them, and all that follows is grouped where it lies.
    """
    kinds = species.select("species_no", "planting_type").distinct()
    forbids = species_rules.where(F.col("severity") == "forbid").select("species_no", "object_class", "rule_id", "min_distance_m").join(kinds, "species_no")
    measured = by_class.join(points.select(*key, "planting_type"), list(key)).repartition(*key)
    near = measured.join(F.broadcast(forbids), ["object_class", "planting_type"])  # norms by species of the catalogue
    return near.where(F.col("measured_m") + 1e-6 < F.col("min_distance_m")).groupBy(*key, "species_no").agg(F.min("rule_id").alias("distance_rule"))


def later_reason() -> Column:
    """What keeps a species off a place when its norms and distances do not: line, frost, shade, salt."""
    return F.coalesce(
        F.when(F.col("under_line") & (F.col("height_m") > MAX_HEIGHT_UNDER_LINES_M), "overhead"),
        F.when(F.col("hardiness_zone") > REGION_ZONE, "hardiness"),
        F.when((F.col("light") == "sun") & (F.col("shade") >= SHADE_SUN_MAX), "light"),
        F.when((F.col("salt") == 0) & (F.col("salt_m") < SALT_ZONE_M), "salt"),
    )


def hard_filter(
    points: DataFrame, by_class: DataFrame, species: DataFrame, species_rules: DataFrame, *, key: Sequence[str] = ("site_id", "point_id"),
) -> DataFrame:
    """(planting, species) rows with the first blocking reason, null when admitted.

    ``points(key..., planting_type, territory, under_line, shade, ...)`` carries what lies over a place, ``species`` the norms of
    each territory. ``by_class`` holds the measured clearances (site, point, class). What distances block is gathered into one
    map a planting, at most as long as the catalogue; the catalogue is laid beside the plantings last, and its product with
    them is never dealt out.
    """
    blocked = blocked_pairs(points, by_class, species, species_rules, key).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("species_no", "distance_rule"))).alias("_blocked"))
    placed = points.join(blocked, list(key), "left").join(salt_distance(by_class, key), list(key), "left")
    pairs = placed.join(F.broadcast(species.drop("species_code")), ["planting_type", "territory"])
    full = pairs.withColumn("distance_rule", F.col("_blocked")[F.col("species_no")]).drop("_blocked")
    return full.withColumn("reason", F.coalesce(F.concat(F.lit("norm:"), F.col("norm_block")), F.concat(F.lit("distance:"), F.col("distance_rule")), later_reason()))


def filter_counts(
    points: DataFrame, by_class: DataFrame, species: DataFrame, species_rules: DataFrame, *, key: Sequence[str] = ("site_id", "point_id"),
) -> DataFrame:
    """(species_no, reason, n): ``hard_filter`` counted without its rows; admitted places have a null reason.

    Places alike in all but their distances are counted together and judged once a species. The pairs that a distance
    blocks are few; they are counted by that norm and taken off the reason that they would have had without it.
    """
    placed = points.join(salt_distance(by_class, key), list(key), "left")
    alike = ["planting_type", "territory", "under_line", "shade", "salt_m"]
    classes = cut(placed.select(
        *key, "planting_type", "territory", F.coalesce("under_line", F.lit(False)).alias("under_line"),
        F.when(F.col("shade") >= SHADE_SUN_MAX, SHADE_SUN_MAX).alias("shade"), F.when(F.col("salt_m") < SALT_ZONE_M, 0.0).alias("salt_m")), "alike")
    traits = F.broadcast(species.select("species_no", "planting_type", "territory", "norm_block", "height_m", "hardiness_zone", "light", "salt"))  # the catalogue
    norm = F.concat(F.lit("norm:"), F.col("norm_block"))
    judged = classes.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")).join(traits, ["planting_type", "territory"]).select("species_no", F.coalesce(norm, later_reason()).alias("reason"), "n")
    pairs = blocked_pairs(points, by_class, species, species_rules, key).join(classes, list(key)).join(traits, ["species_no", "planting_type", "territory"]).where("norm_block is null")
    held = pairs.groupBy("species_no", "distance_rule", later_reason().alias("otherwise")).agg(F.count(F.lit(1)).alias("n"))
    moved = held.select("species_no", F.explode(F.array(
        F.struct(F.concat(F.lit("distance:"), F.col("distance_rule")).alias("reason"), F.col("n").alias("n")), F.struct(F.col("otherwise").alias("reason"), (-F.col("n")).alias("n")))).alias("m")).select("species_no", "m.*")
    return judged.unionByName(moved).groupBy("species_no", "reason").agg(F.sum("n").alias("n")).where("n > 0")


def place_class(carry: Sequence[str] = ()) -> Column:
    """All of a place that species are judged by, except its distances."""
    return F.struct(
        "planting_type", "territory", F.coalesce("under_line", F.lit(False)).alias("under_line"), F.coalesce(F.col("shade") >= SHADE_SUN_MAX, F.lit(False)).alias("dark"),
        F.coalesce(F.col("salt_m") < SALT_ZONE_M, F.lit(False)).alias("salty"), *carry)


def classed_places(
    points: DataFrame, by_class: DataFrame, species: DataFrame, species_rules: DataFrame, *, key: Sequence[str], carry: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(plantings with ``class`` and ``blocked``, class with ``class``, its species and ``reason`` without distances).

    ``blocked`` holds the norms by distance that keep species off a place, by species. The catalogue is judged once for each
    class, of which there are as many as combinations of a closed list of values, so it is never laid beside the plantings.
    """
    blocked = blocked_pairs(points, by_class, species, species_rules, key).where("distance_rule is not null").groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("species_no", F.concat(F.lit("distance:"), F.col("distance_rule"))))).alias("blocked"))
    placed = points.join(blocked, list(key), "left").join(salt_distance(by_class, key), list(key), "left").withColumn("class", place_class(carry))
    kinds = points.select(*carry).distinct() if carry else points.sparkSession.range(1).select()
    flags = points.sparkSession.range(8).select((F.col("id") % 2 > 0).alias("under_line"), F.when(F.floor(F.col("id") / 2) % 2 > 0, SHADE_SUN_MAX).alias("shade"), F.when(F.col("id") > 3, 0.0).alias("salt_m"))
    reason = F.coalesce(F.concat(F.lit("norm:"), F.col("norm_block")), later_reason())
    judged = species.where("planting_type is not null and territory is not null").drop("species_code").crossJoin(F.broadcast(flags)).crossJoin(F.broadcast(kinds)).withColumns({"reason": reason, "class": place_class(carry)})
    return placed, judged


def best_admitted(
    points: DataFrame, by_class: DataFrame, species: DataFrame, species_rules: DataFrame, k: int, score: Column, *, key: Sequence[str] = ("site_id", "point_id"), carry: Sequence[str] = (),
    but: str = "own_no",
) -> DataFrame:
    """(key..., species_no, score): of each row of ``points`` the first ``k`` admitted species by score, then number, other than ``but``.

    ``score`` may depend on the species, on ``carry`` and on whether salt is near. A class ranks its species once; a place takes the first
    that its distances permit.
    """
    placed, judged = classed_places(points, by_class, species, species_rules, key=key, carry=carry)
    ranks = F.array_sort(F.collect_list(F.struct((-score).alias("minus"), F.col("species_no"))))
    ranked = judged.where("reason is null and species_no is not null").groupBy("class").agg(ranks.alias("ranked"))
    free = lambda s: (s["species_no"] != F.col(but)) & F.coalesce(F.col("blocked")[s["species_no"]].isNull(), F.lit(True))
    best = placed.join(F.broadcast(ranked), "class").withColumn("best", F.explode(F.slice(F.filter("ranked", free), 1, k)))
    return best.select(*key, "best.species_no", (-F.col("best.minus")).alias("score"))


def planted_or_why(
    points: DataFrame, by_class: DataFrame, species: DataFrame, species_rules: DataFrame, *, key: Sequence[str] = ("site_id", "point_id"),
) -> DataFrame:
    """(key..., ok, why): is a species admitted at a place, and if none is, the first of the reasons."""
    placed, judged = classed_places(points, by_class, species, species_rules, key=key)
    every = judged.groupBy("class").agg(F.collect_list(F.struct("species_no", "reason", F.col("norm_block").isNotNull().alias("by_norm"))).alias("judged"))
    near = lambda s: F.col("blocked")[s["species_no"]]
    ok = F.exists("judged", lambda s: s["reason"].isNull() & near(s).isNull())
    why = F.array_min(F.transform("judged", lambda s: F.when(s["by_norm"], s["reason"]).otherwise(F.coalesce(near(s), s["reason"]))))
    rows = placed.join(F.broadcast(every), "class").select(*key, ok.alias("ok"), F.when(~ok, why).alias("why"))
    return rows.groupBy(*key).agg(F.max("ok").alias("ok"), F.min("why").alias("why"))


def suitability(weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of the factors that are defined, in [0, 1]."""
    weights = weights or SUITABILITY_WEIGHTS
    salty = F.coalesce(F.col("salt_m") < SALT_ZONE_M, F.lit(False))
    base = F.col("compaction") / 2.0 + (1.0 - F.col("allergen") / 2.0)
    site = F.when(salty, (base + F.col("salt") / 2.0 + F.col("gas") / 2.0) / 4.0).otherwise(base / 2.0)
    use = F.when(F.col("structure_kind") == "row", F.col("use_row")).when(F.col("structure_kind") == "group", F.col("use_group")).when(F.col("structure_kind") == "single", F.col("use_single"))
    function = F.coalesce(use.cast("double"), F.lit(0.5))
    decor = F.least(F.lit(1.0), F.lit(2) / 12.0 + F.when(F.col("evergreen"), EVERGREEN_BONUS).otherwise(0.0))
    care = F.when(F.col("care_level") == 1, 1.0).when(F.col("care_level") == 2, 0.5).otherwise(0.0)
    category = F.when(F.col("category_mark") == "plus", 1.0).when(F.col("category_mark") == "limited", 0.5).otherwise(0.25)
    factors = {
        "site": site, "function": function, "decor": decor, "longevity": F.least(F.lit(1.0), F.col("lifespan_years") / REFERENCE_LIFESPAN),
        "care": care, "pilot": F.least(F.lit(1.0), F.col("pilot_streets") / PILOT_STREETS), "category": category,
        "shade": F.when(F.col("life_type") == "tree", F.least(F.lit(1.0), F.greatest(F.col("crown_mature_m"), F.lit(0.0)) / CANOPY_CROWN_M)),
    }
    total = weight = F.lit(0.0)
    for name, value in factors.items():
        w = F.lit(max(0.0, weights.get(name, 0.0)))
        total = total + F.coalesce(w * value, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def pair_step(first_crown: Column, second_crown: Column, row: Column, spacing: float = 5.0) -> Column:
    """Step between two trees: the row step, or three quarters of the mean crown within 5..7 m."""
    crown = (first_crown + second_crown) / 2.0 * (1.0 - CROWN_OVERLAP)
    return F.when(row, spacing).otherwise(F.least(F.greatest(crown, F.lit(spacing)), F.lit(max(GROUP_STEP_MAX_M, spacing))))


def step_min(step: Column, tree: bool = True) -> Column:
    relaxed = step * STEP_TOLERANCE
    return F.greatest(relaxed, F.least(step, F.lit(TREE_STEP_MIN_M))) if tree else relaxed


def allowance(share: Column, planned: Column) -> Column:
    return F.when(share * planned < 1, F.lit(1)).otherwise(F.floor(share * planned + 1e-9)).cast("long")


def quota_keys(plan: DataFrame, *, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (planting, quota key): species, genus, family and the conifer group."""
    entry = lambda level, key, share: F.struct(F.lit(level).alias("level"), key.cast("string").alias("key"), F.lit(share).alias("share"))
    keys = F.array(
        entry("species", F.col("species_no"), STRICT_QUOTAS["species"]), entry("genus", F.col("genus"), STRICT_QUOTAS["genus"]),
        entry("family", F.col("family"), STRICT_QUOTAS["family"]),
    )
    keys = F.when(F.col("conifer"), F.concat(keys, F.array(entry("conifer", F.lit("conifer"), STRICT_QUOTAS["conifer"])))).otherwise(keys)
    return plan.withColumn("q", F.explode(keys)).select("site_id", *carry, "q.level", "q.key", "q.share")


def quota_limits(keys: DataFrame, planned: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Per (site, key): count, allowance in the plan, allowance with the existing trees, excess.

    ``existing(site_id, level, key, grown)`` counts the trees that already grow; conifers ignore
    them. A key whose existing share is already above its quota is exhausted: nothing may be added.
    """
    counts = keys.groupBy("site_id", "level", "key", "share").agg(F.count(F.lit(1)).alias("count"))
    rows = counts.join(planned, "site_id")
    if existing is None:
        rows = rows.withColumn("grown", F.lit(0).cast("long")).withColumn("grown_total", F.lit(0).cast("long"))
    else:
        totals = existing.where(F.col("level") == "species").groupBy("site_id").agg(F.sum("grown").alias("grown_total"))
        rows = rows.join(existing, ["site_id", "level", "key"], "left").join(totals, "site_id", "left")
        rows = rows.withColumn("grown", F.coalesce("grown", F.lit(0))).withColumn("grown_total", F.coalesce("grown_total", F.lit(0)))
    matters = (F.col("level") != "conifer") & (F.col("grown_total") > 0)
    exhausted = matters & (F.col("grown") > 0) & (F.col("grown") > F.col("share") * F.col("grown_total") + 1e-9)
    population = F.floor(F.col("share") * (F.col("planned") + F.col("grown_total")) + 1e-9) - F.col("grown")
    plan_limit = allowance(F.col("share"), F.col("planned"))
    limit = F.when(exhausted, F.lit(0)).when(matters, F.least(plan_limit, population)).otherwise(plan_limit).cast("long")
    return rows.withColumn("exhausted", exhausted).withColumn("limit", limit).withColumn(
        "excess", F.greatest(F.lit(0), F.col("count") - F.col("limit")).cast("long")
    )


def structures(points: DataFrame, spacing: float = 5.0, id_col: str = "point_id") -> DataFrame:
    """Single linkage per mode: components of points nearer than 1.5 steps, with the kind."""
    pairs = spatial.self_pairs(points, spacing * CLUSTER_FACTOR, id_col=id_col, on=("site_id", "mode"), strict=False)
    edges = pairs.select(F.col(f"a_{id_col}").alias("a"), F.col(f"b_{id_col}").alias("b"))
    labels = graph.connected_components(points, edges, key=id_col)
    sized = points.join(labels, id_col)
    counts = sized.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sized.join(counts, "component").withColumn("kind", structure_kind())


def structure_kind() -> Column:
    """Row, group or single from the mode and the size of the cluster."""
    mode, size = F.col("mode"), F.col("size")
    return (
        F.when(size < 2, "single").when(mode.isin(*GROUP_MODES), "group").when(mode.isin(*ROW_MODES), "row")
        .when(mode == "lawn", F.when(size >= 3, "group").otherwise("single")).otherwise("row")
    )


def shannon(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shannon index of ``n`` within ``by``."""
    total = F.sum("n").over(Window.partitionBy(*by))
    share = F.col("n") / total
    return counts.withColumn("_p", -(share * F.ln(share))).groupBy(*by).agg(F.round(F.sum("_p"), 4).alias("shannon"))
