"""Quality index of a plan: targets, terms, penalties, worth of a planting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.functions import geom
from streetgrove.operators import spatial

# Fixed values of the index.
TERMS = ("density", "fit", "diversity", "rows", "tiers", "category", "canopy", "dust", "margin", "season")
TREES_PER_KM = 150.0
SHRUBS_PER_KM = 600.0
DIVERSITY_TARGET = 5
DIVERSITY_SHARE = 0.1
CANOPY_TARGET = 0.75
CANOPY_CROWN_M = 8.0
DUST_TARGET = 0.50
DUST_STRIP_M = 2.0
DUST_CROWN_FACTOR = 0.5
MARGIN_TARGET_M = 0.5
LOST_WEIGHT = 0.05
CONDITION_PENALTY = 0.2
ROW_TOLERANCE = 0.05
TREE_ROW_STEP = (5.0, 6.0)
SHRUB_ROW_STEP = (0.3, 1.0)
PI = 3.141592653589793

COVER_STRETCH_M = 64.0  # part of a segment whose cover one pass decides


def targets(streets: DataFrame, *, admissible: bool = True) -> DataFrame:
    """Trees and shrubs a street asks for; trees no more than its capacity, at least one each."""
    km = F.col("length_m") / 1000.0
    trees = F.lit(TREES_PER_KM) * km
    if admissible:
        trees = F.when(F.col("capacity").isNotNull(), F.least(trees, F.col("capacity").cast("double"))).otherwise(trees)
    return streets.select(
        "site_id", "length_m", F.greatest(trees, F.lit(1.0)).alias("t_trees"), F.greatest(F.lit(SHRUBS_PER_KM) * km, F.lit(1.0)).alias("t_shrubs")
    )


def half_sums(values: DataFrame, goals: DataFrame, value: str = "value") -> DataFrame:
    """Half for trees, half for shrubs: min(1, sum of the group / its target)."""
    tree = F.col("planting_type") == "tree"
    sums = values.groupBy("site_id").agg(
        F.sum(F.when(tree, F.col(value)).otherwise(0.0)).alias("trees"), F.sum(F.when(tree, 0.0).otherwise(F.col(value))).alias("shrubs")
    )
    return sums.join(goals, "site_id").withColumn(
        "score", 0.5 * F.least(F.lit(1.0), F.col("trees") / F.col("t_trees")) + 0.5 * F.least(F.lit(1.0), F.col("shrubs") / F.col("t_shrubs"))
    )


def fit_value() -> Column:
    """Suitability less the price of a condition and of weak pollen, not below zero."""
    owed = F.when(F.col("conditional"), 1).otherwise(0) + F.when(F.col("allergen") == 1, 1).otherwise(0)
    return F.greatest(F.lit(0.0), F.col("percent") / 100.0 - CONDITION_PENALTY * owed)


def category_value() -> Column:
    mark = F.col("category_mark")
    return F.when(mark == "plus", 1.0).when(mark == "limited", 0.5).when(mark == "minus", 0.0).otherwise(0.5)


def margin_value() -> Column:
    return F.when(F.col("slack_m").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("slack_m") / MARGIN_TARGET_M)))


def species_credit(plan: DataFrame, goals: DataFrame) -> DataFrame:
    """(site, type, species): count and credit min(1, count / a tenth of the group target)."""
    counts = plan.groupBy("site_id", "planting_type", "species_no").agg(F.count(F.lit(1)).alias("n"))
    goal = F.when(F.col("planting_type") == "tree", F.col("t_trees")).otherwise(F.col("t_shrubs"))
    unit = F.greatest(F.lit(1.0), F.lit(DIVERSITY_SHARE) * goal)
    return counts.join(goals, "site_id").withColumn("unit", unit).withColumn("credit", F.least(F.lit(1.0), F.col("n") / F.col("unit")))


def diversity(credits: DataFrame) -> DataFrame:
    group = credits.groupBy("site_id", "planting_type").agg(F.sum("credit").alias("richness"))
    part = F.least(F.lit(1.0), F.col("richness") / DIVERSITY_TARGET)
    return group.groupBy("site_id").agg(F.sum(0.5 * part).alias("score"))


def row_holders(members: DataFrame, structure: Sequence[str]) -> DataFrame:
    """Row members with a same-species neighbour at the step of the norm (within 5 %).

    Members are ordered along the principal axis of the row: the covariance gives its angle and
    the projection gives the order.
    """
    keys = list(structure)
    frame = members.groupBy(*keys).agg(
        F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.covar_pop("x", "x").alias("_xx"), F.covar_pop("y", "y").alias("_yy"),
        F.covar_pop("x", "y").alias("_xy"), F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("planting_type") == "shrub", 1).otherwise(0)).alias("_shrubs"),
    ).where(F.col("_n") >= 2)
    angle = 0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))
    along = (F.col("x") - F.col("_mx")) * F.cos(angle) + (F.col("y") - F.col("_my")) * F.sin(angle)
    rows = members.join(frame, keys).withColumn("_t", F.round(along, 6))
    w = Window.partitionBy(*keys).orderBy("_t", "point_id")
    low = F.when(F.col("_shrubs") == 1, SHRUB_ROW_STEP[0]).otherwise(TREE_ROW_STEP[0]) * (1 - ROW_TOLERANCE)
    high = F.when(F.col("_shrubs") == 1, SHRUB_ROW_STEP[1]).otherwise(TREE_ROW_STEP[1]) * (1 + ROW_TOLERANCE)

    def good(shift) -> Column:
        step = geom.hypot2(F.col("x") - shift("x"), F.col("y") - shift("y"))
        return F.coalesce(step.between(low, high) & (F.col("species_no") == shift("species_no")), F.lit(False))

    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    return rows.withColumn("holds", good(before) | good(after)).drop("_mx", "_my", "_xx", "_yy", "_xy", "_n", "_shrubs", "_t")


def circle_cells(circles: DataFrame, cell: float, *, bounds: DataFrame | None = None, key: Sequence[str] = ("site_id",)) -> DataFrame:
    """Cells whose centre lies in a circle (x, y, radius), clipped to the site square when given."""
    keys = list(key)
    xs = F.explode(geom.cell_range(F.col("x") - F.col("radius"), F.col("x") + F.col("radius"), cell))
    ys = F.explode(geom.cell_range(F.col("y") - F.col("radius"), F.col("y") + F.col("radius"), cell))
    cx, cy = (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell
    rows = circles.withColumn("cx", xs).withColumn("cy", ys).where(geom.hypot2(cx - F.col("x"), cy - F.col("y")) <= F.col("radius"))
    if bounds is None:
        return rows
    return rows.join(bounds, keys).where(cx.between(F.col("x0"), F.col("x1")) & cy.between(F.col("y0"), F.col("y1")))


def covered_area(circles: DataFrame, cell: float, *, bounds: DataFrame | None = None, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Area of a union of circles: distinct covered cells times the cell area."""
    cells = circle_cells(circles, cell, bounds=bounds).select(*by, "cx", "cy").distinct()
    return cells.groupBy(*by).agg((F.count(F.lit(1)) * F.lit(cell * cell)).alias("area_m2"))


def cover_intervals(segments: DataFrame, circles: DataFrame) -> DataFrame:
    """Part [a, b] of every segment (metres from its start) that each circle covers; searched as far as the widest circle."""
    reach = circles.agg(F.max("radius").alias("r")).first()["r"] or 1.0
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pairs = spatial.near_segments(circles, segments, reach).where(F.col("distance") < F.col("radius")).withColumn("len", geom.segment_length()).where(F.col("len") > 0)
    size = F.nullif("len", F.lit(0.0))
    along = ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / size
    off = ((F.col("x") - F.col("x1")) * dy - (F.col("y") - F.col("y1")) * dx) / size
    half = F.sqrt(F.greatest(F.lit(0.0), F.col("radius") * F.col("radius") - off * off))
    return pairs.withColumn("a", F.greatest(F.lit(0.0), along - half)).withColumn("b", F.least(F.col("len"), along + half)).where(F.col("b") > F.col("a"))


def union_length(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Length of the union of intervals per ``by``: a sorted sweep, linear in the intervals."""
    w = Window.partitionBy(*by).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("b").over(w), F.lit(0.0))
    fresh = F.greatest(F.lit(0.0), F.col("b") - F.greatest(F.col("a"), reached))
    return intervals.withColumn("_fresh", fresh).groupBy(*by).agg(F.sum("_fresh").alias("length_m"))


def skyline(group: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b, weight) of disjoint pieces with the best weight over each, per group; n log n whatever overlaps.

    The ends of a group cut it into places. An interval of n places is two overlapping runs of 2^k places; runs hand their
    best weight down to their two halves, from the longest to single places.
    """
    good = (weight > 0) & (b > a)
    group, a, b, weight = group[good], a[good], b[good], weight[good]
    if not len(a):
        return group, a, b, weight
    owner, end = np.concatenate((group, group)), np.concatenate((a, b))
    order = np.lexsort((end, owner))
    new = np.append(True, (owner[order][1:] != owner[order][:-1]) | (end[order][1:] != end[order][:-1]))
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    where, place = owner[order][new], end[order][new]
    first, last = at[: len(a)], at[len(a) :]
    size = np.floor(np.log2(last - first)).astype(np.int64)
    best = np.zeros(len(where))
    for k in range(int(size.max()), -1, -1):
        own = size == k
        np.maximum.at(best, first[own], weight[own])
        np.maximum.at(best, last[own] - (1 << k), weight[own])
        if k:
            half = 1 << (k - 1)
            best[half:] = np.maximum(best[half:], best[: len(best) - half].copy())
    held = np.flatnonzero((best[:-1] > 0) & (where[:-1] == where[1:]))
    # Neighbouring pieces of one weight are one piece.
    starts = np.flatnonzero(np.append(True, (held[1:] != held[:-1] + 1) | (best[held[1:]] != best[held[:-1]])))
    return where[held[starts]], place[held[starts]], place[held[np.append(starts[1:], len(held)) - 1] + 1], best[held[starts]]


def _best_pieces(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The skyline of each batch: what is never best does not travel."""
    for frame in frames:
        codes = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        where = np.unique(codes, return_index=True)[1]
        group, a, b, weight = skyline(codes, frame["a"].to_numpy(), frame["b"].to_numpy(), frame["weight"].to_numpy())
        out = frame[keys].iloc[where[group]].reset_index(drop=True)
        yield out.assign(a=a, b=b, weight=weight)


def _best_of_sorted(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Weighted length per key of rows sorted by key; of the last key of a batch only its skyline so far is kept."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        codes = np.cumsum(new) - 1
        group, a, b, weight = skyline(codes, frame["a"].to_numpy(), frame["b"].to_numpy(), frame["weight"].to_numpy())
        names, open_ = frame.loc[new, keys].reset_index(drop=True), group == codes[-1]
        held = pd.concat([names.iloc[group[open_]].reset_index(drop=True), pd.DataFrame({"a": a[open_], "b": b[open_], "weight": weight[open_]})], axis=1)
        done = np.bincount(group[~open_], (weight * (b - a))[~open_], minlength=len(names))[: len(names) - 1]
        yield names.iloc[: len(names) - 1].assign(weighted_m=done)
    if held is not None and len(held):
        yield held[keys].head(1).assign(weighted_m=float((held["weight"] * (held["b"] - held["a"])).sum()))


def weighted_cover(intervals: DataFrame, by: Sequence[str] = ("site_id",), segment: Sequence[str] = ("feature_id", "ring_id", "seg_no")) -> DataFrame:
    """Covered length where the best weight wins.

    Segments are cut into stretches of ``COVER_STRETCH_M``. A task keeps of its intervals only the skyline, the best weight over
    each place, before the shuffle; the skylines of a stretch meet in one ordered pass, whose memory is one skyline. An
    interval never meets the weights or intervals of the others one by one. Null ends or weights cover nothing.
    """
    keys = [*by, *segment, "_stretch"]
    first, last = F.floor(F.col("a") / COVER_STRETCH_M).cast("long"), (F.ceil(F.col("b") / COVER_STRETCH_M) - 1).cast("long")
    rows = intervals.where("weight > 0 and b > a").withColumn("_stretch", F.explode(F.sequence(first, F.greatest(first, last))))
    edge = F.col("_stretch") * F.lit(COVER_STRETCH_M)
    rows = rows.select(*keys, F.greatest("a", edge).alias("a"), F.least("b", edge + COVER_STRETCH_M).alias("b"), F.col("weight").cast("double").alias("weight"))
    names = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    best = rows.mapInPandas(partial(_best_pieces, keys=keys), f"{names}, a double, b double, weight double")
    ordered = best.repartition(*keys).sortWithinPartitions(*keys, "a")
    lengths = ordered.mapInPandas(partial(_best_of_sorted, keys=keys), f"{names}, weighted_m double")
    return lengths.groupBy(*by).agg(F.sum("weighted_m").alias("weighted_m"))


def index(terms: DataFrame, weights: DataFrame, penalties: DataFrame, *, by: Sequence[str] = ("site_id",), gates: DataFrame | None = None) -> DataFrame:
    """Weighted mean over the defined terms less the penalty, clipped; null behind a gate."""
    rows = terms.join(F.broadcast(weights), "term").where(F.col("score").isNotNull() & (F.col("weight") > 0))
    raw = rows.groupBy(*by).agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("raw"), F.count(F.lit(1)).alias("n_terms"))
    out = raw.join(penalties, list(by), "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw") - F.col("penalty")))
    if gates is not None:
        out = out.join(gates, list(by), "left")
        value = F.when(F.coalesce("gated", F.lit(False)), F.lit(None)).otherwise(value)
    return out.withColumn("index", value)


def largest_remainder(parts: DataFrame, by: Sequence[str], *, value: str = "value", name: str = "part") -> DataFrame:
    """Parts in thousandths that add up to the rounded total."""
    scaled = F.round(F.col(value) * 1000, 6)
    total = F.round(F.sum(value).over(Window.partitionBy(*by)) * 1000, 6)
    rows = parts.withColumn("_floor", F.floor(scaled)).withColumn("_rest", F.round(scaled - F.floor(scaled), 6)).withColumn("_total", F.round(total, 0).cast("long"))
    missing = F.col("_total") - F.sum("_floor").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_rest"), name))
    return rows.withColumn("_missing", missing).withColumn("thousandths", F.col("_floor") + F.when(rank <= F.col("_missing"), 1).otherwise(0)).drop("_floor", "_rest", "_total", "_missing")
