"""Candidate places: lattices, stations, conflicts and selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.functions import geom
from streetgrove.operators import graph, spatial
from streetgrove.session import Growing, cut

# Fixed values.
CURB_OFFSETS_M = (3.0, 2.5, 2.0)
SPACING_M = 5.0
GROUP_SIDE_M = 6.0
GROUP_STEP_M = 18.0
SHRUB_GROUP_SIZE = 3
SHRUB_GROUP_SPACING_M = 1.0
ROW_STEP_M = (4.0, 12.0)
ROW_TOLERANCE = 0.1
ROW_MIN_TREES = 4
ROW_MAX_GAP = 2
ROW_EXTEND = 6
MODE_ORDER = ("existing_row", "alley", "lawn", "groups", "fill")


def stable_id(prefix: str, kind: Column, x: Column, y: Column) -> Column:
    """Prefix and the first 12 hex digits of the hash of type and centimetre coordinates.

    Coordinates are whole millimetres; a half centimetre goes up, so the text does not depend on
    how a platform prints binary fractions.
    """
    def centimetres(v: Column) -> Column:
        return F.format_string("%.2f", F.floor((F.round(v * 1000).cast("long") + 5) / 10) / 100.0)

    key = F.concat_ws(":", F.lit(prefix), kind, centimetres(x), centimetres(y))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(key, 256), 1, 12))


def grid_points(sites: DataFrame, cell: float) -> DataFrame:
    """Centres of the cells of every site square, with row and col."""
    cols = F.sequence(F.lit(0), F.ceil((F.col("x1") - F.col("x0")) / cell).cast("int") - 1)
    rows = F.sequence(F.lit(0), F.ceil((F.col("y1") - F.col("y0")) / cell).cast("int") - 1)
    return (
        sites.withColumn("row", F.explode(rows)).repartition("site_id", "row").withColumn("col", F.explode(cols))
        .withColumn("x", F.col("x0") + (F.col("col") + 0.5) * cell).withColumn("y", F.col("y0") + (F.col("row") + 0.5) * cell)
        .withColumn("point_id", F.col("row").cast("long") * 100000 + F.col("col")).select("site_id", "point_id", "row", "col", "x", "y")
    )


def mode_rank(mode: Column | str = "mode") -> Column:
    col = F.col(mode) if isinstance(mode, str) else mode
    rank = F.lit(len(MODE_ORDER))
    for i, name in reversed(list(enumerate(MODE_ORDER))):
        rank = F.when(col == name, i).otherwise(rank)
    return rank


def option_rank(verdict: str = "verdict", barrier: str = "needs_barrier") -> Column:
    """Allowed before approval, without a barrier before with one; null is not acceptable."""
    extra = F.col(barrier).cast("int")
    return F.when(F.col(verdict) == "allowed", extra).when(F.col(verdict) == "needs_approval", 2 + extra)


def greedy(candidates: DataFrame, gap: float) -> DataFrame:
    """Stations in order, at each the best option not nearer than the gap to an accepted one.

    Candidates carry mode, station, verdict, needs_barrier, opt. The place of a candidate in the
    sequential walk is (mode, station, rank of the option, opt), so the walk equals thinning in
    that order with one place per station.
    """
    ranked = candidates.withColumn("m", mode_rank()).withColumn("r", option_rank()).where(F.col("r").isNotNull())
    ranked = ranked.withColumn("stop", F.concat_ws(":", F.col("m"), F.col("station")))
    return graph.first_spaced_points(ranked, gap, order=("m", "station", "r", "opt", "point_id"), group="stop")


def preference() -> Column:
    """Points of the weighted selection: allowed 8, no barrier 4, existing row 3, alley 2."""
    return (
        F.lit(1) + F.when(F.col("verdict") == "allowed", 8).otherwise(0) + F.when(F.col("needs_barrier"), 0).otherwise(4)
        + F.when(F.col("mode") == "existing_row", 3).otherwise(0) + F.when(F.col("mode") == "alley", 2).otherwise(0)
    )


def conflicts(candidates: DataFrame, gap: float, *, station: Sequence[str] = ("site_id", "stop")) -> DataFrame:
    """Pairs nearer than the gap, and pairs of options of one station.

    Options of a station that are near are found by the distance alone, so no pair comes twice and the pairs are not dealt
    out; only where candidates repeat a number are they made distinct.
    """
    near = spatial.self_pairs(candidates, gap).select("site_id", F.col("a_point_id").alias("a"), F.col("b_point_id").alias("b"))
    lhs = candidates.select(*station, F.col("point_id").alias("a"), "x", "y")
    rhs = candidates.select(*station, F.col("point_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    apart = ~F.coalesce(geom.point_distance("x", "y", "bx", "by") < gap, F.lit(False))
    same = lhs.join(rhs, list(station)).where(F.col("a") < F.col("b")).where(apart).select("site_id", "a", "b")
    every = near.unionByName(same)
    repeated = candidates.groupBy("site_id", "point_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return every if repeated.isEmpty() else every.distinct()


def stations_along(lines: DataFrame, step: float, offsets: Sequence[float] = CURB_OFFSETS_M) -> DataFrame:
    """Stations at step/2 + k*step along each straight line, both sides, every offset in order."""
    length = geom.segment_length()
    count = F.when(length >= step, F.ceil((length - step / 2) / step)).otherwise(1).cast("int")
    at = F.when(F.col("_len") >= step, step / 2 + F.col("k") * step).otherwise(F.col("_len") / 2)
    rows = lines.withColumn("_len", length).where("_len > 0").withColumn("k", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("at", at)
    size = F.nullif("_len", F.lit(0.0))
    ux, uy = (F.col("x2") - F.col("x1")) / size, (F.col("y2") - F.col("y1")) / size
    bx, by = F.col("x1") + ux * F.col("at"), F.col("y1") + uy * F.col("at")
    return (
        rows.withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).select("*", F.posexplode(F.array(*[F.lit(float(o)) for o in offsets])).alias("opt", "offset"))
        .withColumn("x", F.round(bx - uy * F.col("side") * F.col("offset"), 3)).withColumn("y", F.round(by + ux * F.col("side") * F.col("offset"), 3))
        .select("site_id", "feature_id", "k", "side", "opt", "offset", "x", "y")
    )


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Interleaved bits of two scaled coordinates in [0, 1]."""
    top = float((1 << bits) - 1)
    sx, sy = F.floor(x * top).cast("long"), F.floor(y * top).cast("long")
    code = F.lit(0).cast("long")
    for bit in range(bits):
        code = code + F.shiftleft(F.shiftright(sx, bit) % 2, 2 * bit) + F.shiftleft(F.shiftright(sy, bit) % 2, 2 * bit + 1)
    return code


def tree_groups(sites: DataFrame, side: float = GROUP_SIDE_M, step: float = GROUP_STEP_M) -> DataFrame:
    """Corners of triangles on a hexagonal lattice, every second row turned over."""
    radius, rise = side / math.sqrt(3), step * math.sqrt(3) / 2
    rows = F.sequence(F.lit(0), F.ceil((F.col("y1") - F.col("y0") - step / 2) / rise).cast("int") - 1)
    odd = F.col("row") % 2
    first = F.col("x0") + step / 2 + odd * (step / 2)
    cols = F.sequence(F.lit(0), F.ceil((F.col("x1") - first) / step).cast("int") - 1)
    turn = F.lit(math.pi / 2) + F.col("corner") * (2 * math.pi / 3) + odd * math.pi
    return (
        sites.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols)).withColumn("corner", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            "site_id", "row", "col", "corner", F.round(first + F.col("col") * step + radius * F.cos(turn), 3).alias("x"),
            F.round(F.col("y0") + step / 2 + F.col("row") * rise + radius * F.sin(turn), 3).alias("y"),
        )
    )


def square_offsets(size: int, spacing: float) -> list[tuple[float, float]]:
    steps = [(i - (size - 1) / 2) * spacing for i in range(size)]
    return [(dx, dy) for dx in steps for dy in steps]


def around(points: DataFrame, offsets: Sequence[tuple[float, float]]) -> DataFrame:
    """Every point repeated at fixed offsets, numbered ``k``; coordinates to the millimetre."""
    array = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    moved = points.select("*", F.posexplode(array).alias("k", "o"))
    return moved.withColumn("x", F.round(F.col("x") + F.col("o.dx"), 3)).withColumn("y", F.round(F.col("y") + F.col("o.dy"), 3)).drop("o")


def _members(stems: DataFrame, lines: DataFrame, steps: int) -> DataFrame:
    """Places ``k`` of each line that hold a stem, walked ``steps`` of the longest steps to either side."""
    high = ROW_STEP_M[1]
    reach = high * steps
    strip = lines.withColumn("x1", F.col("ox") - F.col("ux") * reach).withColumn("y1", F.col("oy") - F.col("uy") * reach).withColumn(
        "x2", F.col("ox") + F.col("ux") * reach).withColumn("y2", F.col("oy") + F.col("uy") * reach)
    near = spatial.near_segments(stems.select("site_id", "stem_id", "x", "y"), strip, high * ROW_TOLERANCE, cell=24.0, spread=("stem_id",))
    along = (F.col("x") - F.col("ox")) * F.col("ux") + (F.col("y") - F.col("oy")) * F.col("uy")
    across = (F.col("x") - F.col("ox")) * -F.col("uy") + (F.col("y") - F.col("oy")) * F.col("ux")
    k = F.rint(along / F.nullif("step", F.lit(0.0)))
    limit = F.lit(ROW_TOLERANCE) * F.col("step")
    fits = (F.abs(across) <= limit) & (F.abs(along - k * F.col("step")) <= limit)
    return near.where(fits).select("site_id", "a", "b", "ox", "oy", "ux", "uy", "step", k.cast("int").alias("k")).distinct()


def rows_of_stems(stems: DataFrame, steps: int = 16) -> DataFrame:
    """Places that continue rows of existing trees: gaps of a row and six steps past each end.

    A pair 4..12 m apart proposes a line; stems within a tenth of the step of the line's places
    are its members. Members of the connected part around the pair must contain four in a row.
    A line is walked ``steps`` long steps to either side; where its row reaches the end of the
    walk, it is walked again four times as far, until every row ends inside.
    """
    low, high = ROW_STEP_M
    pairs = spatial.self_pairs(stems, high, id_col="stem_id", strict=False).where(F.col("distance") >= low)
    key = ["site_id", "a", "b"]
    line = [*key, "ox", "oy", "ux", "uy", "step"]
    lines = pairs.select(
        "site_id", F.col("a_stem_id").alias("a"), F.col("b_stem_id").alias("b"), F.col("a_x").alias("ox"), F.col("a_y").alias("oy"), F.col("distance").alias("step"),
        ((F.col("b_x") - F.col("a_x")) / F.nullif("distance", F.lit(0.0))).alias("ux"), ((F.col("b_y") - F.col("a_y")) / F.nullif("distance", F.lit(0.0))).alias("uy"),
    )
    lines = cut(lines, "lines")
    settled = Growing("rows")
    while True:
        w = Window.partitionBy(*key).orderBy("k")
        gapped = _members(stems, lines, steps).withColumn("_d", F.col("k") - F.lag("k").over(w))
        part = gapped.withColumn("_part", F.sum(F.when(F.col("_d") > ROW_MAX_GAP, 1).otherwise(0)).over(w)).withColumn("_run", F.sum(F.when(F.col("_d") > 1, 1).otherwise(0)).over(w))
        home = part.where("k = 0").select(*key, F.col("_part").alias("_home"))
        mine = cut(part.join(home, key).where(F.col("_part") == F.col("_home")).drop("_home"), "members")
        ends = mine.groupBy(*line).agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
        # Places of a short step reach further on the same walk; the shorter way in steps decides.
        open_end = F.greatest(-F.col("k0"), F.col("k1")) + ROW_MAX_GAP >= F.floor(F.lit(high * steps) / F.col("step"))
        settled.add(mine.join(ends.where(~open_end).select(*key), key, "left_semi"))
        lines = cut(ends.where(open_end).select(*line), "lines")
        if lines.isEmpty():
            break
        steps *= 4
    mine = settled.all()
    longest = mine.groupBy(*key, "_run").count().groupBy(*key).agg(F.max("count").alias("_best")).where(F.col("_best") >= ROW_MIN_TREES)
    # The places of one row of trees, a line on the ground.
    rows = mine.join(longest, key).groupBy(*line).agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.collect_set("k").alias("ks"))
    wanted = F.concat(
        F.array_except(F.sequence("k0", "k1"), "ks"), F.transform(F.sequence(F.lit(1), F.lit(ROW_EXTEND)), lambda i: F.col("k1") + i),
        F.transform(F.sequence(F.lit(1), F.lit(ROW_EXTEND)), lambda i: F.col("k0") - i),
    )
    places = rows.withColumn("k", F.explode(wanted)).select(
        "site_id", "a", "b", "k", (F.col("ox") + F.col("k") * F.col("step") * F.col("ux")).alias("x"), (F.col("oy") + F.col("k") * F.col("step") * F.col("uy")).alias("y"))
    spot = [F.rint(F.col("x") * 2).alias("sx"), F.rint(F.col("y") * 2).alias("sy")]
    return places.select("*", *spot).groupBy("site_id", "sx", "sy").agg(F.min_by(F.struct("x", "y"), F.struct("a", "b", "k")).alias("p")).select(
        "site_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))
