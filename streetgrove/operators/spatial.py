"""Bucketed spatial joins: every near-join is an equi-join on grid cells, never a cross join."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetgrove.functions import geom
from streetgrove.session import Growing, cut

HOT_ROWS = 200_000  # rows of one cell that a single task is trusted with


def split_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], hot_rows: int = HOT_ROWS):
    """Salt the cells of ``left`` that hold more than ``hot_rows`` rows.

    The left rows of a hot cell are scattered over ``ceil(n / hot_rows)`` salts and only the
    right rows of that very cell are repeated. Cells are counted once; the table of hot ones has at most
    ``rows / hot_rows`` rows, and where it is empty nothing is joined.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = cut(counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")), "hot-cells")
    if hot.isEmpty():
        return left, right, list(keys)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left_salted = (
        left.join(hot, list(keys), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    )
    right_salted = (
        right.join(hot, list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    )
    return left_salted, right_salted, [*keys, "_salt"]


def named(rows: DataFrame) -> DataFrame:
    """The same rows with their columns generated: later terms name them, where a projection would repeat all that they are made of."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def with_cells(df: DataFrame, size: float, reach: Column, ends: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Repeat segments over the cells (_cx, _cy) that can hold a point within ``reach`` of them.

    The columns of cells are walked first; in a column only the part of the segment that passes
    near it counts, so a long diagonal costs its length and not its box, and no cell comes twice.
    Both steps are plain sequences inside generated code.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    pad = reach + F.lit(1e-6)
    columns = F.sequence(geom.cell_of(F.least(x1, x2) - pad, size), geom.cell_of(F.greatest(x1, x2) + pad, size))
    slope = F.nullif(x2 - x1, F.lit(0.0))
    clamp = lambda t, vertical: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(vertical))))
    ta = clamp((F.col("_cx") * size - pad - x1) / slope, 0.0)
    tb = clamp(((F.col("_cx") + 1) * size + pad - x1) / slope, 1.0)
    ya, yb = y1 + ta * (y2 - y1), y1 + tb * (y2 - y1)
    rows = F.sequence(geom.cell_of(F.least(ya, yb) - pad, size), geom.cell_of(F.greatest(ya, yb) + pad, size))
    return df.withColumn("_cx", F.explode(columns)).withColumn("_cy", F.explode(rows))


def near_segments(
    points: DataFrame,
    segments: DataFrame,
    radius: float,
    *,
    on: Sequence[str] = ("site_id",),
    cell: float | None = None,
    spread: Sequence[str] = ("point_id",),
    hot_rows: int | None = HOT_ROWS,
    reserve: Column | None = None,
) -> DataFrame:
    """Pairs (point, segment) not farther than ``radius``, with ``distance``.

    With ``reserve`` (a column of the segments) the limit is ``radius + reserve`` per segment.

    A point sits in exactly one cell and a segment once in each cell its surroundings touch,
    so every pair appears once and no de-duplicating shuffle follows.
    """
    size = float(cell or max(radius, 1.0))
    limit = F.lit(float(radius)) if reserve is None else F.lit(float(radius)) + reserve
    left = points.withColumn("_cx", geom.cell_of("x", size)).withColumn("_cy", geom.cell_of("y", size))
    right = with_cells(segments.withColumn("_reach", limit), size, F.col("_reach"))
    keys = [*on, "_cx", "_cy"]
    if hot_rows:
        left, right, keys = split_hot(left, right, keys, spread, hot_rows)
    # The box first, then the distance as a generated row: a filter would repeat its terms till Java no longer compiles them.
    pad = F.col("_reach") + 1e-6
    beside = F.isnan("_reach") | (
        (F.col("x") >= F.least("x1", "x2") - pad) & (F.col("x") <= F.greatest("x1", "x2") + pad) & (F.col("y") >= F.least("y1", "y2") - pad) & (F.col("y") <= F.greatest("y1", "y2") + pad))
    pairs = left.join(right, keys, "inner").drop("_cx", "_cy", "_salt").where(beside)
    return pairs.withColumn("distance", F.explode(F.array(geom.segment_distance()))).where(F.col("distance") <= F.col("_reach")).drop("_reach")


def near_points(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    *,
    on: Sequence[str] = ("site_id",),
    rx: str = "bx",
    ry: str = "by",
    spread: Sequence[str] = ("point_id",),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Pairs of points not farther than ``radius``: ``left(x, y)`` with ``right(rx, ry)``.

    Only ``right`` is repeated into its 3x3 neighbourhood; each pair appears once.
    """
    size = float(radius)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    lhs = left.withColumn("_cx", geom.cell_of("x", size)).withColumn("_cy", geom.cell_of("y", size))
    rhs = (
        right.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
        .withColumn("_cx", geom.cell_of(rx, size) + F.col("_dx"))
        .withColumn("_cy", geom.cell_of(ry, size) + F.col("_dy")).drop("_dx", "_dy")
    )
    keys = [*on, "_cx", "_cy"]
    if hot_rows:
        lhs, rhs, keys = split_hot(lhs, rhs, keys, spread, hot_rows)
    pairs = lhs.join(rhs, keys, "inner").drop("_cx", "_cy", "_salt")
    return pairs.withColumn("distance", geom.point_distance("x", "y", rx, ry)).where(F.col("distance") <= radius)


def self_pairs(
    points: DataFrame, radius: float, *, id_col: str = "point_id", carry: Sequence[str] = (),
    on: Sequence[str] = ("site_id",), strict: bool = True,
) -> DataFrame:
    """Unordered pairs ``a_id < b_id`` closer than ``radius`` (``<=`` when not strict)."""
    cols = [*on, id_col, "x", "y", *carry]
    lhs = points.select(*on, *[F.col(c).alias(f"a_{c}") for c in cols if c not in on], "x", "y")
    rhs = points.select(*on, *[F.col(c).alias(f"b_{c}") for c in cols if c not in on])
    pairs = near_points(lhs, rhs, radius, on=on, rx="b_x", ry="b_y", spread=(f"a_{id_col}",)).drop("x", "y")
    pairs = pairs.where(F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))
    return pairs.where(F.col("distance") < radius) if strict else pairs


def contained(
    points: DataFrame, rings: DataFrame, *, point_key: Sequence[str], area_key: Sequence[str],
    on: Sequence[str] = ("site_id",), band: float = 16.0,
) -> DataFrame:
    """(point, area) rows where the point lies inside: parity of crossings of a rightward ray.

    Edges and points meet on horizontal bands, and the x extent of the area prunes the pair
    before the parity is summed. Holes need no special case.
    """
    on, area_key, point_key = list(on), list(area_key), list(point_key)
    extent = rings.groupBy(*on, *area_key).agg(
        F.min(F.least("x1", "x2")).alias("_minx"), F.max(F.greatest("x1", "x2")).alias("_maxx")
    )
    edges = (
        rings.where(F.col("y1") != F.col("y2")).select(*on, *area_key, "x1", "y1", "x2", "y2").join(extent, [*on, *area_key])
        .withColumn("_band", F.explode(geom.cell_range(F.least("y1", "y2"), F.greatest("y1", "y2"), band)))
        .withColumn("_col", F.explode(geom.cell_range(F.col("_minx"), F.col("_maxx"), band * 4)))
    )
    probe = points.withColumn("_band", geom.cell_of("y", band)).withColumn("_col", geom.cell_of("x", band * 4))
    hits = probe.join(edges, [*on, "_band", "_col"], "inner").where(F.col("x").between(F.col("_minx"), F.col("_maxx")) & (geom.ray_crosses() == 1))
    return (
        hits.groupBy(*on, *point_key, *area_key)
        .agg(F.count(F.lit(1)).alias("_crossings"))
        .where(F.col("_crossings") % 2 == 1).drop("_crossings")
    )


def lowest_areas(
    points: DataFrame, rings: DataFrame, *, point_key: Sequence[str] = ("point_id",), kind: str = "object_class", on: Sequence[str] = ("site_id",),
    cell: float = 8.0, many: float = 2.0,
) -> DataFrame:
    """(on..., point key..., kind, feature_id): of every kind the lowest area that the point lies inside.

    Where more than ``many`` areas lie over one another, they are not listed a point: a cell that an area holds whole is
    inside for all its points, so only areas with an edge in the cell and a lower id than that are tried point by point.
    Areas whose edges do not close are tried as ``contained`` does.
    """
    on, point_key = list(on), list(point_key)
    key = [*on, kind, "feature_id"]
    rings = rings.select(*key, "x1", "y1", "x2", "y2").dropna(subset=key)
    points = points.select(*on, *[c for c in point_key if c not in on], "x", "y")
    own = [c for c in point_key if c not in on]

    def listed(areas: DataFrame) -> DataFrame:
        return contained(points, areas, point_key=own, area_key=(kind, "feature_id"), on=on)

    def lowest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*on, *own, kind).agg(F.min("feature_id").alias("feature_id"))

    blocks = points.select(*on, geom.cell_of("x", BLOCK_M).alias("cx"), geom.cell_of("y", BLOCK_M).alias("cy")).distinct().count()
    boxes = rings.groupBy(*key).agg(((F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))) * (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2")))).alias("b"))
    if (boxes.agg(F.sum("b").alias("b")).first()["b"] or 0.0) <= many * blocks * BLOCK_M * BLOCK_M:
        return lowest(listed(rings))
    ends = rings.select(*key, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select(*key, "e.*")
    open_ = cut(ends.groupBy(*key, "x", "y").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") % 2 == 1) | ~finite("x", "y")).select(*key).distinct(), "open-areas")
    closed = rings.join(open_, key, "left_anti")
    placed = points.withColumns({"_cx": geom.cell_of("x", cell), "_cy": geom.cell_of("y", cell)})
    at = [*on, "_cx", "_cy"]
    centres = placed.select(*at).distinct().withColumns({"x": (F.col("_cx") + 0.5) * cell, "y": (F.col("_cy") + 0.5) * cell})
    touched = cut(with_cells(closed, cell, F.lit(0.0)).select(*at, kind, "feature_id").distinct(), "touched")
    whole = contained(centres, closed, point_key=("_cx", "_cy"), area_key=(kind, "feature_id"), on=on).join(touched, [*at, kind, "feature_id"], "left_anti")
    whole = cut(whole.groupBy(*at, kind).agg(F.min("feature_id").alias("_low")), "whole-cells")
    tried = touched.join(whole, [*at, kind], "left").where(F.col("_low").isNull() | (F.col("feature_id") < F.col("_low"))).drop("_low")
    edged = contained(placed.join(tried, at).select(*key, *own, "x", "y"), closed, point_key=own, area_key=(), on=key)
    settled = placed.join(whole, at).select(*on, *own, kind, F.col("_low").alias("feature_id"))
    return lowest(settled.unionByName(edged).unionByName(listed(rings.join(open_, key, "left_semi"))))


def snap_cell(x: Column | str, y: Column | str, size: float) -> tuple[Column, Column]:
    return geom.cell_of(x, size), geom.cell_of(y, size)


def finite(*names: str) -> Column:
    """All of the columns are numbers, neither null nor NaN nor infinite."""
    span = sum((F.abs(F.col(n)) for n in names), F.lit(0.0))  # NaN is above infinity
    return F.coalesce(span < float("inf"), F.lit(False))


BLOCK_M = 64.0  # ground that densities are counted on
FEW_NEAR = 3.0  # objects of a class that a first narrow ring is meant to meet
MANY_NEAR = 64.0  # objects a point that one ring may meet
CELL_POINTS = 20.0


def crowded_radii(
    points: DataFrame, segments: DataFrame, widest: Mapping[str, float] | float | None, *, kind: str = "object_class",
) -> list[tuple[dict[str, float], float]]:
    """Narrow rings for dense classes: (radius of each class, edge of a cell), the narrowest first; none where ``widest`` meets few objects anyway.

    Densities are those of the ground that points stand on; they choose how far a ring goes, never what is found.
    """
    if widest is None:
        return []
    blocks = points.groupBy("site_id", geom.cell_of("x", BLOCK_M).alias("cx"), geom.cell_of("y", BLOCK_M).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    ground = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).first()
    if not ground["blocks"]:
        return []
    area = ground["blocks"] * BLOCK_M * BLOCK_M
    classes = segments.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(geom.segment_length()).alias("m")).where(F.col(kind).isNotNull()).collect()  # a closed list
    end = {r[kind]: float(widest[r[kind]] if isinstance(widest, Mapping) else widest) for r in classes}
    line, spot = {r[kind]: 2 * r["m"] / area for r in classes}, {r[kind]: math.pi * r["n"] / area for r in classes}
    if sum(line[c] * end[c] + spot[c] * end[c] ** 2 for c in end) <= MANY_NEAR:
        return []
    first = {c: 2 * FEW_NEAR / (line[c] + math.sqrt(line[c] ** 2 + 4 * FEW_NEAR * spot[c])) for c in end}
    edge = max(math.sqrt(CELL_POINTS * area / ground["n"]), min(first.values()), 1e-3)
    return [({c: min(end[c], first[c] * wide) for c in end}, min(edge * wide, BLOCK_M)) for wide in (1.0, 2.5)]


def widening(rings: Sequence[float], extent: Callable[[], float]) -> Iterator[float]:
    """The rings, and then each four times as wide as the last until one covers ``extent``; the caller may stop earlier."""
    yield from rings
    farthest = extent()
    radius = rings[-1] if rings else farthest
    while radius < farthest:
        radius = min(radius * 4, farthest)
        yield radius
    if not rings:
        yield farthest


def farthest(points: DataFrame, segments: DataFrame) -> float:
    """No point is farther from a segment of its site: the longest diagonal of a site's points and segments, and a little more."""
    xs, ys = [F.col("x1"), F.col("x2")], [F.col("y1"), F.col("y2")]
    ends = segments.select("site_id", F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in zip(xs, ys, strict=True)])).alias("e")).select("site_id", "e.*")
    box = points.select("site_id", "x", "y").unionByName(ends).groupBy("site_id").agg(
        (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    widest = box.agg(F.max(geom.hypot2(F.col("w"), F.col("h"))).alias("d")).first()["d"]
    return (widest or 0.0) * 1.001 + 1.0


def as_segments(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points as segments of no length, for searches among segments."""
    return points.withColumns({"x1": F.col(x), "y1": F.col(y), "x2": F.col(x), "y2": F.col(y)}).drop(x, y)


def nearest_segment(
    points: DataFrame, segments: DataFrame, rings: Sequence[float], *, key: Sequence[str] = ("site_id", "point_id"), payload: Sequence[str] = ("feature_id",),
) -> DataFrame:
    """Nearest segment of every point with its ends, widening ring by ring; ties to the smallest payload.

    The rings go on, each four times as wide, until every point has its answer or a ring covers the site. Points whose
    site has no segment are absent from the result; a point without finite coordinates has a row of nulls, and a segment
    without them is no segment.
    """
    fields = [*payload, "x1", "y1", "x2", "y2"]
    segments = segments.where(finite("x1", "y1", "x2", "y2")).select("site_id", *fields)
    asked = points.select(*key, "x", "y").join(segments.select("site_id").distinct(), "site_id", "left_semi")
    todo = asked.where(finite("x", "y"))
    found = Growing("nearest")
    for radius in widening(rings, lambda: farthest(todo, segments)):
        pairs = near_segments(todo, segments, radius, spread=tuple(key))
        best = found.add(pairs.groupBy(*key).agg(F.min(F.struct("distance", *fields)).alias("n")))
        todo = cut(todo.join(best.select(*key), list(key), "left_anti"), "todo")
        if todo.isEmpty():
            break
    nowhere = asked.where(~finite("x", "y")).select(*key)
    return found.all().unionByName(nowhere, allowMissingColumns=True).select(*key, "n.distance", *[F.col(f"n.{c}").alias(c) for c in fields])


def first_hits(rays: DataFrame, lines: DataFrame, *, key: Sequence[str], line_key: str = "feature_id", touch: float = 1e-6, cell: float = 16.0) -> DataFrame:
    """(key..., along_m, hit): how far each ray (ax, ay, bx, by) runs until it meets a line of another ``line_key`` of its site.

    Rays and lines meet in the cells that they pass through; the nearest hit beyond ``touch`` wins, then the smallest line.
    A line in the ray's own direction is met at its nearer end.
    """
    key = list(key)
    lhs = with_cells(rays, cell, F.lit(0.0), ("ax", "ay", "bx", "by"))
    rhs = with_cells(lines.select("site_id", F.col(line_key).alias("_hit"), "x1", "y1", "x2", "y2"), cell, F.lit(0.0))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.nullif(geom.hypot2(dx, dy), F.lit(0.0))
    ux, uy = dx / size, dy / size
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ox, oy = F.col("x1") - F.col("ax"), F.col("y1") - F.col("ay")
    across = F.nullif(ux * ey - uy * ex, F.lit(0.0))
    along, part = (ox * ey - oy * ex) / across, (ox * uy - oy * ux) / across
    one, other = ox * ux + oy * uy, (F.col("x2") - F.col("ax")) * ux + (F.col("y2") - F.col("ay")) * uy
    same = (F.abs(ox * uy - oy * ux) <= touch) & (F.greatest(one, other) >= 0)
    met = F.when(across.isNull(), F.when(same, F.greatest(F.lit(0.0), F.least(one, other)))).when(part.between(0, 1), along)
    hits = lhs.join(rhs, ["site_id", "_cx", "_cy"]).where(F.col("_hit") != F.col(line_key)).withColumn("_along", met).where((F.col("_along") > touch) & (F.col("_along") <= size))
    return hits.groupBy(*key).agg(F.min(F.struct("_along", "_hit")).alias("m")).select(*key, F.col("m._along").alias("along_m"), F.col("m._hit").alias("hit"))


def shared_walls(edges: DataFrame, *, key: str = "face", on: Sequence[str] = ("site_id",), gap: float = 0.02, tile: float = 16.0) -> DataFrame:
    """(on..., a, b, shared_m): length that the edges of two faces run along each other, a < b, no farther apart than ``gap``.

    Edges, cut to a length of 128 m, meet by the square of their middle, their direction, the distance of their line from the
    corner of that square and the stretch of ``tile`` metres along it. Direction, distance and square are rounded, so one
    side is entered under every value that the other may have, and the exact test follows. No two edges of a face are compared
    otherwise.
    """
    on = list(on)
    turn, square, around = 1.0 / 512, 256.0, F.array(F.lit(-1), F.lit(0), F.lit(1))
    longest, spare = 128.0, 4.0  # directions that differ by a turn move places by less than the spare, as far as two squares go
    half = math.floor(math.pi / 2 / turn)  # directions run from -half - 1 to half; the next one is the first, seen from behind
    edges = named(edges.select(*on, key, "x1", "y1", "x2", "y2"))
    long_ = edges.where(finite("x1", "y1", "x2", "y2") & (geom.segment_length() > 0)).withColumn("_n", F.ceil(geom.segment_length() / longest))
    part = long_.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = lambda p, q, k: F.col(p) + (F.col(q) - F.col(p)) * (k / F.col("_n").cast("double"))
    rows = part.select(
        *on, key, at("x1", "x2", F.col("_k")).alias("x1"), at("y1", "y2", F.col("_k")).alias("y1"), at("x1", "x2", F.col("_k") + 1).alias("x2"), at("y1", "y2", F.col("_k") + 1).alias("y2"))
    rows = named(rows)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    back = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1.0).otherwise(1.0)
    rows = rows.withColumns({"_a": F.floor(F.atan2(dy * back, dx * back) / turn), "_sx": F.floor(F.col("x1") / 2 / square + F.col("x2") / 2 / square), "_sy": F.floor(F.col("y1") / 2 / square + F.col("y2") / 2 / square), "_w": back})
    rows = named(rows)

    def placed(frame: DataFrame, name: str, wide: bool) -> DataFrame:
        if wide:
            far = (geom.segment_length() + longest) / 2 + spare  # middles of edges that run along each other are no farther apart
            for c, (p, q) in (("_sx", ("x1", "x2")), ("_sy", ("y1", "y2"))):
                middle = F.col(p) / 2 + F.col(q) / 2
                frame = frame.withColumn(c, F.explode(geom.cell_range(middle - far, middle + far, square)))
            frame = named(frame.withColumn("_i", F.explode(around)).withColumn("_a", F.col("_a") + F.col("_i")).drop("_i"))
            over, under = F.col("_a") > half, F.col("_a") < -half - 1
            frame = frame.withColumn("_w", F.when(over | under, -F.col("_w")).otherwise(F.col("_w")))
            frame = frame.withColumn("_a", F.when(over, F.col("_a") - (2 * half + 2)).when(under, F.col("_a") + (2 * half + 2)).otherwise(F.col("_a")))
        size = F.nullif(geom.segment_length(), F.lit(0.0))
        ux, uy = dx * F.col("_w") / size, dy * F.col("_w") / size
        x1, y1, x2, y2 = F.col("x1") - F.col("_sx") * square, F.col("y1") - F.col("_sy") * square, F.col("x2") - F.col("_sx") * square, F.col("y2") - F.col("_sy") * square
        one, two = x1 * ux + y1 * uy, x2 * ux + y2 * uy
        frame = frame.select(
            *on, F.col(key).alias(name), "_sx", "_sy", "_a", F.least(one, two).alias("f" + name), F.greatest(one, two).alias("t" + name), ((x1 + x2) / 2 * uy - (y1 + y2) / 2 * ux).alias("o" + name),
            ux.alias("u" + name), uy.alias("v" + name))
        frame = named(frame)
        beside = F.lit(gap * 1.000001 if wide else 0.0)
        frame = frame.withColumn("_o", F.explode(geom.cell_range(F.col("o" + name) - beside, F.col("o" + name) + beside, 2 * gap)))
        return frame.withColumn("_t", F.explode(geom.cell_range(F.col("f" + name), F.col("t" + name), tile)))

    edge = F.col("_t") * F.lit(tile)
    common = F.least("ta", "tb", edge + tile) - F.greatest("fa", "fb", edge)
    alike = (F.abs(F.col("oa") - F.col("ob")) <= gap) & (F.abs(F.col("ua") * F.col("vb") - F.col("va") * F.col("ub")) <= turn)
    met = placed(rows, "a", False).join(placed(rows, "b", True), [*on, "_sx", "_sy", "_a", "_o", "_t"]).where((F.col("a") < F.col("b")) & alike).withColumn("_m", common).where("_m > 0")
    return met.groupBy(*on, "a", "b").agg(F.sum("_m").alias("shared_m"))


def discs_covered(discs: DataFrame, rings: DataFrame, *, key: Sequence[str] = ("site_id", "point_id"), on: Sequence[str] = ("site_id",), widest: float, cell: float = 32.0) -> DataFrame:
    """Keys of discs (x, y, radius) that lie wholly in the union of the areas ``rings(on..., feature_id, x1, y1, x2, y2)``.

    A disc is covered when its centre is and no edge inside it has open ground on a side. An edge changes sides only where
    another edge crosses or ends on it; between those places the middle of each stretch inside the disc is asked, a hair
    to its left and right. Only edges nearer than the radius are asked, so a disc deep inside an area costs one test.
    """
    on, key = list(on), list(key)
    hair, tiny = 1e-6, 1e-9
    edges = rings.where(finite("x1", "y1", "x2", "y2")).select(*on, "x1", "y1", "x2", "y2").distinct().where(geom.segment_length() > 0)
    edges = edges.withColumn("_edge", F.xxhash64(*on, "x1", "y1", "x2", "y2"))
    centre = contained(discs.select(*key, "x", "y"), rings, point_key=[k for k in key if k not in on], area_key=("feature_id",), on=on).select(*key).distinct()
    inner = discs.where(finite("x", "y", "radius")).join(centre, key, "left_semi")
    near = near_segments(inner.select(*key, "x", "y", "radius"), edges, widest, on=on, cell=max(cell, widest), spread=tuple(key)).where(F.col("distance") < F.col("radius"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.nullif(geom.segment_length(), F.lit(0.0))
    ux, uy = dx / size, dy / size
    middle = (F.col("x") - F.col("x1")) * ux + (F.col("y") - F.col("y1")) * uy
    off = (F.col("x") - F.col("x1")) * uy - (F.col("y") - F.col("y1")) * ux
    half = F.sqrt(F.greatest(F.lit(0.0), F.col("radius") * F.col("radius") - off * off))
    spans = near.withColumns({"_from": F.greatest(F.lit(0.0), middle - half), "_to": F.least(geom.segment_length(), middle + half)}).where(F.col("_to") - F.col("_from") > 2 * hair)
    spans = cut(spans.select(*key, "_edge", "x1", "y1", "_from", "_to", ux.alias("_ux"), uy.alias("_uy")), "spans")
    asked = edges.join(spans.select("_edge").distinct(), "_edge", "left_semi")
    # Places on an edge where another one crosses or ends.
    lhs = with_cells(asked, cell, F.lit(tiny))
    rhs = with_cells(edges.select(*on, F.col("x1").alias("cx1"), F.col("y1").alias("cy1"), F.col("x2").alias("cx2"), F.col("y2").alias("cy2"), F.col("_edge").alias("_other")), cell, F.lit(tiny), ("cx1", "cy1", "cx2", "cy2"))
    ex, ey = F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1")
    turn = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    ox, oy = F.col("cx1") - F.col("x1"), F.col("cy1") - F.col("y1")
    at = F.when(((ox * dy - oy * dx) / turn).between(-tiny, 1 + tiny), (ox * ey - oy * ex) / turn)
    ends = [
        F.when(F.abs(((F.col(x) - F.col("x1")) * dy - (F.col(y) - F.col("y1")) * dx) / size) <= hair, ((F.col(x) - F.col("x1")) * dx + (F.col(y) - F.col("y1")) * dy) / size / size)
        for x, y in (("cx1", "cy1"), ("cx2", "cy2"))]
    met = lhs.join(rhs, [*on, "_cx", "_cy"]).where("_edge <> _other").select("_edge", size.alias("_size"), F.explode(F.array(at, *ends)).alias("_part"))
    breaks = met.where("_part is not null").select("_edge", (F.col("_size") * F.col("_part")).alias("_at")).distinct()
    inside = spans.join(breaks, "_edge").where((F.col("_at") > F.col("_from")) & (F.col("_at") < F.col("_to"))).groupBy(*key, "_edge").agg(F.collect_set("_at").alias("_cuts"))  # crossings within one disc
    marks = F.array_sort(F.concat(F.array("_from", "_to"), F.coalesce("_cuts", F.array().cast("array<double>"))))
    pieces = F.arrays_zip(F.slice("_marks", F.lit(1), F.size("_marks") - 1).alias("p"), F.slice("_marks", F.lit(2), F.size("_marks") - 1).alias("q"))
    stretches = spans.join(inside, [*key, "_edge"], "left").withColumn("_marks", marks).withColumn("_z", F.explode(pieces)).where(F.col("_z.q") - F.col("_z.p") > 2 * hair)
    along = (F.col("_z.p") + F.col("_z.q")) / 2
    sides = stretches.withColumn("_side", F.explode(F.array(F.lit(hair), F.lit(-hair)))).select(
        *key, (F.col("x1") + F.col("_ux") * along - F.col("_uy") * F.col("_side")).alias("x"), (F.col("y1") + F.col("_uy") * along + F.col("_ux") * F.col("_side")).alias("y"))
    probes = cut(sides.withColumn("_probe", F.xxhash64("x", "y")), "probes")
    held = contained(probes.select(*on, "_probe", "x", "y").distinct(), rings, point_key=("_probe",), area_key=("feature_id",), on=on).select(*on, "_probe").distinct()
    open_ = probes.join(held, [*on, "_probe"], "left_anti").select(*key).distinct()
    return inner.select(*key).distinct().join(open_, key, "left_anti")


def foot(px="x", py="y", x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    """Closest point of a segment."""
    px, py, x1, y1, x2, y2 = (geom.col(c) for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    norm = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(norm == 0, 0.0).otherwise(((px - x1) * dx + (py - y1) * dy) / norm)))
    return x1 + t * dx, y1 + t * dy


def crossing_segments(lines: DataFrame, segments: DataFrame, *, key: Sequence[str], cell: float = 32.0) -> DataFrame:
    """Keys of lines (ax, ay, bx, by) that properly cross a segment of the same site."""
    lhs = with_cells(lines, cell, F.lit(0.0), ("ax", "ay", "bx", "by"))
    rhs = with_cells(segments.select("site_id", "x1", "y1", "x2", "y2"), cell, F.lit(0.0))
    hits = lhs.join(rhs, ["site_id", "_cx", "_cy"]).where(geom.segments_cross(("ax", "ay", "bx", "by"), ("x1", "y1", "x2", "y2")))
    return hits.select(*key).distinct()
