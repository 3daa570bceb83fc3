"""Nearest object of every class, tile by tile: points and segments meet once, a tile is searched by arrays."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetgrove.functions import geom
from streetgrove.operators import spatial
from streetgrove.session import cut

TILE_POINTS = 4096  # points that a tile is meant to hold
TILE_SEGMENTS = 50_000.0
HOT_POINTS = 50_000  # points of a tile that one group is trusted with
SURE_NEAR = 16.0  # objects of a class that the search in a tile is meant to meet at its widest
PAIRS = 1 << 18  # pairs that are measured together
CELLS = 256  # columns and rows that a tile is divided into at most
HAIR = 1e-6


def densities(points: DataFrame, segments: DataFrame, kind: str = "object_class") -> tuple[int, float, dict[str, tuple[float, float]]]:
    """(points, ground in m2 that they stand on, class -> metres and number of its segments). They choose how far and in what order is searched, never what is found."""
    blocks = points.groupBy("site_id", geom.cell_of("x", spatial.BLOCK_M).alias("cx"), geom.cell_of("y", spatial.BLOCK_M).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    ground = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).first()
    classes = segments.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(geom.segment_length()).alias("m")).where(F.col(kind).isNotNull()).collect()  # a closed list
    return ground["n"] or 0, (ground["blocks"] or 0) * spatial.BLOCK_M * spatial.BLOCK_M, {r[kind]: (r["m"], r["n"]) for r in classes}


def radius_of(metres: float, number: float, area: float, objects: float) -> float:
    """How far a point looks till it meets that many objects, were they spread evenly."""
    line, spot = 2 * metres / area, math.pi * number / area
    return max(2 * objects / (line + math.sqrt(line * line + 4 * objects * spot)), 1e-3)


def tile_edge(n: int, area: float, held: Mapping[str, tuple[float, float]], reach: float) -> float:
    """Edge of tiles that hold about ``TILE_POINTS`` points and not many more than ``TILE_SEGMENTS`` segments."""
    wanted = min(max(n / 128, 256.0), float(TILE_POINTS))
    metres, number = (sum(v[i] for v in held.values()) / area for i in (0, 1))
    most = 2 * TILE_SEGMENTS / (metres + math.sqrt(metres * metres + 4 * TILE_SEGMENTS * number))
    return max(min(math.sqrt(wanted * area / n), most), reach / 4, 1.0)


def _entries(x1, y1, x2, y2, pad, ox: float, oy: float, edge: float, nx: int, ny: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, segment) for the cells of a grid that can hold a point within ``pad`` of a segment, as ``spatial.with_cells``."""
    def low(v, o, most):
        return np.clip(np.floor((v - o) / edge), 0, most).astype(np.int64)

    first, last = low(np.minimum(x1, x2) - pad, ox, nx), np.clip(np.floor((np.maximum(x1, x2) + pad - ox) / edge), -1, nx - 1).astype(np.int64)
    width = np.maximum(last - first + 1, 0)
    seg = np.repeat(np.arange(len(x1)), width)
    column = np.arange(len(seg)) - np.repeat(np.cumsum(width) - width, width) + first[seg]
    x, y, dx, dy, p = x1[seg], y1[seg], (x2 - x1)[seg], (y2 - y1)[seg], pad[seg]
    slope = np.where(dx == 0, 1.0, dx)
    ta = np.where(dx == 0, 0.0, np.clip((ox + column * edge - p - x) / slope, 0.0, 1.0))
    tb = np.where(dx == 0, 1.0, np.clip((ox + (column + 1) * edge + p - x) / slope, 0.0, 1.0))
    ya, yb = y + ta * dy, y + tb * dy
    bottom, top = low(np.minimum(ya, yb) - p, oy, ny), np.clip(np.floor((np.maximum(ya, yb) + p - oy) / edge), -1, ny - 1).astype(np.int64)
    height = np.maximum(top - bottom + 1, 0)
    at = np.repeat(np.arange(len(seg)), height)
    row = np.arange(len(at)) - np.repeat(np.cumsum(height) - height, height) + bottom[at]
    return column[at] * ny + row, seg[at]


def _ring(px, py, ends, err, half, radius: float) -> tuple[np.ndarray, ...]:
    """(axis, its segment, wall, its segment) of every point among segments not farther than radius + err + half; infinity where none is."""
    x1, y1, x2, y2 = ends
    n, limit = len(px), radius + err + half
    axis, wall = np.full(n, np.inf), np.full(n, np.inf)
    axis_at, wall_at = np.full(n, -1), np.full(n, -1)
    ox, oy = px.min(), py.min()
    edge = max(2 * radius, (max(px.max() - ox, py.max() - oy) + HAIR) / (CELLS - 1))
    cx, cy = np.floor((px - ox) / edge).astype(np.int64), np.floor((py - oy) / edge).astype(np.int64)
    nx, ny = int(cx.max()) + 1, int(cy.max()) + 1
    cell, seg = _entries(x1, y1, x2, y2, limit + HAIR, ox, oy, edge, nx, ny)
    seg = seg[np.argsort(cell.astype(np.uint16) if nx * ny <= 1 << 16 else cell, kind="stable")]
    count = np.bincount(cell, minlength=nx * ny)
    begin = np.cumsum(count) - count
    own = cx * ny + cy
    asked = np.flatnonzero(count[own])
    upto = np.cumsum(count[own[asked]])
    start = 0
    while start < len(asked):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        who = asked[start:stop]
        k = count[own[who]]
        offset = np.cumsum(k) - k
        s = seg[np.arange(int(k.sum())) + np.repeat(begin[own[who]] - offset, k)]
        qx, qy, ax, ay = np.repeat(px[who], k), np.repeat(py[who], k), x1[s], y1[s]
        dx, dy = x2[s] - ax, y2[s] - ay
        norm = dx * dx + dy * dy
        along = np.where(norm == 0, 0.0, ((qx - ax) * dx + (qy - ay) * dy) / np.where(norm == 0, 1.0, norm))
        t = np.maximum(0.0, np.minimum(1.0, along))
        fx, fy = qx - (ax + t * dx), qy - (ay + t * dy)
        distance = np.sqrt(fx * fx + fy * fy)
        far = ~(distance <= limit[s])
        to_axis = distance - err[s]
        for values, best, at in ((to_axis, axis, axis_at), (to_axis - half[s], wall, wall_at)):
            values = np.maximum(0.0, values)
            values[far] = np.inf
            least = np.minimum.reduceat(values, offset)
            best[who] = least
            at[who] = np.minimum.reduceat(np.where(values == np.repeat(least, k), s, len(x1)), offset)  # segments stand in the order of their ids
        start = stop
    return axis, axis_at, wall, wall_at


def _search(px, py, ends, err, half, first: float, limit: float) -> tuple[np.ndarray, ...]:
    """As ``_ring`` at ``limit``, by rings that widen for points without an answer; an answer inside a ring is final."""
    found = np.full(len(px), np.inf), np.full(len(px), -1), np.full(len(px), np.inf), np.full(len(px), -1)
    todo, radius = np.arange(len(px)), min(first, limit)
    while len(todo) and len(err):
        ring = _ring(px[todo], py[todo], ends, err, half, radius)
        done = np.ones(len(todo), bool) if radius >= limit else ring[0] <= radius - HAIR
        for whole, part in zip(found, ring, strict=True):
            whole[todo[done]] = part[done]
        todo, radius = todo[~done], min(radius * 2.5, limit) if radius < limit else limit
    return found


def nearest(
    points: DataFrame, segments: DataFrame, kinds: Sequence[str], first: Mapping[str, float], limit: Mapping[str, float], edge: float, *, all_rows: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(site_id, point_id, x, y, carry..., kind, axis, axis_id, wall, wall_id): the least clearances of every point and class, ties to the lowest id.

    Only segments not farther than ``limit`` of their class plus their ``_err`` and ``_half`` count. ``kind`` is the place of
    the class in ``kinds``. A row of ``points`` gives one row for each class found, or with ``all_rows`` for each class of its site.
    Both sides meet once in tiles; a tile of very many points is dealt to several groups.
    """
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("object_class")).cast("int") - 1
    own_columns = ["site_id", "point_id", "x", "y", *carry]
    lhs = points.select(*own_columns).where(F.col("site_id").isNotNull()).withColumns({"_cx": geom.cell_of("x", edge), "_cy": geom.cell_of("y", edge)})
    reach = F.create_map(*[v for k in kinds for v in (F.lit(k), F.lit(float(limit[k])))])[F.col("object_class")] + F.col("_err") + F.col("_half")
    rhs = segments.where(F.col("object_class").isin(*kinds)).select("site_id", "feature_id", place.alias("kind"), "x1", "y1", "x2", "y2", "_err", "_half", reach.alias("_reach"))
    rhs = spatial.with_cells(rhs, edge, F.col("_reach")).drop("_reach")
    keys = ["site_id", "_cx", "_cy"]
    tiles = cut(lhs.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / HOT_POINTS).cast("int").alias("_salts")), "tiles")
    hot = not tiles.where("_salts > 1").isEmpty()
    if hot:
        lhs = lhs.join(tiles.where("_salts > 1"), keys, "left").withColumn("_salt", F.pmod(F.xxhash64("point_id", "x", "y"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
        rhs = rhs.join(tiles, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
        keys.append("_salt")
    else:
        rhs = rhs.join(tiles.drop("_salts"), keys, "left_semi")
    if all_rows:
        known = segments.where(F.col("object_class").isin(*kinds)).groupBy("site_id").agg(F.array_sort(F.collect_set(place)).alias("_known"))  # a closed list
        lhs = lhs.join(known, "site_id")
    types = points.schema
    schema = T.StructType([
        T.StructField("site_id", types["site_id"].dataType), T.StructField("point_id", types["point_id"].dataType), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
        *[types[c] for c in carry], T.StructField("kind", T.IntegerType()), T.StructField("axis", T.DoubleType()), T.StructField("axis_id", segments.schema["feature_id"].dataType),
        T.StructField("wall", T.DoubleType()), T.StructField("wall_id", segments.schema["feature_id"].dataType)])
    starts, ends_at = [first[k] for k in kinds], [limit[k] for k in kinds]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("kind", "ascending"), ("feature_id", "ascending")], null_placement="at_start"))
        kind = right["kind"].to_numpy()
        px, py = left["x"].to_numpy(), left["y"].to_numpy()
        columns = [right[c].to_numpy() for c in ("x1", "y1", "x2", "y2", "_err", "_half")]
        who, cls, values, at = [], [], ([], []), ([], [])
        for c in (left["_known"][0].as_py() if all_rows and left.num_rows else np.unique(kind).tolist()):
            a, b = np.searchsorted(kind, [c, c + 1])
            own = [v[a:b] for v in columns]
            axis, axis_at, wall, wall_at = _search(px, py, own[:4], own[4], own[5], starts[c], ends_at[c])
            keep = np.arange(len(px)) if all_rows else np.flatnonzero(axis < np.inf)
            who.append(keep)
            cls.append(np.full(len(keep), c, np.int32))
            for out, best, places, found in ((0, axis, axis_at, axis), (1, wall, wall_at, axis)):
                values[out].append(best[keep])
                at[out].append(np.where(found[keep] < np.inf, places[keep] + a, -1))
        joined = lambda parts, dtype: np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype)
        rows, (axis, wall), (axis_at, wall_at) = joined(who, np.int64), [joined(v, np.float64) for v in values], [joined(v, np.int64) for v in at]
        known_ids = [pa.array(np.maximum(v, 0), mask=v < 0) for v in (axis_at, wall_at)]
        own = left.select(own_columns).take(pa.array(rows))
        out = [*own.columns, pa.array(joined(cls, np.int32))]
        for best, ids in ((axis, known_ids[0]), (wall, known_ids[1])):
            out += [pa.array(best, mask=~(best < np.inf)), right["feature_id"].take(ids)]
        return pa.table(out, names=schema.fieldNames())

    return lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInArrow(run, schema)


def within(points: DataFrame, segments: DataFrame, reach: Mapping[str, float], *, carry: Sequence[str] = ()) -> DataFrame:
    """(site_id, point_id, x, y, carry..., object_class, axis_m, wall_m): of each row of ``points`` the least clearances of every class.

    Only segments not farther than the ``reach`` of their class plus ``error_m`` and half of ``diameter_m`` count; one without
    finite ends or error counts nowhere. A class with none so near has no row.
    """
    segments = segments.where(F.col("object_class").isin(*reach) & spatial.finite("x1", "y1", "x2", "y2", "error_m")).select(
        "site_id", "feature_id", "object_class", "x1", "y1", "x2", "y2", F.col("error_m").alias("_err"), (F.coalesce("diameter_m", F.lit(0.0)) / 2).alias("_half"))
    todo = points.where(spatial.finite("x", "y"))
    n, area, held = densities(todo, segments)
    kinds = sorted(held) if n else []
    if not kinds:
        return todo.where(F.lit(False)).select("site_id", "point_id", "x", "y", *carry, F.lit("").alias("object_class"), F.lit(0.0).alias("axis_m"), F.lit(0.0).alias("wall_m"))
    first = {c: radius_of(*held[c], area, spatial.FEW_NEAR) for c in kinds}
    widest = {c: float(reach[c]) for c in kinds}
    rows = nearest(todo, segments, kinds, first, widest, tile_edge(n, area, held, max(widest.values())), carry=carry)
    name = F.array(*[F.lit(c) for c in kinds])
    return rows.select("site_id", "point_id", "x", "y", *carry, name[F.col("kind")].alias("object_class"), F.col("axis").alias("axis_m"), F.col("wall").alias("wall_m"))
