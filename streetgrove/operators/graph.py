"""Iterative set operators: connected components, the first independent set, thinning in tiles."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.functions import geom
from streetgrove.session import Growing, cut


def connected_components(nodes: DataFrame, edges: DataFrame, *, key: str = "id", max_rounds: int = 64) -> DataFrame:
    """(key, component): component is the smallest key reachable over ``edges(a, b)``.

    Each round every node takes the smallest label around it and then the label of its label
    (pointer jumping), so the number of rounds grows with the logarithm of the longest chain.
    Minima are combined before the shuffle; a hub therefore sends one row per task.
    """
    links = cut(
        edges.select("a", "b").where(F.col("a") != F.col("b"))
        .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = cut(nodes.select(F.col(key).alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(max_rounds):
        offered = (
            links.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        lowered = labels.join(offered, "id", "left").select(
            "id", "label", F.least("label", F.coalesce("near", "label")).alias("next")
        )
        # A root that heard of a smaller label hands it to its whole tree.
        roots = lowered.groupBy(F.col("label").alias("root")).agg(F.min("next").alias("best"))
        merged = lowered.join(roots, F.col("label") == F.col("root")).select(
            "id", F.col("label").alias("old"), F.least("next", "best").alias("mid")
        )
        jump = merged.select(F.col("id").alias("mid"), F.col("mid").alias("far"))
        stepped = cut(
            merged.join(jump, "mid", "left").select(
                "id", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"
            ),
            "labels",
        )
        changed = not stepped.where(F.col("label") != F.col("old")).isEmpty()
        labels = stepped.select("id", "label")
        if not changed:
            return labels.select(F.col("id").alias(key), F.col("label").alias("component"))
    raise RuntimeError("components did not settle; raise max_rounds")


def first_independent_set(
    nodes: DataFrame, edges: DataFrame, *, key: str = "id", order: Sequence[str] = ("rank",), max_rounds: int = 10_000,
) -> DataFrame:
    """Keys kept by going through ``nodes`` in ``order`` and skipping neighbours of kept ones.

    Each round keeps every undecided node that precedes all its undecided neighbours and drops
    the neighbours, which gives the sequential answer exactly. ``order`` must be unique.
    """
    rank = F.struct(*[F.col(c) for c in order])
    ranked = nodes.select(F.col(key).alias("id"), rank.alias("rank"))
    live = cut(
        edges.select("a", "b").where(F.col("a") != F.col("b"))
        .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        .join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a")
        .join(ranked.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b"),
        "conflicts",
    )
    dropped = Growing("losers")
    for _ in range(max_rounds):
        winners = live.groupBy("a").agg(F.min("rb").alias("m"), F.first("ra").alias("ra")).where(F.col("ra") < F.col("m"))
        gone = dropped.add(live.join(winners.select(F.col("a").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct())
        live = cut(
            live.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"),
            "conflicts",
        )
        if live.isEmpty():
            break
    else:
        raise RuntimeError("independent set did not settle; raise max_rounds")
    return nodes.select(key).join(dropped.all().select(F.col("id").alias(key)), key, "left_anti")


TILE_POINTS = 50_000  # undecided points of a tile that one task walks through
TILE_LEVELS = 24

KEPT, OPEN = "kept", "open"


def tile_size(points: DataFrame, least: float, *, on: Sequence[str], most: int) -> float | None:
    """Side of the widest tiles, least times a power of two, none of which holds more than ``most`` points; None if the least do.

    Points are counted once by the least tiles; wider ones are sums of those counts.
    """
    fine = points.groupBy(*on, geom.cell_of("x", least).alias("_tx"), geom.cell_of("y", least).alias("_ty")).agg(F.count(F.lit(1)).alias("_n"))
    levels = fine.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(TILE_LEVELS))))
    tile = [F.expr(f"shiftright({c}, _level)").alias(c) for c in ("_tx", "_ty")]
    held = levels.groupBy(*on, "_level", *tile).agg(F.sum("_n").alias("_n")).groupBy("_level").agg(F.max("_n").alias("n")).collect()  # a row a level
    fit = [r["_level"] for r in held if r["n"] <= most]
    return least * 2.0 ** max(fit) if fit else None


def _walk_tile(rows: pd.DataFrame, *, gap: float, order: Sequence[str], group: str | None, out: Sequence[str]) -> pd.DataFrame:
    """State of the points of one tile, taken in order: kept, open while that hangs on a point whose state is not known here, or dropped."""
    rows = rows.sort_values(list(order), na_position="first", kind="stable")
    kept: dict[tuple[int, int], list[tuple[float, float]]] = {}
    waiting: dict[tuple[int, int], list[tuple[float, float]]] = {}

    def enter(cells: dict, x: float, y: float) -> None:
        cx, cy = math.floor(x / gap), math.floor(y / gap)
        for i in (cx - 1, cx, cx + 1):
            for j in (cy - 1, cy, cy + 1):
                cells.setdefault((i, j), []).append((x, y))

    def beside(cells: dict, x: float, y: float) -> bool:
        for a, b in cells.get((math.floor(x / gap), math.floor(y / gap)), ()):
            if math.sqrt((x - a) * (x - a) + (y - b) * (y - b)) < gap:
                return True
        return False

    xs, ys, own, state = rows["x"].tolist(), rows["y"].tolist(), rows["_own"].tolist(), rows["_state"].tolist()
    members: Iterable = rows[group].tolist() if group else [None] * len(rows)
    ahead = rows["_ahead"].tolist()
    for x, y, s in zip(xs, ys, state, strict=True):
        if s == KEPT:
            enter(kept, x, y)
    taken, refused, states = set(), Counter(), []
    for x, y, mine, s, g, before in zip(xs, ys, own, state, members, ahead, strict=True):
        if s == KEPT:
            states.append(None)
        elif beside(kept, x, y) or (group and g in taken):
            refused[g] += 1
            states.append(None)
        elif not mine or beside(waiting, x, y) or (group and refused[g] < before):
            enter(waiting, x, y)
            states.append(OPEN)
        else:
            enter(kept, x, y)
            taken.add(g)
            states.append(KEPT)
    rows["_state"] = states
    return rows.loc[rows["_own"] & rows["_state"].notna(), list(out)]


def _walker(**options) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def decide(tile: pd.DataFrame) -> pd.DataFrame:
        return _walk_tile(tile, **options)

    return decide


def first_spaced_points(
    points: DataFrame, gap: float, *, key: str = "point_id", order: Sequence[str] = ("point_id",),
    on: Sequence[str] = ("site_id",), group: str | None = None, tile_points: int = TILE_POINTS, seen: Callable[[float], None] | None = None,
) -> DataFrame:
    """Sequential thinning to ``gap``: points in ``order``, each kept unless it is nearer than the gap to a kept one.

    Tiles are decided each in one go, in order, together with a strip of the gap's width around them. Inside the strip, and
    where a point hangs on an undecided one, the state stays open for the next round. Tiles are as wide as their undecided
    points allow (``tile_points``), so they widen from round to round: what hangs together over a whole tile is settled
    at once, and a chain of dependent points costs a round for every ``tile_points`` of them. Where even tiles of a few
    gaps hold more points than that, cells send leaders instead, whatever their number. With ``group`` (options of one
    station) at most one point of a group is kept. A point without finite coordinates is not kept. Equals the sequential pass.
    """
    on, names = list(on), [f"_o{k}" for k in range(len(order))]
    extra = [group] if group else []
    finite = F.coalesce(F.abs("x") + F.abs("y") < float("inf"), F.lit(False))
    columns = [*on, key, "x", "y", *extra, *names]
    left = cut(points.where(finite).select(*on, key, "x", "y", *extra, *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)]), "undecided")
    kept = Growing("kept")
    fresh = None
    while True:
        side = tile_size(left, 4.0 * gap, on=on, most=tile_points)
        if seen is not None:
            seen(side or 0.0)
        if side is None:
            if fresh is not None:
                left = cut(_less_struck(left, fresh, gap, key=key, on=on, extra=extra), "undecided")
            kept.add(_spaced_by_leaders(left, gap, key=key, order=names, on=on, group=group).select(*on, key))
            break
        rows = left.withColumn("_state", F.lit(None).cast("string"))
        if group:
            if fresh is not None:
                rows = rows.join(fresh.select(*on, group).distinct(), [*on, group], "left_anti")
            rows = rows.withColumn("_ahead", F.row_number().over(Window.partitionBy(*on, group).orderBy(*names)) - 1)
        else:
            rows = rows.withColumn("_ahead", F.lit(0))
        if fresh is not None:
            rows = rows.unionByName(fresh.select(*columns).withColumns({"_state": F.lit(KEPT), "_ahead": F.lit(0)}))
        spread = rows.withColumn("_tx", F.explode(geom.cell_range(F.col("x") - gap, F.col("x") + gap, side)))
        spread = spread.withColumn("_ty", F.explode(geom.cell_range(F.col("y") - gap, F.col("y") + gap, side)))
        spread = spread.withColumn("_own", (F.col("_tx") == geom.cell_of("x", side)) & (F.col("_ty") == geom.cell_of("y", side)))
        schema = ", ".join(f"`{c}` {spread.schema[c].dataType.simpleString()}" for c in [*columns, "_state"])

        decide = _walker(gap=gap, order=names, group=group, out=[*columns, "_state"])
        decided = cut(spread.groupBy(*on, "_tx", "_ty").applyInPandas(decide, schema), "tiles")
        fresh = decided.where(F.col("_state") == KEPT).select(*columns)
        kept.add(fresh.select(*on, key))
        left = decided.where(F.col("_state") == OPEN).select(*columns)
        if left.isEmpty():
            break
    return kept.all().select(*on, key)


def _around(rows: DataFrame, key: str, on: Sequence[str]) -> DataFrame:
    """Rows (cx, cy, x, y, rank) repeated into the cells two steps around as (kx, ky, krank)."""
    steps = F.sequence(F.lit(-2), F.lit(2))  # cells of half a gap: nothing nearer than the gap lies further
    return rows.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(
        *on, F.col(key).alias("lead"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"),
        F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("rank").alias("krank"))


def _less_struck(left: DataFrame, kept: DataFrame, gap: float, *, key: str, on: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """``left`` without the points nearer than the gap to one of ``kept`` or in its group."""
    half = gap / 2.0
    cells = {"cx": geom.cell_of("x", half), "cy": geom.cell_of("y", half)}
    met = left.withColumns(cells).join(_around(kept.withColumns(cells).withColumn("rank", F.lit(0)), key, on), [*on, "cx", "cy"])
    near = met.where(geom.point_distance("x", "y", "kx", "ky") < gap).select(*on, key).distinct()
    rest = left.join(near, [*on, key], "left_anti")
    return rest.join(kept.select(*on, *extra).distinct(), [*on, *extra], "left_anti") if extra else rest


def _spaced_by_leaders(left: DataFrame, gap: float, *, key: str, order: Sequence[str], on: Sequence[str], group: str | None) -> DataFrame:
    """Thinning of any density, a cell at a time, without listing the pairs nearer than the gap.

    Two points of one cell of side gap/2 always conflict (its diagonal is shorter than the gap),
    so only the first undecided point of a cell can be kept in a round. A round reduces the points
    to one leader per cell (combined before the shuffle), keeps the leaders that no earlier
    undecided point within the gap precedes, and drops the points nearer than the gap to a kept
    one. A point meets at most the 25 leaders around it, however dense a place is. Rounds follow
    the longest chain of dependent points.
    """
    size = gap / 2.0
    extra = [group] if group else []
    rank = F.struct(*[F.col(c) for c in order])
    left = cut(
        left.select(*on, key, "x", "y", *extra, rank.alias("rank")).withColumn("cx", geom.cell_of("x", size)).withColumn("cy", geom.cell_of("y", size)),
        "undecided",
    )
    kept = Growing("kept")
    while True:
        first_of_cell = left.groupBy(*on, "cx", "cy").agg(F.min(F.struct("rank", key, "x", "y", *extra)).alias("m"))
        leaders = first_of_cell.select(*on, "cx", "cy", "m.*")
        near = (geom.point_distance("x", "y", "kx", "ky") < gap) & (F.col("rank") < F.col("krank"))
        beaten = left.join(_around(leaders, key, on), [*on, "cx", "cy"]).where(near).select(*on, F.col("lead").alias(key)).distinct()
        picked = leaders.join(beaten, [*on, key], "left_anti")
        if group:
            first = left.groupBy(*on, group).agg(F.min("rank").alias("_first"))
            picked = picked.join(first, [*on, group]).where(F.col("rank") == F.col("_first")).drop("_first")  # first of its station
        picked = kept.add(picked)
        left = cut(_less_struck(left.drop("cx", "cy"), picked.select(*on, key, "x", "y", *extra), gap, key=key, on=on, extra=extra).withColumns(
            {"cx": geom.cell_of("x", size), "cy": geom.cell_of("y", size)}), "undecided")
        if left.isEmpty():
            return kept.all().select(*on, key)
