"""Pieces of linework put in order: lists ranked by pointer doubling, rings, and the axis of a street."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetgrove.functions import geom
from streetgrove.operators import scan
from streetgrove.session import cut

AXIS_CELL_M = 25.0  # kerbs of both sides of a street fall together
STRAIGHT = 1e-9  # radians; a smaller bend is none
AXIS_CELLS = 4096  # cells of a site that its axis is found among


def _doubled(state: DataFrame, carry: dict[str, Callable], changed) -> DataFrame:
    """``state(arc, hop, ...)`` jumped over its own hops until nothing changes: each round a hop covers twice as many arcs.

    ``carry`` says how a column is put together with that of the arc jumped to; ``changed`` is true for rows that still move.
    """
    state = cut(state, "hops")
    while True:
        far = state.select(F.col("arc").alias("hop"), F.col("hop").alias("_hop"), *[F.col(c).alias("_" + c) for c in carry])
        stepped = cut(
            state.join(far, "hop", "left").select(
                "arc", F.col("_hop").alias("hop"), F.col("hop").alias("_was"), *[F.when(F.col("hop").isNull(), F.col(c)).otherwise(join(F.col(c), F.col("_" + c))).alias(c) for c, join in carry.items()],
                *[F.col(c).alias("_old_" + c) for c in carry]),
            "hops",
        )
        state = stepped.select("arc", "hop", *carry)
        if stepped.where(changed).isEmpty():
            return state


def rank_lists(arcs: DataFrame) -> DataFrame:
    """(arc, ring, head, steps, length_m) for ``arcs(arc, hop, length_m)``, ``hop`` the next arc or null.

    In an open list ``head`` is its last arc; a ring is opened before its smallest arc, which then comes first. ``steps``
    and ``length_m`` are what lies between an arc and the end of its list, itself included. Rounds grow with the logarithm
    of the longest list, whatever the number of lists.
    """
    arcs = cut(arcs.select("arc", "hop", "length_m"), "arcs")
    least = _doubled(
        arcs.select("arc", "hop", F.col("arc").alias("low")), {"low": F.least},
        (F.col("low") != F.col("_old_low")) | (F.col("_was").isNotNull() & F.col("hop").isNull()),
    )
    rings = least.where("hop is not null").select("arc", F.col("low").alias("root"))
    opened = arcs.join(rings, "arc", "left").withColumn("hop", F.when(F.col("root").isNotNull() & (F.col("hop") == F.col("root")), F.lit(None)).otherwise(F.col("hop")))
    ranked = _doubled(
        opened.select("arc", "hop", F.col("arc").alias("head"), F.lit(1).cast("long").alias("steps"), "length_m"),
        {"head": lambda own, far: far, "steps": lambda own, far: own + far, "length_m": lambda own, far: own + far}, F.col("_was").isNotNull(),
    )
    return ranked.join(rings, "arc", "left").select("arc", F.col("root").isNotNull().alias("ring"), "head", "steps", "length_m")


def lines_of_pieces(pieces: DataFrame, *, on: Sequence[str] = ("site_id",), digits: int = 3) -> DataFrame:
    """Straight pieces, in any order and direction, put together to lines where exactly two ends meet.

    ``pieces(on..., piece_id, x1, y1, x2, y2)`` with unique ids. Returns one row a piece: (on..., line, closed, place, piece_id,
    x1, y1, x2, y2) with the ends turned along the line; ``line`` is the smallest piece id of a ring, the smaller of its end
    pieces' ids of an open line. Ends meet to ``digits`` decimals. Pieces without finite ends or of no length are left out.
    """
    on, scale = list(on), 10.0**digits
    whole = F.coalesce(F.abs("x1") + F.abs("y1") + F.abs("x2") + F.abs("y2") < float("inf"), F.lit(False))
    rows = cut(pieces.where(whole & (geom.segment_length() > 0)).select(*on, "piece_id", "x1", "y1", "x2", "y2"), "pieces")
    node = lambda x, y: F.struct(F.round(F.col(x) * scale).cast("long").alias("x"), F.round(F.col(y) * scale).cast("long").alias("y"))
    turned = rows.select(
        *on, (F.col("piece_id") * 2 + 1).alias("arc"), "piece_id", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    arcs = rows.select(*on, (F.col("piece_id") * 2).alias("arc"), "piece_id", "x1", "y1", "x2", "y2").unionByName(turned)
    arcs = cut(arcs.select("*", node("x1", "y1").alias("tail"), node("x2", "y2").alias("tip"), geom.segment_length().alias("length_m")), "arcs")
    meets = arcs.groupBy(*on, F.col("tail").alias("tip")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")  # an arc starts at every end
    onward = arcs.join(meets, [*on, "tip"], "left_semi").select(*on, "arc", "tip").join(arcs.select(*on, F.col("tail").alias("tip"), F.col("arc").alias("hop")), [*on, "tip"])
    onward = onward.where(F.col("hop") != F.col("arc").bitwiseXOR(F.lit(1))).select("arc", "hop")
    ranked = rank_lists(arcs.select("arc", "length_m").join(onward, "arc", "left"))
    lists = ranked.groupBy("head").agg(F.max(F.struct("steps", "arc")).alias("first"), F.min("arc").alias("low"), F.max("ring").alias("ring"))
    # Every line comes in both directions; one of them is kept.
    start, end = F.shiftright(F.col("first.arc"), 1), F.shiftright(F.col("head"), 1)
    keep = F.when(F.col("ring"), F.col("low") % 2 == 0).when(start == end, F.col("first.arc") % 2 == 0).otherwise(start < end)
    named = lists.where(keep).select("head", F.when(F.col("ring"), F.shiftright("low", 1)).otherwise(start).alias("line"), F.col("first.steps").alias("_all"))
    placed = ranked.join(named, "head").select("arc", "line", F.col("ring").alias("closed"), (F.col("_all") - F.col("steps")).alias("place"))
    return arcs.join(placed, "arc").select(*on, "line", "closed", "place", "piece_id", "x1", "y1", "x2", "y2")


def closed_areas(lines: DataFrame, errors: DataFrame, bridgeable: Callable, *, on: Sequence[str] = ("site_id",)) -> DataFrame:
    """(on..., line, pieces, gap_m, closed, length_m, area_m2): areas within lines, shrunk by the error of their pieces.

    ``lines`` as from ``lines_of_pieces``; an open line of two pieces or more is closed by a chord where ``bridgeable(gap, length)``.
    ``errors(line, error_m)`` gives the width that the area gives up all around: its length times that width, less what the
    strips share at corners turned inwards, more the sectors at corners turned outwards. Where an edge is used up by that
    the area counts as nothing, which is never too much. An area runs to the left of its line, whichever way that was drawn.
    """
    on = list(on)
    key = [*on, "line"]
    ends = lines.groupBy(*key).agg(
        F.max("closed").alias("ring"), F.count(F.lit(1)).alias("pieces"), F.sum(geom.segment_length()).alias("length_m"),
        F.min_by(F.struct("x1", "y1"), "place").alias("a"), F.max_by(F.struct("x2", "y2"), "place").alias("b"))
    gap = F.when(F.col("ring"), 0.0).otherwise(geom.hypot2(F.col("a.x1") - F.col("b.x2"), F.col("a.y1") - F.col("b.y2")))
    ends = cut(ends.withColumn("gap_m", gap).withColumn("closed", F.col("ring") | ((F.col("pieces") >= 2) & bridgeable(F.col("gap_m"), F.col("length_m")))), "line-ends")
    chords = ends.where("closed and gap_m > 0").select(*key, F.col("pieces").alias("place"), F.col("b.x2").alias("x1"), F.col("b.y2").alias("y1"), F.col("a.x1").alias("x2"), F.col("a.y1").alias("y2"))
    sides = lines.select(*key, "place", "x1", "y1", "x2", "y2").unionByName(chords)
    sides = sides.join(ends.where("closed").select(*key, (F.col("pieces") + (F.col("gap_m") > 0).cast("int")).alias("_n")), key)
    after = sides.select(*key, F.pmod(F.col("place") - 1, F.col("_n")).alias("place"), (F.col("x2") - F.col("x1")).alias("_dx"), (F.col("y2") - F.col("y1")).alias("_dy"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.atan2(dx * F.col("_dy") - dy * F.col("_dx"), dx * F.col("_dx") + dy * F.col("_dy"))
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    met = cut(sides.join(after, [*key, "place"]).select(*key, "place", "_n", turn.alias("_turn"), cross.alias("_cross"), geom.segment_length().alias("_len")), "sides")
    way = met.groupBy(*key).agg((F.sum("_cross") / 2).alias("_signed"), F.sum("_len").alias("_round"))
    before = met.select(*key, F.pmod(F.col("place") + 1, F.col("_n")).alias("place"), F.col("_turn").alias("_turned"))
    left_of = F.when(F.col("_signed") < 0, -1.0).otherwise(1.0)
    whole = met.join(before, [*key, "place"]).join(way, key).join(errors, "line", "left").select(
        *key, "place", "_signed", "_round", "_len", F.coalesce("error_m", F.lit(0.0)).alias("_width"), (left_of * F.col("_turn")).alias("_turn"), (left_of * F.col("_turned")).alias("_turned"))
    # Sides that run straight on are one edge; the one across the start is numbered 0 at both ends.
    bend = (F.abs("_turned") > STRAIGHT).cast("int")
    corners = whole.groupBy(*key).agg(F.sum(bend).alias("_all"))
    numbered = scan.prefix_sum(whole, bend, by=key, order=("place",), name="_nth").join(corners, key)
    edges = numbered.groupBy(*key, F.pmod("_nth", F.greatest("_all", F.lit(1))).alias("_edge"), "_signed", "_round").agg(
        F.sum("_len").alias("_len"), F.max("_width").alias("_width"), F.sum("_turned").alias("_turned"), F.sum("_turn").alias("_turn"))
    inward = lambda c: F.when(F.col(c) > 0, F.tan(F.col(c) / 2)).otherwise(0.0)
    corner = F.when(F.col("_turn") > 0, F.tan(F.col("_turn") / 2)).otherwise(F.col("_turn") / 2)
    edges = cut(edges.withColumns({"_left": F.col("_len") - F.col("_width") * (inward("_turn") + inward("_turned")), "_corner": corner}), "edges")
    shrunk = edges.groupBy(*key).agg(
        F.abs(F.first("_signed")).alias("_area"), F.first("_round").alias("_round"), F.sum("_corner").alias("_corners"), F.min("_left").alias("_least"), F.max("_width").alias("_width"))
    area = F.when((F.col("_width") > 0) & (F.col("_least") <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_area") - F.col("_round") * F.col("_width") + F.col("_corners") * F.col("_width") * F.col("_width")))
    return ends.join(shrunk.select(*key, area.alias("area_m2")), key, "left").select(*key, "pieces", "gap_m", "closed", "length_m", "area_m2")


def _tree_length(cells: pd.DataFrame) -> float:
    """Longest way in a breadth-first tree of the 8-connected cells, summed over the parts of a street, by two sweeps a part."""
    place = {(r, c): (x, y) for r, c, x, y in cells[["row", "col", "x", "y"]].itertuples(index=False)}
    seen: set[tuple[int, int]] = set()
    total = 0.0
    for root in sorted(place):
        if root in seen:
            continue
        seen.add(root)
        links: dict[tuple[int, int], list[tuple[tuple[int, int], float]]] = {root: []}
        level = [root]
        while level:
            below = set()
            for r, c in level:
                below |= {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (r + i, c + j) in place} - seen
            held = set(level)
            for r, c in sorted(below):
                parent = min((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (r + i, c + j) in held)
                (x, y), (a, b) = place[r, c], place[parent]
                step = math.sqrt((x - a) * (x - a) + (y - b) * (y - b))
                links[parent].append(((r, c), step))
                links[r, c] = [(parent, step)]
            seen |= below
            level = sorted(below)

        def farthest(start, links=links):
            best, stack = (0.0, start), [(start, None, 0.0)]
            while stack:
                at, came, way = stack.pop()
                if way > best[0] or (way == best[0] and at < best[1]):
                    best = (way, at)
                stack += [(to, at, way + step) for to, step in links[at] if to != came]
            return best

        total += farthest(farthest(root)[1])[0]
    return total


def axis_lengths(pieces: DataFrame, *, cell: float = AXIS_CELL_M, most: int = AXIS_CELLS, on: Sequence[str] = ("site_id",)) -> DataFrame:
    """(on..., cell_m, length_m): length of the axis of every street from the middles (x, y) of its kerb pieces.

    Middles fall into cells, whose mean places are the nodes of a tree; the longest way in it is the axis of a connected
    part. The cells of a street are widened twofold until there are no more than ``most``, so that the group that one task
    sweeps is bounded however long a street is; pieces are combined by cells before they travel.
    """
    on = list(on)
    fine = pieces.groupBy(*on, geom.cell_of("y", cell).alias("row"), geom.cell_of("x", cell).alias("col")).agg(F.sum("x").alias("_x"), F.sum("y").alias("_y"), F.count(F.lit(1)).alias("_n"))
    fine = cut(fine, "axis")
    level = fine.select(*on).distinct().withColumn("_level", F.lit(0))
    while True:
        cells = fine.join(level, on).groupBy(*on, "_level", F.expr("shiftright(row, _level)").alias("row"), F.expr("shiftright(col, _level)").alias("col")).agg(
            (F.sum("_x") / F.sum("_n")).alias("x"), (F.sum("_y") / F.sum("_n")).alias("y"))
        counted = cut(cells.groupBy(*on, "_level").agg(F.count(F.lit(1)).alias("_cells")), "axis-level")
        if counted.where(F.col("_cells") > most).isEmpty():
            break
        level = counted.select(*on, (F.col("_level") + (F.col("_cells") > most).cast("int")).alias("_level"))
    names = [f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in on]

    def sweep(street: pd.DataFrame) -> pd.DataFrame:
        return street[[*on, "_level"]].head(1).assign(length_m=_tree_length(street))

    swept = cells.groupBy(*on).applyInPandas(sweep, f"{', '.join(names)}, _level int, length_m double")
    return swept.select(*on, (F.lit(cell) * F.pow(F.lit(2.0), "_level")).alias("cell_m"), "length_m")
