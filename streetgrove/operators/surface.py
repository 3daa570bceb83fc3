"""Raster of the ground as cell tables: components, bounded spread, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.operators import graph, spatial
from streetgrove.session import Growing, cut

# Fixed values.
SPREAD_M = 30.0
AMBIGUITY_M = 1.0
NARROW_CELLS = 4.0
NARROW_COST = 10.0
FUNCTIONAL_MAX_M2 = 3000.0
DISPLAY_MINORITY = 0.25
CELL = ["site_id", "row", "col"]


def row_runs(cells: DataFrame, *split: str) -> DataFrame:
    """Consecutive cells of a row as runs (row, c0, c1), apart by the columns in ``split``."""
    w = Window.partitionBy("site_id", "row", *split).orderBy("col")
    marked = cells.withColumn("_new", F.when(F.col("col") - F.lag("col").over(w) == 1, 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("site_id", "row", *split, "_run").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_run")


def components(cells: DataFrame, *split: str) -> DataFrame:
    """``cells`` with ``face``: 4-connected components of cells that agree on ``split``.

    Cells of a row are first merged into runs, so the graph has runs for nodes and a shared
    column between neighbouring rows for an edge; that is a small part of the cells.
    """
    keyed = cut(cells.select(*CELL, *split), "cells")
    runs = cut(
        row_runs(keyed, *split).withColumn("id", F.concat_ws(":", F.col("site_id"), F.lpad(F.col("row").cast("string"), 7, "0"), F.lpad(F.col("c0").cast("string"), 7, "0"))),
        "runs",
    )
    owned = cut(runs.withColumn("col", F.explode(F.sequence("c0", "c1"))).select("site_id", "row", "col", *split, "id"), "owned")
    below = owned.select("site_id", (F.col("row") - 1).alias("row"), "col", *split, F.col("id").alias("b"))
    edges = owned.withColumnRenamed("id", "a").join(below, [*CELL, *split]).select("a", "b").distinct()
    labels = graph.connected_components(runs, edges, key="id")
    return owned.join(labels, "id").select(*CELL, *split, F.col("component").alias("face"))


def spread(free: DataFrame, seeds: DataFrame, limit: int, *, price: str | None = None) -> DataFrame:
    """(cell, kind): least cost of reaching a free cell from a seed of the kind, at most ``limit`` steps.

    One ring of neighbours per round; only cells whose cost went down travel on, so a round costs
    the frontier and not the map. With ``price`` (a column of ``free``) a step costs the mean
    price of its two cells; the number of steps stays bounded, so the rounds are too.
    """
    ground = cut(free.select(*CELL, (F.col(price) if price else F.lit(1.0)).alias("_price")), "ground")
    best = cut(seeds.join(ground, CELL).select(*CELL, "kind", F.lit(0.0).alias("cost"), "_price").distinct(), "spread")
    front = best
    moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    for _ in range(limit):
        stepped = front.withColumn("m", F.explode(moves)).select(
            "site_id", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), "kind", F.col("cost").alias("_from"), F.col("_price").alias("_p0"))
        arrived = stepped.join(ground, CELL).withColumn("cost", F.col("_from") + (F.col("_p0") + F.col("_price")) / 2).groupBy(*CELL, "kind", "_price").agg(F.min("cost").alias("cost"))
        front = cut(arrived.join(best.select(*CELL, "kind", F.col("cost").alias("_old")), [*CELL, "kind"], "left").where(F.col("_old").isNull() | (F.col("cost") < F.col("_old"))).drop("_old"), "front")
        if front.isEmpty():
            break
        best = cut(best.select(*CELL, "kind", "cost", "_price").unionByName(front.select(*CELL, "kind", "cost", "_price")).groupBy(*CELL, "kind", "_price").agg(F.min("cost").alias("cost")), "spread")
    return best.select(*CELL, "kind", "cost")


def contest(costs: DataFrame, ambiguity: float) -> DataFrame:
    """Material of a cell from competing costs; within the ambiguity it stays unknown."""
    sides = costs.groupBy(*CELL).agg(
        F.min(F.when(F.col("kind") == "paved", F.col("cost"))).alias("paved"), F.min(F.when(F.col("kind") == "soil", F.col("cost"))).alias("soil"))
    far = F.lit(1e9)
    paved, soil = F.coalesce("paved", far), F.coalesce("soil", far)
    return sides.select(*CELL, F.when(paved + ambiguity < soil, "paved").when(soil + ambiguity < paved, "soil").otherwise("unknown").alias("material"))


def distance_to_other(cells: DataFrame, cell: float, *, reach: int = 3) -> DataFrame:
    """Distance of every soil cell to the nearest other cell (outside counts), metres.

    ``cells`` is the whole grid with a boolean ``soil``. The square of the distance separates:
    first along the row by two windows, then down the columns. Rows further away are looked at
    only for the cells that they can still bring nearer, first ``reach`` rows, then ever more.
    """
    w = Window.partitionBy("site_id", "row").orderBy("col")
    other = F.when(~F.col("soil"), F.col("col"))
    left = F.coalesce(F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    right = F.coalesce(F.first(other, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_cols"))
    size = cells.groupBy("site_id").agg((F.max("col") + 1).alias("_cols"), (F.max("row") + 1).alias("_rows"))
    along = cut(cells.join(size, "site_id").withColumn("_g", F.least(F.col("col") - left, right - F.col("col"))), "along")
    edge = F.least(F.col("row") + 1, F.col("_rows") - F.col("row"))
    state = along.where("soil").select(*CELL, F.least(F.col("_g") * F.col("_g"), edge * edge).alias("_d2"))
    done = Growing("depth")
    first, last = 1, reach
    while True:
        waits = F.col("_d2") > first * first
        done.add(state.where(~waits))
        steps = F.concat(F.sequence(F.lit(first), F.lit(last)), F.sequence(F.lit(-last), F.lit(-first)))
        todo = state.where(waits).withColumn("_dr", F.explode(F.filter(steps, lambda d: d * d < F.col("_d2"))))
        offers = todo.select("site_id", (F.col("row") + F.col("_dr")).alias("row"), "col", F.col("row").alias("_row"), "_dr", "_d2").join(along.select(*CELL, "_g"), CELL, "left")
        best = F.least(F.min("_d2"), F.min(F.col("_dr") * F.col("_dr") + F.col("_g") * F.col("_g")))
        state = cut(offers.groupBy("site_id", F.col("_row").alias("row"), "col").agg(best.alias("_d2")), "depth")
        if state.isEmpty():
            return done.all().select(*CELL, (F.sqrt(F.col("_d2").cast("double")) * cell).alias("distance_m"))
        first, last = last + 1, last * 4


def blocks(runs: DataFrame) -> DataFrame:
    """Runs with the same columns in consecutive rows merged into rectangles."""
    w = Window.partitionBy("site_id", "c0", "c1").orderBy("row")
    marked = runs.withColumn("_new", F.when(F.col("row") - F.lag("row").over(w) == 1, 0).otherwise(1)).withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("site_id", "c0", "c1", "_b").agg(F.min("row").alias("r0"), F.max("row").alias("r1")).drop("_b")


def majority_fill(cells: DataFrame, *, minority: float = DISPLAY_MINORITY) -> DataFrame:
    """Per face a known minority without its own label takes the majority material."""
    soil, paved = F.col("material") == "soil", F.col("material") == "paved"
    counts = cells.groupBy("face").agg(F.count_if(soil).alias("_s"), F.count_if(paved).alias("_p"))
    known = F.col("_s") + F.col("_p")
    winner = F.when((known > 0) & (F.col("_s") <= minority * known), "paved").when((known > 0) & (F.col("_p") <= minority * known), "soil")
    filled = F.when((soil | paved) & winner.isNotNull() & ~F.col("labelled"), winner).otherwise(F.col("material"))
    return cells.join(counts, "face").withColumn("shown", filled).drop("_s", "_p")


def narrow_price(depth: Column) -> Column:
    """Price of a cell by its distance to linework in cells: up to eleven steps at the line."""
    return 1 + NARROW_COST * F.greatest(F.lit(0.0), 1 - depth / NARROW_CELLS)


def placed_seeds(seeds: DataFrame, free: DataFrame, *, key: str = "label_id") -> DataFrame:
    """``seeds(site_id, key, row, col, ...)`` moved to the nearest free cell, ties to the smallest row and column.

    A label on a line speaks for the ground beside it. The search widens until a free cell is found; only on a site without
    one a seed has no place (nulls). ``moved`` says whether it stood on a free cell.
    """
    at = seeds.select("site_id", key, F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    ground = free.select("site_id", "row", "col", F.col("col").cast("double").alias("bx"), F.col("row").cast("double").alias("by"))
    near = spatial.nearest_segment(at, spatial.as_segments(ground, "bx", "by"), (2.0, 8.0), key=("site_id", key), payload=("row", "col"))
    rest = [c for c in seeds.columns if c not in ("row", "col")]
    return seeds.select(*rest).join(near.select("site_id", key, "row", "col", (F.col("distance") > 0).alias("moved")), ["site_id", key], "left")


def face_materials(faces: DataFrame, seeds: DataFrame, rows: Column, cols: Column) -> DataFrame:
    """(site_id, face, cells, soil, paved, material) from the labels in a face: one material decides, two leave it unresolved.

    A face that reaches the frame of its grid of ``rows`` by ``cols`` is open and decides nothing.
    """
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == rows - 1) | (F.col("col") == cols - 1)
    size = faces.groupBy("site_id", "face").agg(F.count(F.lit(1)).alias("cells"), F.max(edge).alias("open"))
    said = faces.select(*CELL, "face").join(seeds, CELL).groupBy("site_id", "face").agg(F.count_if(F.col("kind") == "soil").alias("soil"), F.count_if(F.col("kind") == "paved").alias("paved"))
    out = size.join(said, ["site_id", "face"], "left").fillna(0, ["soil", "paved"])
    soil, paved = F.col("soil") > 0, F.col("paved") > 0
    return out.withColumn("material", F.when(F.col("open"), "open").when(soil & paved, "unresolved").when(soil, "soil").when(paved, "paved").otherwise("unlabelled"))


def functional_faces(faces: DataFrame, labels: DataFrame, cell: float) -> DataFrame:
    """(site_id, face, area_m2, label_id, reason): faces under a functional label and smaller than the limit close as paved.

    ``labels(site_id, label_id, text, row, col)``; the smallest label of a face gives the reason.
    """
    area = faces.groupBy("site_id", "face").agg((F.count(F.lit(1)) * F.lit(cell * cell)).alias("area_m2")).where(F.col("area_m2") < FUNCTIONAL_MAX_M2)
    hit = faces.select(*CELL, "face").join(labels, CELL).groupBy("site_id", "face").agg(F.min(F.struct("label_id", "text")).alias("l"))
    return area.join(hit, ["site_id", "face"]).select("site_id", "face", "area_m2", "l.label_id", F.concat(F.lit("label: "), F.col("l.text")).alias("reason"))


def islands(materials: DataFrame, soil: DataFrame, beds: DataFrame, cell: float) -> DataFrame:
    """(site_id, face, area_m2, paved, other, flowerbed): soil parts by what lies around them.

    ``materials(cell, material)`` of all drawn cells, ``soil(cell, face)`` the parts, ``beds(cell)`` the places of bed labels. A part
    that touches nothing but paving and holds a bed label is a flowerbed.
    """
    moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    around = soil.withColumn("m", F.explode(moves)).select("site_id", "face", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"))
    beside = around.join(soil.select(*CELL, F.col("face").alias("_own")), CELL, "left").where("_own is null").join(materials, CELL, "left")
    paved = F.coalesce(F.col("material") == "paved", F.lit(False))
    border = beside.groupBy("site_id", "face").agg(F.count_if(paved).alias("paved"), F.count_if(~paved).alias("other"))
    held = soil.join(beds.select(*CELL).distinct(), CELL).select("site_id", "face").distinct().withColumn("_bed", F.lit(True))
    area = soil.groupBy("site_id", "face").agg((F.count(F.lit(1)) * F.lit(cell * cell)).alias("area_m2"))
    rows = border.join(area, ["site_id", "face"]).join(held, ["site_id", "face"], "left")
    return rows.select("site_id", "face", "area_m2", "paved", "other", ((F.col("other") == 0) & F.coalesce("_bed", F.lit(False))).alias("flowerbed"))


def part_words(parts: DataFrame, labels: DataFrame, cell: float) -> DataFrame:
    """(site_id, face, area_m2, kind, labels): parts with the word that most of their labels say, ties to the last in order."""
    size = parts.groupBy("site_id", "face").agg((F.count(F.lit(1)) * F.lit(cell * cell)).alias("area_m2"))
    votes = parts.select(*CELL, "face").join(labels, CELL).groupBy("site_id", "face", "word").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("site_id", "face").agg(F.max(F.struct("n", "word")).alias("b"))
    return size.join(best, ["site_id", "face"], "left").select("site_id", "face", "area_m2", F.coalesce("b.word", F.lit("none")).alias("kind"), F.coalesce("b.n", F.lit(0)).alias("labels"))


def planting_of_faces(faces: DataFrame, labels: DataFrame, cell: float) -> DataFrame:
    """(site_id, face, area_m2, kind, by): a lawn word in a face makes a lawn, a bed word without one a bed, else the nearest label decides.

    ``labels(site_id, label_id, row, col, word)``; the way to a label is measured from the middle of the face, in cells.
    """
    said = faces.select(*CELL, "face").join(labels, CELL).groupBy("site_id", "face").agg(F.max(F.col("word") == "lawn").alias("lawn"), F.max(F.col("word") == "bed").alias("bed"))
    middle = faces.groupBy("site_id", "face").agg(F.avg("col").alias("x"), F.avg("row").alias("y"), (F.count(F.lit(1)) * F.lit(cell * cell)).alias("area_m2"))
    orphans = middle.join(said, ["site_id", "face"], "left_anti")
    at = labels.select("site_id", "label_id", "word", F.col("col").cast("double").alias("bx"), F.col("row").cast("double").alias("by"))
    near = spatial.nearest_segment(orphans, spatial.as_segments(at, "bx", "by"), (8.0,), key=("site_id", "face"), payload=("label_id", "word")).select("site_id", "face", F.col("word").alias("_near"))
    rows = middle.join(said, ["site_id", "face"], "left").join(near, ["site_id", "face"], "left")
    kind = F.when(F.col("lawn"), "lawn").when(F.col("bed"), "bed").otherwise(F.coalesce("_near", F.lit("undecided")))
    by = F.when(F.col("lawn").isNotNull(), "label").when(F.col("_near").isNotNull(), "nearest").otherwise("none")
    return rows.select("site_id", "face", "area_m2", kind.alias("kind"), by.alias("by"))
