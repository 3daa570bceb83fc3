"""Vector codes: a codebook for every part of the vectors, learned over metric trees.

Vectors are cut into equal consecutive parts. For each part position the parts of a chunk of vectors form a metric tree,
built middle-out by the anchors hierarchy: about sqrt(n) anchors own the points nearest to them, steal points of each
other only as far as the triangle inequality allows, are merged pairwise into ever larger balls above, and are divided in
the same way below. Every ball caches the sum and the number of its points. A round walks the tree from the top; a ball
inherits the entries that may still own a point of the ball above it and strikes those that another entry beats all
over the ball. A ball with one entry left adds its cached sum; what reaches a leaf is compared point by point in integers.

Vectors that are null or hold a null, NaN or infinite component are dropped, and those whose length is not the most
frequent one among the rest (of equally frequent ones the larger); that length must be a multiple of the number of parts.
Repeated rows count as often as they occur; a null vec_id comes last in order. Ties go to the lower entry. With fewer
vectors than entries there are fewer entries; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetgrove.llm import vectors
from streetgrove.llm.common import BROADCAST_ROWS, small_batches
from streetgrove.session import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a chunk, all parts of which are in the trees of one row.
CHUNK = 4096
#: Points of a ball that is not divided any further.
LEAF = 64
#: Parts that a label's rows are joined in.
SALTS = 32
#: Share by which a computed distance may be off, many times what doubles are.
SLACK = 1e-9


@dataclass
class Tree:
    """Balls in order of depth: points ``start`` to ``end`` of the tree's order, children ``child`` to ``child + children``."""

    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def anchors(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Point numbers owned by each of up to ``most`` anchors; fewer if there are fewer different points."""
    owner, at = np.zeros(len(points), np.int64), [0]
    own = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(at) < most:
        new = int(np.argmax(own))
        if own[new] == 0:
            break
        gap = np.sqrt(((points[at] - points[new]) ** 2).sum(1))
        # A point nearer to its anchor than half the gap cannot be nearer to the new one.
        open_ = np.flatnonzero(own > gap[owner] / 2 * (1 - SLACK))
        d = np.sqrt(((points[open_] - points[new]) ** 2).sum(1))
        stolen = open_[d < own[open_]]
        own[stolen] = d[d < own[open_]]
        owner[stolen] = len(at)
        at.append(new)
    by = np.argsort(owner, kind="stable")
    return [g for g in np.split(by, np.searchsorted(owner[by], np.arange(1, len(at)))) if len(g)]


def _merge(groups: list[tuple[np.ndarray, object]]) -> object:
    """A binary tree over balls (center and radius, subtree), by the pair whose common ball is smallest."""
    centers = np.array([g[0][:-1] for g in groups])
    radii = np.array([g[0][-1] for g in groups])
    nodes: list = [g[1] for g in groups]

    def common(i: int) -> np.ndarray:
        d = np.sqrt(((centers - centers[i]) ** 2).sum(1))
        return np.maximum((d + radii + radii[i]) / 2, np.maximum(radii, radii[i]))

    alive = np.ones(len(nodes), bool)
    size = np.array([common(i) for i in range(len(nodes))])
    size[np.diag_indices(len(nodes))] = np.inf
    for _ in range(len(nodes) - 1):
        i, j = divmod(int(np.argmin(size)), len(nodes))
        d = float(np.sqrt(((centers[i] - centers[j]) ** 2).sum()))
        radius = size[i, j]
        centers[i] += (centers[j] - centers[i]) * (min(max((radius - radii[i]) / d, 0), 1) if d else 0)
        radii[i], nodes[i], alive[j] = radius, [nodes[i], nodes[j]], False
        size[j] = size[:, j] = np.inf
        row = np.where(alive, common(i), np.inf)
        row[i] = np.inf
        size[i] = size[:, i] = row
    return nodes[int(np.flatnonzero(alive)[0])]


def _divide(points: np.ndarray, numbers: np.ndarray) -> object:
    """Nested lists of balls over ``numbers``; a leaf is an array."""
    if len(numbers) <= LEAF:
        return numbers
    groups = anchors(points[numbers], max(2, int(np.sqrt(len(numbers)))))
    if len(groups) == 1:  # equal points
        return numbers
    balls = []
    for g in groups:
        own = points[numbers[g]]
        center = own.mean(0)
        radius = np.sqrt(((own - center) ** 2).sum(1).max())
        balls.append((np.append(center, radius), _divide(points, numbers[g])))
    return _merge(balls)


def grow(points: np.ndarray) -> Tree:
    """The tree over integer ``points``; centers are means, radii reach the farthest point."""
    top = _divide(points.astype(np.float64), np.arange(len(points)))
    leaves: list[np.ndarray] = []
    spans: dict[int, tuple[int, int]] = {}
    stack: list[tuple[object, bool]] = [(top, False)]
    opened: dict[int, int] = {}
    held = 0
    while stack:
        node, done = stack.pop()
        if done:
            spans[id(node)] = (opened[id(node)], held)
        elif isinstance(node, np.ndarray):
            leaves.append(node)
            spans[id(node)] = (held, held + len(node))
            held += len(node)
        else:
            opened[id(node)] = held
            stack += [(node, True), *((x, False) for x in reversed(node))]
    order = np.concatenate(leaves)
    level, flat, child, children = [top], [], [], []
    while level:
        below = []
        first = len(flat) + len(level)
        for node in level:
            own = [] if isinstance(node, np.ndarray) else node
            child.append(first + len(below))
            children.append(len(own))
            below += own
        flat += level
        level = below
    start, end = np.array([spans[id(x)] for x in flat]).T
    sorted_ = points[order]
    upto = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(sorted_, axis=0)))
    total = upto[end] - upto[start]
    center = total / (end - start)[:, None]
    radius = np.array([np.sqrt(((sorted_[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(start, end, center, strict=True)])
    narrow = np.promote_types(np.min_scalar_type(min(int(points.min()), -1)), np.min_scalar_type(int(points.max()) * -1 - 1))
    return Tree(order, sorted_.astype(narrow), start, end, np.array(child), np.array(children), center, radius, total)


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances in integers, by the product of matrices while doubles hold them exactly."""
    widest = max(abs(int(f(x, initial=0))) for f in (np.min, np.max) for x in (points, book))
    if widest**2 * points.shape[1] < 1 << 50:
        a, b = points.astype(np.float64), book.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :]).astype(np.int64)
    return ((points[:, None, :].astype(np.int64) - book[None, :, :]) ** 2).sum(2)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``n`` numbers each, one after another."""
    upto = np.cumsum(n)
    return np.repeat(start - upto + n, n) + np.arange(upto[-1] if len(n) else 0)


def walk(tree: Tree, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(balls owned whole and their entries by level, points left, their entries): every point is under one of them."""
    first = np.array([not (book[:k] == e).all(1).any() for k, e in enumerate(book)])  # an equal earlier entry wins all ties
    entries = book.astype(np.float64)
    gap = np.sqrt(((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2))
    balls, may = np.zeros(1, np.int64), first[None, :]
    owned: list[tuple[np.ndarray, np.ndarray]] = []
    left: list[np.ndarray] = []
    left_may: list[np.ndarray] = []
    while len(balls):
        square = ((tree.center[balls][:, None, :] - entries[None, :, :]) ** 2).sum(2)
        square[~may] = np.inf
        best = np.argmin(square, axis=1)
        least = square[np.arange(len(balls)), best][:, None]
        # Beaten all over the ball: the ball is on the best entry's side of the plane between the two.
        slack = SLACK * (1 + least + np.where(may, square, 0))
        may = may & ~(square - least > 2 * tree.radius[balls][:, None] * gap[best] * (1 + SLACK) + slack)
        alone = may.sum(1) == 1
        if alone.any():
            owned.append((balls[alone], np.argmax(may[alone], axis=1)))
        balls, may = balls[~alone], may[~alone]
        leaf = tree.children[balls] == 0
        n = tree.end[balls[leaf]] - tree.start[balls[leaf]]
        left.append(ranges(tree.start[balls[leaf]], n))
        left_may.append(np.repeat(may[leaf], n, axis=0))
        balls, may = balls[~leaf], may[~leaf]
        n = tree.children[balls]
        balls, may = ranges(tree.child[balls], n), np.repeat(may, n, axis=0)
    at = np.concatenate([np.zeros(0, np.int64), *left])
    if not len(at):
        return owned, at, at
    near = np.where(np.concatenate(left_may), squares(tree.points[at], book), np.iinfo(np.int64).max)
    return owned, at, np.argmin(near, axis=1)


def sums(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and numbers of the points of each entry."""
    total, n = np.zeros_like(book), np.zeros(len(book), np.int64)
    owned, at, entry = walk(tree, book)
    for balls, entries in owned:
        np.add.at(total, entries, tree.total[balls])
        np.add.at(n, entries, tree.end[balls] - tree.start[balls])
    np.add.at(total, entry, tree.points[at])
    np.add.at(n, entry, 1)
    return total, n


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point, in the points' own order."""
    chosen = np.empty(len(tree.order), np.int64)
    owned, at, entry = walk(tree, book)
    for balls, entries in owned:
        for b, e in zip(balls, entries, strict=True):
            chosen[tree.start[b] : tree.end[b]] = e
    chosen[at] = entry
    square = ((tree.points - book[chosen]) ** 2).sum(1)
    out = np.empty((2, len(chosen)), np.int64)
    out[:, tree.order] = chosen, square
    return out[0], out[1]


def _chunks(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[pa.RecordBatch]:
    """One row a chunk and part: its tree; the first part's row also carries who the vectors are."""
    held: list[pa.RecordBatch] = []

    def trees() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        x = vectors.matrix(rows.column("x"), width)
        step = width // parts
        who = {"vec_id": rows.column("vec_id").to_pylist(), "label": rows.column("label").to_pylist()}
        made = [grow(x[:, p * step : (p + 1) * step]) for p in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(who)], pa.binary()), pa.array([pickle.dumps(made)], pa.binary())], ["who", "trees"])

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            if sum(b.num_rows for b in held) + piece.num_rows > CHUNK:
                yield from trees()
            held.append(piece)
    if held:
        yield from trees()


def _round(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    parts, (entries, step) = len(books), books[0].shape
    total, n = np.zeros((parts, entries, step), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        for blob in batch.column("trees"):
            for p, tree in enumerate(pickle.loads(blob.as_py())):
                t, c = sums(tree, books[p])
                total[p] += t
                n[p] += c
    part, rest = np.divmod(np.arange(total.size), entries * step)
    entry, position = np.divmod(rest, step)
    columns = [pa.array(v, pa.int64()) for v in (part, entry, position, total.reshape(-1), np.repeat(n.reshape(-1), step))]
    yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "total", "n"])


def _encode(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for who_blob, blob in zip(batch.column("who"), batch.column("trees"), strict=True):
            who = pickle.loads(who_blob.as_py())
            code, error = np.empty((len(who["vec_id"]), len(books)), np.uint8), np.zeros(len(who["vec_id"]), np.int64)
            for p, tree in enumerate(pickle.loads(blob.as_py())):
                chosen, square = assign(tree, books[p])
                code[:, p] = chosen
                error += square
            digits = code.tobytes().hex()
            wide = 2 * len(books)
            codes = [digits[k : k + wide] for k in range(0, len(digits), wide)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(who["vec_id"], pa.int64()), pa.array(who["label"], pa.int32()), pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )


def kept_vectors(rows: DataFrame, *, scale: int, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the vectors that are coded, and their length."""
    vector = F.col(vector_col)
    good = rows.where(vectors.sound(vector))
    usual = good.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = usual["width"] if usual else 0
    kept = good.where(F.size(vector) == width)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), vectors.whole_numbers(vector, scale).alias("x")), width


def _with_label_error(found: DataFrame) -> DataFrame:
    """Errors summed by label, nulls together, beside every row. Few labels are broadcast; many are joined with each label in salted parts."""
    errors = cut(found.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    l, r = found.alias("l"), errors.withColumnRenamed("label", "sum_label")
    if errors.count() <= BROADCAST_ROWS:
        joined = l.join(F.broadcast(r), F.col("label").eqNullSafe(F.col("sum_label")))
    else:
        salted = r.withColumn("sum_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = found.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, F.col("label").eqNullSafe(F.col("sum_label")) & (F.col("salt") == F.col("sum_salt")))
    return joined.select("vec_id", "label", "code", "error", "label_error")


def encode(
    rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector.

    Trees are grown once, chunk by chunk where the vectors lie, and written to the shared folder; no vector is shuffled.
    A round reads them and each task sends one sum an entry and component. The driver holds the codebooks only.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so 256 entries at most")
    spark = rows.sparkSession
    small_batches(spark)
    kept, width = kept_vectors(rows, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not width:
        return spark.createDataFrame([], schema)
    if width % parts:
        raise ValueError(f"vectors of {width} components do not divide into {parts} parts")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    points = np.array([r["x"] for r in first], np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(points, parts, axis=1)]
    trees = cut(kept.mapInArrow(partial(_chunks, parts=parts, width=width), "who binary, trees binary"), "trees")
    for _ in range(rounds):
        partial_sums = trees.mapInArrow(partial(_round, books=books), "part long, entry long, position long, total long, n long")
        after = [b.copy() for b in books]
        for r in vectors.grouped_sums(partial_sums, ["part", "entry", "position"], ["total", "n"]):
            if r["n"]:
                after[r["part"]][r["entry"], r["position"]] = r["total"] // r["n"]
        if all((a == b).all() for a, b in zip(after, books, strict=True)):
            break  # later rounds would repeat this one
        books = after
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    found = cut(trees.mapInArrow(partial(_encode, books=books), "vec_id long, label int, code string, error long"), "codes")
    return _with_label_error(found).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def checking_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds spelled out, every distance computed."""
    steps = [f"""
g as materialized (select * from embeddings where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
w as (select len(embedding) as width from g group by 1 order by count(*) desc, width desc limit 1),
v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor({scale}::double * x::double)::bigint) as x from g where len(embedding) = (select width from w)),
p as materialized (
  select vec_id, label, j, x[j * (len(x) // {parts}) + 1:(j + 1) * (len(x) // {parts})] as x from v cross join range({parts}) t(j)),
b0 as materialized (
  select j, (dense_rank() over (order by vec_id) - 1)::int as e, x from p where vec_id in (select vec_id from v order by vec_id limit {entries}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
  select vec_id, label, j, x, e, d from (
    select vec_id, label, j, x, e, d, row_number() over (partition by vec_id, j order by d, e) as nth from (
      select p.vec_id, p.label, p.j, p.x, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
      from p join b{r} b on b.j = p.j)) where nth = 1)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} as materialized (
  select b.j, b.e, coalesce(n.x, b.x) as x from b{r} b left join (
    select j, e, list(m order by i) as x from (
      select j, e, i, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m
      from (select j, e, unnest(x) as c, generate_subscripts(x, 1) as i from a{r}) group by j, e, i) group by j, e) n on b.j = n.j and b.e = n.e)""")
    last = rounds
    return "with " + ",".join(steps) + f""",
f as materialized (select vec_id, label, string_agg(printf('%02x', e), '' order by j) as code, sum(d)::bigint as error from a{last} group by vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(c::varchar, ',' order by j, e, i)) from (select j, e, unnest(x) as c, generate_subscripts(x, 1) as i from b{last})) as codebooks_sha256
from f"""
