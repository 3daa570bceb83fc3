"""Clustering around centroids, with distances bounded by n-simplex projection.

Distances of a vector to several pivots are taken once. With the distances among the pivots they fix the apex of a
simplex: coordinates over the base that the pivots span, and the height above it. For two vectors the distance of the
apexes on the same side of the base is never more than their distance, on opposite sides never less. In every round
these bounds filter the centroids of a vector; those left are compared exactly, in integers.

Vectors that are null, have another length than ``width``, or hold a null, NaN or infinite component are dropped.
Repeated rows count as often as they occur; a null vec_id is no reason to drop a row, its hash comes last. Ties go to the
smaller number. With fewer vectors than centroids there are fewer centroids; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetgrove.llm import vectors
from streetgrove.llm.common import small_batches
from streetgrove.session import cut

WIDTH, SCALE, CENTROIDS, ROUNDS, PIVOTS = 64, 1024, 8, 10, 24
#: A pivot nearer to the span of those before it than this share of its distance to the first would blur the base.
LEAST_HEIGHT = 0.1
#: Share of the largest squared length by which computed bounds may be off.
SLACK = 1e-5


class Simplex:
    """The base simplex of the pivots and apexes above it."""

    def __init__(self, pivots: np.ndarray) -> None:
        chosen: list[int] = []
        rows: list[np.ndarray] = []
        for k in range(len(pivots)):
            if not chosen:
                chosen.append(k)
                continue
            y, square = self._solve(rows, [pivots[i] for i in chosen], pivots[k : k + 1])
            first = float(((pivots[k] - pivots[chosen[0]]).astype(np.float64) ** 2).sum())
            height = first - float((y**2).sum())
            if first and height > LEAST_HEIGHT**2 * first:
                rows.append(np.concatenate((y[0], [np.sqrt(height)])))
                chosen.append(k)
        self.pivots = pivots[chosen].astype(np.float64)
        size = len(chosen) - 1
        self.base = np.zeros((size, size))
        for i, row in enumerate(rows):
            self.base[i, : i + 1] = row

    @staticmethod
    def _solve(rows: list[np.ndarray], pivots: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of one vector over the base built so far, by forward substitution on squared distances."""
        square = np.array([((x[0] - p).astype(np.float64) ** 2).sum() for p in pivots])
        y = np.zeros((1, len(rows)))
        for i, row in enumerate(rows):
            own = float((row**2).sum())
            y[0, i] = ((square[0] + own - square[i + 1]) / 2 - float((row[:i] * y[0, :i]).sum())) / row[i]
        return y, square

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to every pivot."""
        x = x.astype(np.float64)
        return ((x**2).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1)[None, :]).clip(0)

    def apex(self, square: np.ndarray) -> np.ndarray:
        """Coordinates over the base, then the height, from squared distances to the pivots."""
        own = (self.base**2).sum(1)
        right = (square[:, :1] + own[None, :] - square[:, 1:]) / 2
        y = np.linalg.solve(self.base, right.T).T if len(own) else right
        height = np.sqrt((square[:, 0] - (y**2).sum(1)).clip(0))
        return np.concatenate((y, height[:, None]), axis=1)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distances between the vectors of apexes ``a`` and ``b``."""
    flat = ((a[:, :-1] ** 2).sum(1)[:, None] - 2 * a[:, :-1] @ b[:, :-1].T + (b[:, :-1] ** 2).sum(1)[None, :]).clip(0)
    h, g = a[:, -1:], b[:, -1][None, :]
    return flat + (h - g) ** 2, flat + (h + g) ** 2


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid of every row, and how many exact distances that took.

    Centroids whose lower bound is above the least upper bound are out. The rest are compared exactly in the order of
    their lower bounds, and each exact distance puts out what has a lower bound above it.
    """
    low, high = bounds(apexes, own)
    slack = SLACK * (1 + (apexes**2).sum(1)[:, None] + (own**2).sum(1)[None, :])
    limit = (high + slack).min(1)
    order = np.argsort(low - slack, axis=1, kind="stable")
    best = np.full(len(x), np.iinfo(np.int64).max)
    chosen = np.full(len(x), len(centroids))
    taken = 0
    alone = ((low - slack) <= limit[:, None]).sum(1) == 1
    chosen[alone] = order[alone, 0]
    rest = np.flatnonzero(~alone)
    for k in range(len(centroids)):
        c = order[rest, k]
        open_ = (low - slack)[rest, c] <= np.minimum(limit[rest], best[rest])
        rest, c = rest[open_], c[open_]
        if not len(rest):
            break
        square = ((x[rest] - centroids[c]) ** 2).sum(1)
        taken += len(rest)
        better = (square < best[rest]) | ((square == best[rest]) & (c < chosen[rest]))
        at = rest[better]
        best[at], chosen[at] = square[better], c[better]
    return chosen, taken


def kept_vectors(rows: DataFrame, *, width: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col)
    kept = rows.where(vectors.sound(vector) & (F.size(vector) == width))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), vectors.whole_numbers(vector, scale).alias("x"))


def _with_apexes(batches: Iterator[pa.RecordBatch], simplex: Simplex, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = vectors.matrix(batch.column("x"), width)
        apexes = simplex.apex(simplex.distances(x))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), vectors.nested(apexes, pa.float64())], ["vec_id", "x", "apex"])


def _sums(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Component sums and counts by centroid, one list a task."""
    k, width = centroids.shape
    own, sums, counts = simplex.apex(simplex.distances(centroids)), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        x = vectors.matrix(batch.column("x"), width)
        chosen, _ = nearest(x, vectors.matrix(batch.column("apex"), own.shape[1], np.float64), centroids, own)
        np.add.at(sums, chosen, x)
        counts += np.bincount(chosen, minlength=k)
    number, position = np.divmod(np.arange(k * width), width)
    columns = [pa.array(v, pa.int64()) for v in (number, position, sums.reshape(-1), np.repeat(counts, width))]
    yield pa.RecordBatch.from_arrays(columns, ["cluster", "position", "total", "n"])


def _final(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    own = simplex.apex(simplex.distances(centroids))
    for batch in batches:
        x = vectors.matrix(batch.column("x"), centroids.shape[1])
        chosen, _ = nearest(x, vectors.matrix(batch.column("apex"), own.shape[1], np.float64), centroids, own)
        square = ((x - centroids[chosen]) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(chosen, pa.int32()), pa.array(square, pa.int64())], ["vec_id", "cluster", "distance"])


def cluster(
    rows: DataFrame, *, width: int = WIDTH, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS,
    seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Vectors and apexes are written once; a round reads them, and each task sends one sum a centroid and component. The
    driver holds centroids and pivots only.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kept = kept_vectors(rows, width=width, scale=scale, id_col=id_col, vector_col=vector_col)
    hashed = kept.withColumn("hash", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy(F.col("hash").asc_nulls_last(), "x").limit(max(centroids, pivots)).collect()
    points = np.array([r["x"] for r in first], np.int64).reshape(len(first), width)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(points):
        return spark.createDataFrame([], schema)
    simplex, now = Simplex(points[:pivots]), points[:centroids]
    cached = cut(kept.mapInArrow(partial(_with_apexes, simplex=simplex, width=width), "vec_id long, x array<long>, apex array<double>"), "apexes")
    for _ in range(rounds):
        partial_sums = cached.mapInArrow(partial(_sums, simplex=simplex, centroids=now), "cluster long, position long, total long, n long")
        sums, counts = np.zeros_like(now), np.zeros(len(now), np.int64)
        for r in vectors.grouped_sums(partial_sums, ["cluster", "position"], ["total", "n"]):
            sums[r["cluster"], r["position"]], counts[r["cluster"]] = r["total"], r["n"]
        after = np.where(counts[:, None] > 0, vectors.floor_mean(sums, counts.clip(1)), now)
        if (after == now).all():
            break  # later rounds would repeat this one
        now = after
    found = cut(cached.mapInArrow(partial(_final, simplex=simplex, centroids=now), "vec_id long, cluster int, distance long"), "clusters")
    digests = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(now)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    # One row a centroid.
    sums = inertia.join(names, "cluster").crossJoin(total)
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def checking_sql(width: int = WIDTH, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """Lloyd's rounds spelled out, every distance computed."""
    parts = [f"""
v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({scale}::double * x::double)::bigint) as x from embeddings
  where len(embedding) = {width} and list_count(embedding) = {width} and len(list_filter(embedding, lambda x: isfinite(x))) = {width}),
c0 as materialized (
  select (row_number() over (order by h, x) - 1)::int as k, x from (select x, sha256(concat('3:', vec_id::varchar)) as h from v order by h, x limit {centroids}))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} as materialized (
  select vec_id, x, k, d from (
    select vec_id, x, k, d, row_number() over (partition by vec_id order by d, k) as nth from (
      select v.vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
      from v cross join c{r} c)) where nth = 1)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} as materialized (
  select c.k, coalesce(n.x, c.x) as x from c{r} c left join (
    select k, list(m order by p) as x from (
      select k, p, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m
      from (select k, unnest(x) as e, generate_subscripts(x, 1) as p from a{r}) group by k, p) group by k) n on c.k = n.k)""")
    last = rounds
    parts.append(f"""
i as (select k, sum(d)::bigint as s from a{last} group by k)""")
    return "with " + ",".join(parts) + f"""
select a.vec_id, a.k as cluster, a.d as distance, i.s as cluster_inertia, (select sum(s) from i)::bigint as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{last} a join i on i.k = a.k join c{last} c on c.k = a.k"""
