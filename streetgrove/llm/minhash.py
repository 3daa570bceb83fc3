"""Near duplicates by circulant MinHash, with exact confirmation.

A text's words are lower-cased (A-Z) runs between white space; its set holds its distinct word shingles, of fewer
words the whole sequence. Two permutations make all signature coordinates: the first scatters the shingles over a
ring, the second orders the ring, and coordinate k reads the second shifted by k places. Because of the shift the
coordinates of one shingle lie next to each other, so a signature is the minimum of a few slices.

Documents with equal sets are one class. Classes that agree in a band meet in a bucket. No bucket lists its pairs:
first all its members are confirmed against one leader, which joins a group of near copies at once. What remains are
members outside the largest component of a bucket; they are compared only with those that share one of their rarest
shingles, as many as two linked sets cannot all differ in, and early enough to share the rest. So nothing that meets in a bucket is left out, however full
it is, and a text that was edited too much to be linked meets nobody.

Empty and null texts have the empty set and are linked with nothing. Rows that repeat a doc_id count as one document
that is linked when any of its texts is. Rows without doc_id help nothing and stay by themselves unless equal sets
have an identifier.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.llm.common import slices, texts
from streetgrove.operators.graph import connected_components
from streetgrove.session import cut

BANDS, ROWS = 32, 5
#: Places of the ring, as a power of two.
RING = 22
SEED = 20_240_229
#: Shingles whose slices are gathered at once.
GATHER = 1 << 12
MEMORY = 100_000
CHUNK = 2 << 20
#: Classes in buckets up to this number go to the tasks by broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


@lru_cache(maxsize=2)
def shifted(coordinates: int, seed: int = SEED) -> np.ndarray:
    """Row p holds the second permutation at places p, p+1, ... of the ring; a view, not a copy."""
    ring = np.arange((1 << RING) + coordinates - 1, dtype=np.int32)  # shuffled where it stands: a worker never holds it twice
    np.random.default_rng(seed).shuffle(ring[: 1 << RING])
    ring[1 << RING :] = ring[: coordinates - 1]
    return np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def split_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingle_set(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The set itself, for confirmation."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def shingle_hashes(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + own[k : len(words) - size + 1 + k]
    return np.unique(mixed(h))


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of a set that is not empty."""
    ring = shifted(coordinates)
    places = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - RING)
    low = None
    for start in range(0, len(places), GATHER):
        part = ring[places[start : start + GATHER]].min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def buckets_of(low: np.ndarray, bands: int) -> np.ndarray:
    rows = low.reshape(bands, -1).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def sketches(docs: DataFrame, *, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_digest, buckets) of each whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches, "text", CHUNK):
            sizes, digests, buckets = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(split_words(text), shingle, known)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                buckets.append(buckets_of(signature(hashes, bands * rows), bands) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_digest", "buckets"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, buckets array<long>")


def confirm(pairs: DataFrame, texts_of: DataFrame, shingle: int) -> DataFrame:
    """(a, b, common, total): sizes of the intersection and the union of the full sets of each pair."""
    second = pairs.join(texts_of.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts_of.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in slices(batches, "text_b", CHUNK):
            common, total = [], []
            for text_a, text_b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if text_a != last[0]:
                    last = (text_a, shingle_set(split_words(text_a), shingle))
                other = shingle_set(split_words(text_b), shingle)
                shared = len(last[1] & other)
                common.append(shared)
                total.append(len(last[1]) + len(other) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    found = both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, common long, total long")
    # A doc_id with several texts has several answers; the best one counts.
    return found.groupBy("a", "b").agg(F.max_by(F.struct("common", "total"), F.col("common") / F.col("total")).alias("best")).select("a", "b", "best.*")


def prefixes(chosen: DataFrame, texts_of: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """(rep, token, rank, n): the rarest shingles of each text, so many that two texts with no common one cannot be linked.

    A link needs ``percent`` hundredths of either set in common. In one order of all shingles, here from the rarest among
    the chosen on, the first n - ceil(percent n / 100) + 1 of both sets then meet. Shingles of one text only are left
    out at the end, they meet nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches, "text", CHUNK):
            found = [shingle_hashes(split_words(t), shingle, known).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("own"), pa.array(found, pa.list_(pa.int64()))], ["rep", "own", "tokens"])

    rows = texts_of.join(chosen.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("own"), "text")
    sets = cut(rows.mapInArrow(run, "rep long, own long, tokens array<long>"), "near-sets")
    tokens = sets.select("rep", "own", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    order = Window.partitionBy("rep", "own").orderBy("often", "token")
    ranked = tokens.join(often, "token").withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("often") > 1)).select("rep", "token", "rank", "n").distinct()


def components(reps: DataFrame, docs: DataFrame, *, shingle: int, percent: int) -> DataFrame | None:
    """(rep, component) of the classes that meet others in a bucket; None if none do. ``reps``: (rep, buckets)."""
    entries = reps.select("rep", F.explode("buckets").alias("bucket"))
    full = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    members = cut(entries.join(full.select("bucket", "size"), "bucket"), "near-members")
    nodes = cut(members.select("rep").distinct(), "near-nodes")
    count = nodes.count()
    if count == 0:
        return None
    wanted = nodes.withColumnRenamed("rep", "doc_id")
    texts_of = cut(docs.join(F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted, "doc_id", "left_semi").distinct(), "near-texts")

    def links(pairs: DataFrame) -> DataFrame:
        found = confirm(pairs, texts_of, shingle)
        return cut(found.where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b"), "near-links")

    # Everyone against the leader of the bucket: the class that meets most others over all its buckets. In a group of
    # near copies that is one with few edits of its own, it leads in most buckets, and it links all that can be linked.
    standing = members.groupBy("rep").agg(F.sum("size").alias("standing"))
    head = F.max(F.struct("standing", (-F.col("rep")).alias("minus"))).alias("head")
    leaders = members.join(standing, "rep").groupBy("bucket").agg(head).select("bucket", (-F.col("head.minus")).alias("leader"))
    star = members.join(leaders, "bucket").where("rep != leader")
    first = links(star.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct())
    labels = connected_components(nodes, first, key="rep")
    # A link that is still unknown goes between two components of a bucket, so one end is outside its largest one.
    placed = members.join(labels, "rep")
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("top")).where("parts > 1")
    left = cut(placed.join(largest, "bucket").groupBy("rep", "component").agg(F.max(F.col("component") != F.col("top")).alias("outside")), "near-left")
    if left.isEmpty():
        return labels
    marks = cut(prefixes(left, texts_of, shingle=shingle, percent=percent).join(left, "rep"), "near-prefixes")
    outer = marks.where("outside").select("token", *(F.col(c).alias(f"{c}_p") for c in ("rep", "component", "rank", "n")))
    met = outer.join(marks.select("token", *(F.col(c).alias(f"{c}_q") for c in ("rep", "component", "rank", "n"))), "token")
    # The first shingle that two texts share, in the common order, leaves at most so many others to share.
    most = 1 + F.least(F.col("n_p") - F.col("rank_p"), F.col("n_q") - F.col("rank_q"))
    met = met.where((F.col("component_p") != F.col("component_q")) & (most * (100 + percent) >= (F.col("n_p") + F.col("n_q")) * percent))
    second = links(met.select(F.least("rep_p", "rep_q").alias("a"), F.greatest("rep_p", "rep_q").alias("b")).distinct())
    return connected_components(nodes, first.unionByName(second), key="rep")


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of the links with likeness of at least ``percent`` hundredths.

    Two sets with likeness s agree in no band with probability (1 - s**rows)**bands, 3e-6 at s = 0.8 with the
    defaults; every candidate is confirmed on the words themselves. The component carries its smallest doc_id.
    """
    rows_of = texts(docs, id_col, text_col)
    sketch = cut(sketches(rows_of, shingle=shingle, bands=bands, rows=rows), "near-sketches")
    classes = cut(sketch.where("n_shingles > 0").groupBy("set_digest").agg(F.min("doc_id").alias("rep")), "near-classes")
    own = sketch.join(classes.select("set_digest", F.col("rep").alias("doc_id")), ["set_digest", "doc_id"], "left_semi")
    reps = own.select(F.col("doc_id").alias("rep"), "buckets")
    labels = components(reps, rows_of, shingle=shingle, percent=percent)
    if labels is not None:
        classes = classes.join(labels, "rep", "left").select("set_digest", F.coalesce("component", "rep").alias("rep"))
    joined = sketch.drop("buckets").join(classes, "set_digest", "left")
    component = F.coalesce("rep", "doc_id").alias("component_id")
    return joined.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Every pair that shares a shingle, by SQL.
CHECKING_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then ws
  else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as set_of from w),
e as (select doc_id, len(set_of) as n, unnest(set_of) as shingle from s),
p as (select a.doc_id as a, b.doc_id as b from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on r.other = l.a),
c as (select doc_id, min(other) as component_id from r group by doc_id)
select s.doc_id, len(s.set_of)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept from s join c on s.doc_id = c.doc_id"""
