"""Document fingerprints by winnowing, and the likeness of neighbours and edited copies.

A text's k-grams of code points get rolling hashes; of every ``window`` hashes in a row the smallest is kept, of
equal ones the rightmost, with its position. Two texts that share ``window + gram - 1`` code points in a row share a
fingerprint entry. A text with fewer k-grams than a window is one window, one with fewer code points than a k-gram
is one gram, and an empty or null text has the empty fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetgrove.llm.common import slices, texts

GRAM, WINDOW = 12, 16
#: Windows handled at once, so that a text of any length needs bounded memory beside itself.
SEGMENT = 1 << 18
BASE = 0x9E3779B97F4A7C15
#: One entry of the written form: the hash, and the step from the position before.
ENTRY = np.dtype([("hash", ">u4"), ("step", "u1")])
CHUNK = 4 << 20


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (BASE, inverse))
    return up, down


def rolling(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of every k-gram, from one running polynomial sum."""
    up, down = powers(SEGMENT + 2 * 512 + 2)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)))
    h = (sums[gram:] - sums[:-gram]) * down[: len(codes) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions) kept of ``text``, in order of position."""
    if not 1 <= window <= 255 or not 1 <= gram <= 255:
        raise ValueError("gram and window go from 1 to 255")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if n < gram:
        return rolling(codes, n).astype(np.uint32), np.zeros(1, np.int64)
    grams = n - gram + 1
    window = min(window, grams)
    kept: list[np.ndarray] = []
    last = None
    for start in range(0, grams - window + 1, SEGMENT):
        end = min(start + SEGMENT, grams - window + 1)
        h = rolling(codes[start : end + window - 1 + gram - 1], gram)
        # The smallest key has the smallest hash and, of equal ones, the rightmost position.
        key = h << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(start, start + len(h), dtype=np.uint64))
        span = 1
        while 2 * span <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < window:
            key = np.minimum(key[: span - window], key[window - span :])
        fresh = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
        kept.append(key[fresh])
        last = key[-1]
    keys = np.concatenate(kept)
    return (keys >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)


def write(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Ten hexadecimal digits an entry: eight of the hash, two of the step from the position before."""
    entries = np.empty(len(hashes), ENTRY)
    entries["hash"], entries["step"] = hashes, np.diff(positions, prepend=0)
    return entries.tobytes().hex()


def read(fingerprint: str) -> list[tuple[int, int]]:
    """(hash, position) of every entry."""
    entries = np.frombuffer(bytes.fromhex(fingerprint), ENTRY)
    return list(zip(entries["hash"].tolist(), np.cumsum(entries["step"], dtype=np.int64).tolist(), strict=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def fingerprints(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes array<long>, positions array<long>) of each whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            found = [winnow(t, gram, window) for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in found], kind), pa.array([p for _, p in found], kind)],
                ["doc_id", "hashes", "positions"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the identifier, by halving steps."""
    if not bounds:
        return F.lit(0)
    array = F.array(*(F.lit(x) for x in bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    up = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) <= doc_id), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), up)


def with_neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, doc_id, text): each bucket holds a stretch of descending doc_id and then the row that follows it.

    The bounds of the stretches are approximate quantiles of doc_id; their number is set by ``buckets`` alone. The
    row that follows a stretch is the first of the next one that has rows, after the last the very first. Every text
    is shuffled once, those first rows twice. Rows with a null doc_id come last.
    """
    shares = [k / buckets for k in range(1, buckets)]
    found = docs.select(F.percentile_approx("doc_id", shares, 10 * buckets).alias("q")).first()["q"] if shares else None
    placed = docs.withColumn("bucket", _bucket(F.col("doc_id"), sorted(set(found or []))))
    heads = sorted(((r["bucket"], r["head"]) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    spark = docs.sparkSession
    guests = spark.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "head long, follows int")
    # One row for each bucket, so the broadcast is bounded by their number.
    joined = placed.join(F.broadcast(guests), placed["doc_id"].eqNullSafe(guests["head"]), "left")
    own, guest = F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("follows").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("follows").isNull(), F.array(own)).otherwise(F.array(own, guest))
    return joined.select(F.explode(places).alias("place"), "doc_id", "text").select("place.bucket", "place.guest", "doc_id", "text")


def edited_likeness(
    docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each whole text.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or all, of the
    next document in descending doc_id; after the last comes the first, and a lone document follows itself. Rows that
    repeat a doc_id follow each other by text. A task walks its rows in order and holds two texts.
    """
    n = buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_neighbours(texts(docs, id_col, text_col), n)
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None
        for batch in slices(batches, "text", CHUNK):
            out: list[tuple] = []
            for bucket, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, positions = winnow(text, gram, window)
                kept = np.unique(hashes)
                if before is not None and before[0] == bucket:
                    _, own_id, own_text, own_hashes, own_positions, own_kept = before
                    half = len(own_text) // 2
                    edited = own_text[: len(own_text) - half] + text[:half]
                    new_hashes, new_positions = winnow(edited, gram, window)
                    out.append((
                        own_id, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), write(own_hashes, own_positions),
                        write(new_hashes, new_positions), likeness(own_kept, np.unique(new_hashes)), likeness(own_kept, kept),
                    ))
                before = None if guest else (bucket, doc_id, text, hashes, positions, kept)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema)
