"""Variable-capacity best-fit packing of documents into sequences.

Several sequence lengths are permitted. Pieces are placed in descending length into the fullest open bin that has
room; if none has, bins of the length with the least cost per token are opened; at the end every bin shrinks to the
smallest permitted length that holds its contents. Texts longer than the largest length give full pieces and a rest.

The decision needs only how many pieces there are of each length, a table no longer than the largest permitted length
whatever the corpus holds. So the plan is made once from that histogram, and pieces find their place in it by their
rank among pieces of the same length. The result is the one that the sequential method has piece by piece.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.llm import bpe
from streetgrove.llm.common import texts
from streetgrove.session import cut

SIZES = (512, 1024, 2048, 4096)
#: Parts that the pieces of one length are ranked in.
SALTS = 64


def sequence_cost(size: int) -> float:
    """Matrix work grows with the length of a sequence, attention with its square."""
    return size * (1 + size / 16_384)


@dataclass(frozen=True)
class Slot:
    """Pieces ``first``, first + 1, ... of one length go into bins ``bin``, bin + 1, ... at ``start``; ``count`` of them."""

    length: int
    first: int
    count: int
    bin: int
    start: int


def plan(histogram: dict[int, int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost) -> list[tuple]:
    """(length, first, last, bin_shift, start, size, used): where the pieces of each length go, by rank.

    Bins are known by number; open bins with the same room are kept as ranges of numbers. Pieces of one length fill
    the ranges with the least room first, of equal room the lowest numbers, so a range is only ever cut at its front.
    """
    sizes = sorted(set(sizes))
    slots: list[Slot] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges of bins
    rooms: list[int] = []  # its keys in order
    opened: list[tuple[int, int, int]] = []  # first bin, bins, size
    bins = 0
    left_tokens = sum(length * n for length, n in histogram.items())

    def give(free: int, first: int, count: int) -> None:
        if free not in room:
            bisect.insort(rooms, free)
            room[free] = []
        heapq.heappush(room[free], (first, count))

    def fill(first: int, count: int, free: int, length: int, rank: int, n: int) -> int:
        """Fills bins from ``first`` on, each as far as it goes before the next, as a filled one is the fullest; pieces placed."""
        each = free // length
        placed = min(n, each * count)
        whole, rest = divmod(placed, each)
        done = rank
        for k in range(min(each, placed)):
            width = whole + (k < rest)
            slots.append(Slot(length, done, width, first, -(free - k * length)))
            done += width
        for start, width, left in ((0, whole, free - each * length), (whole, int(rest > 0), free - rest * length), (whole + (rest > 0), count - whole - (rest > 0), free)):
            if width:
                give(left, first + start, width)
        return placed

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        if not 0 < length <= sizes[-1]:
            raise ValueError("lengths go from 1 to the largest permitted size")
        left_tokens -= length * n
        while rank < n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, count = heapq.heappop(room[free])
                if not room[free]:
                    del room[free]
                    rooms.pop(at)
            else:
                # The least cost per token that a bin will hold: its own pieces and what smaller ones can add.
                def price(size: int, length: int = length, n: int = n - rank) -> float:
                    each = min(size // length, n)
                    return cost(size) / (each * length + min(size - each * length, left_tokens / -(-n // each)))

                free = min((s for s in sizes if s >= length), key=lambda s: (price(s), s))
                first, count = bins, -(-(n - rank) // (free // length))
                opened.append((first, count, free))
                bins += count
            rank += fill(first, count, free, length, rank, n - rank)

    # Slots were written with the free tokens that they found; now every bin has its size and its contents.
    opened.sort()
    free_of = sorted((first, count, free) for free, ranges in room.items() for first, count in ranges)
    edges = sorted({first for first, *_ in opened} | {first for first, *_ in free_of})
    size_at, free_at = [], []
    for edge in edges:
        size_at.append(opened[bisect.bisect_right(opened, (edge, 1 << 62, 0)) - 1][2])
        free_at.append(free_of[bisect.bisect_right(free_of, (edge, 1 << 62, 0)) - 1][2])
    rows = []
    for slot in slots:
        at, end = slot.bin, slot.bin + slot.count
        k = bisect.bisect_right(edges, at) - 1
        while at < end:
            upto = min(end, edges[k + 1] if k + 1 < len(edges) else end)
            used = size_at[k] - free_at[k]
            first = slot.first + at - slot.bin
            rows.append((slot.length, first, first + upto - at - 1, at - first, size_at[k] + slot.start, sizes[bisect.bisect_left(sizes, used)], used))
            at, k = upto, k + 1
    return rows


def pieces(docs: DataFrame, tokens: Column, largest: int) -> DataFrame:
    """(doc_id, part, length): full pieces of ``largest`` tokens and the rest; one piece of length 0 for an empty text."""
    n = F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    parts = F.greatest(F.lit(1), F.ceil(n / largest)).cast("int")
    split = docs.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return split.select("doc_id", "part", F.least(F.lit(largest), F.col("n") - F.col("part").cast("long") * largest).cast("int").alias("length"))


def estimated_tokens(text: Column) -> Column:
    """Four UTF-8 bytes a token, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def best_fit(
    docs: DataFrame, *, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost, tokens: Column | None = None,
    vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, part, length, bin_id, bin_size, bin_start, bin_used): one row a piece.

    ``vocab_path`` names the vocabulary that each text is counted with; ``tokens`` is a count that the rows have
    already, null is 0. With neither, lengths are ``estimated_tokens``, no promise that a bin holds its pieces. A piece of
    length 0 is in no bin (nulls). Pieces of one length are ranked by doc_id within salted parts, so a length that a
    third of all pieces share is spread over tasks. Rows that repeat a doc_id are pieces of their own.
    """
    if tokens is not None:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.alias("own_tokens"))
    elif vocab_path is not None:
        source = bpe.lengths(docs, vocab_path, id_col=id_col, text_col=text_col).select("doc_id", F.col("n_tokens").alias("own_tokens"))
    else:
        source = texts(docs, id_col, text_col).select("doc_id", estimated_tokens(F.col("text")).alias("own_tokens"))
    salt = F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int")
    split = cut(pieces(source, F.col("own_tokens"), max(sizes)).withColumn("salt", salt), "packing-pieces")
    counts = split.where("length > 0").groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as salts
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # One row for each length up to the largest.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = docs.sparkSession.createDataFrame(plan(histogram, sizes, cost), "length int, first long, last long, shift long, bin_start int, bin_size int, bin_used int")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "part")
    ranked = split.where("length > 0").withColumn("nth", F.row_number().over(order) - 1)
    ranked = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The layout's size is bound by the permitted lengths, not by the corpus.
    placed = ranked.join(F.broadcast(layout), "length").where("rank between first and last")
    placed = placed.select("doc_id", "part", "length", (F.col("rank") + F.col("shift")).alias("bin_id"), "bin_size", "bin_start", "bin_used")
    nothing = split.where("length = 0").select(
        "doc_id", "part", "length", *(F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_size", "int"), ("bin_start", "int"), ("bin_used", "int")))
    )
    return placed.unionByName(nothing)
