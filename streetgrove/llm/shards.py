"""Sharding by fixed virtual slots.

A record is hashed into one of thousands of slots whose number never changes. Bytes and rows are summed by slot, and a
map says which shard owns each slot. The map has versions: the first deals slots evenly, every later one stores only
the slots that change their owner. Rebalancing by bytes or adding a shard is an edit of the map; no record is hashed anew.

Law ``bytes``: sizes of the shards are near equal, as near as whole slots allow. A null text is taken as empty: size 8,
checksum 0. A null doc_id is hashed like any other value. The text's checksum and size go into the hash, so copies under
other identifiers, or other texts under the same one, spread over the slots; only rows equal in both share one for
certain. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetgrove.session import checkpoint_root, cut

#: Virtual slots; fixed for the life of a map, and the bound of every table that a driver holds here.
SLOTS = 16_384
SHARDS = 24
#: Bytes that a record takes besides its text.
RECORD_BYTES = 8
#: Two shards whose sizes differ by less than this share of the mean are near equal.
TOLERANCE = 0.0005
MAP = "virtual_slot int, shard int"


def records(docs: DataFrame, *, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row; texts stay where they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot; combined before the shuffle, one row a slot comes back."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    sums = np.zeros((2, slots), np.int64)
    for r in found:
        sums[:, r["virtual_slot"]] = r["bytes"], r["rows"]
    return sums[0], sums[1]


def first_map(slots: int, shards: int) -> np.ndarray:
    """Slots dealt in equal ranges, whatever they hold."""
    return np.arange(slots, dtype=np.int64) * shards // slots


def _best_exchange(heavy: np.ndarray, light: np.ndarray, gap: int) -> tuple[int, int, int] | None:
    """(bytes that go over, index of the slot given, index of the slot taken or -1) nearest to half the gap; None if nothing helps.

    ``heavy`` and ``light`` are slot sizes in ascending order; nothing taken counts as a slot of size 0.
    """
    if not len(heavy):
        return None
    back = np.concatenate(([0], light))
    at = np.searchsorted(back, heavy - gap / 2)
    best = None
    for k in (np.clip(at, 0, len(back) - 1), np.clip(at - 1, 0, len(back) - 1)):
        over = heavy - back[k]
        off = np.where((over > 0) & (over < gap), np.abs(2 * over - gap), np.iinfo(np.int64).max)
        i = int(np.argmin(off))
        if 0 < over[i] < gap and (best is None or off[i] < best[0]):
            best = (int(off[i]), int(over[i]), i, int(k[i]) - 1)
    return best and best[1:]


def rebalance(owner: np.ndarray, weight: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Edits slot -> shard that make the shards' sums of ``weight`` near equal.

    Shards above the mean give up whole slots, largest first; these go to the lightest shard in turn. Then the heaviest
    shard moves or exchanges one slot with a lighter one until the difference is within the tolerance or nothing helps;
    every step brings two sums strictly nearer, so it ends.
    """
    now = owner.copy()
    load = np.bincount(now, weight, shards).astype(np.int64)
    mean = int(weight.sum()) // shards
    pool: list[int] = []
    for s in range(shards):
        for slot in sorted(np.flatnonzero(now == s).tolist(), key=lambda x: (-weight[x], x)):
            if weight[slot] and load[s] - weight[slot] >= mean:
                pool.append(slot)
                load[s] -= weight[slot]
    for slot in sorted(pool, key=lambda x: (-weight[x], x)):
        s = int(np.argmin(load))
        now[slot] = s
        load[s] += weight[slot]

    def held(s: int) -> np.ndarray:
        own = np.flatnonzero((now == s) & (weight > 0))
        return own[np.argsort(weight[own], kind="stable")]

    while shards > 1 and load.max() - load.min() > max(tolerance * mean, 1):
        high = int(np.argmax(load))
        mine = held(high)
        for low in np.argsort(load, kind="stable").tolist():
            theirs = held(low)
            step = low != high and _best_exchange(weight[mine], weight[theirs], int(load[high] - load[low]))
            if step:
                over, given, taken = step
                now[mine[given]] = low
                if taken >= 0:
                    now[theirs[taken]] = high
                load[high] -= over
                load[low] += over
                break
        else:
            break
    return {int(s): int(now[s]) for s in np.flatnonzero(now != owner)}


def add_shard(owner: np.ndarray, weight: np.ndarray, shards: int) -> dict[int, int]:
    """Edits that give a new shard, number ``shards``, its share; slots only go to the new one, from the heaviest shard each."""
    load = np.bincount(owner, weight, shards).astype(np.int64)
    share, got, edits = int(weight.sum()) // (shards + 1), 0, {}
    queues = {s: sorted(np.flatnonzero(owner == s).tolist(), key=lambda x: (weight[x], x)) for s in range(shards)}
    while got < share:
        fits = [(int(load[s]), -s) for s in queues if queues[s] and got + weight[queues[s][-1]] <= share]
        if not fits:
            rest = [s for s in queues if queues[s]]
            if not rest:
                break
            for s in rest:  # the largest slots do not fit any more
                queues[s].pop()
            continue
        s = -max(fits)[1]
        slot = queues[s].pop()
        edits[slot] = shards
        load[s] -= weight[slot]
        got += int(weight[slot])
    return edits


class SlotMaps:
    """The versioned map, a folder of edits: a slot's owner at a version is what the last edit up to it says."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{checkpoint_root(spark).rstrip('/')}/streetgrove/slot-map-{uuid.uuid4().hex}"
        self.schema = f"version int, {MAP}"

    def store(self, version: int, edits: dict[int, int]) -> None:
        """Writes one version; a version without edits writes no row."""
        rows = [(version, slot, shard) for slot, shard in sorted(edits.items())]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/v{version:06d}")

    def load(self, version: int) -> DataFrame:
        """(virtual_slot, shard) at ``version``; as many rows as there are slots."""
        edits = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/v{v:06d}" for v in range(version + 1)))
        return edits.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))

    def owners(self, version: int, slots: int = SLOTS) -> np.ndarray:
        found = np.zeros(slots, np.int64)
        for r in self.load(version).collect():
            found[r["virtual_slot"]] = r["shard"]
        return found


def balanced_map(rows: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[SlotMaps, int, np.ndarray]:
    """Stores version 0, even ranges, and version 1, rebalanced by the bytes of ``rows``; (maps, version, rows of every slot)."""
    weight, counts = slot_sums(rows, slots)
    maps, start = SlotMaps(rows.sparkSession, path), first_map(slots, shards)
    maps.store(0, dict(enumerate(start.tolist())))
    maps.store(1, rebalance(start, weight, shards))
    return maps, 1, counts


def place(rows: DataFrame, owner: Sequence[int], counts: np.ndarray) -> DataFrame:
    """``rows`` with shard and the gapless place ``slot`` in it: places before the virtual slot plus the number within it.

    No window is wider than a virtual slot, a few ten-thousandths of the rows, whatever the number of shards.
    """
    shard = np.asarray(owner, np.int64)
    base, ends = np.zeros(len(shard), np.int64), {}
    for k, s in enumerate(shard.tolist()):
        base[k] = ends.get(s, 0)
        ends[s] = int(base[k] + counts[k])
    # As many rows as there are slots.
    table = rows.sparkSession.createDataFrame(
        [(k, int(s), int(b)) for k, (s, b) in enumerate(zip(shard, base, strict=True))], "virtual_slot int, shard int, base long"
    )
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("number", number)
    return numbered.join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("base") + F.col("number") - 1).drop("base", "number")


def shard_documents(
    docs: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of every row."""
    rows = cut(records(docs, slots=slots, id_col=id_col, text_col=text_col), "shard-records")
    maps, version, counts = balanced_map(rows, shards=shards, slots=slots, path=path)
    placed = place(rows, maps.owners(version, slots), counts)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(version).alias("map_version"),
    )


def write_shards(docs: DataFrame, maps: SlotMaps, version: int, path: str, *, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """(doc_id, text) of every row under ``path/shard=N``; one scan, no shuffle, one file a task and shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.pmod(
            F.xxhash64(F.col(id_col).cast("long"), F.crc32(text.cast("binary")), (F.octet_length(text) + RECORD_BYTES).cast("long")), F.lit(slots)
        ).cast("int").alias("virtual_slot"),
    )
    # The map has as many rows as there are slots.
    rows.join(F.broadcast(maps.load(version)), "virtual_slot").select("doc_id", "text", "shard").write.partitionBy("shard").parquet(path)
