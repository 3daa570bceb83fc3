"""Edit journal as a stream: keyed state per planting, idempotent by (run, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = "run_id long, target long, seq long, kind string, accepted boolean, late boolean"
STATE = "present boolean, last_seq long"
IDLE_MS = 7 * 24 * 3600 * 1000  # a planting that nobody edits so long is forgotten


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Decide the edits of one planting in order; only (present, last seq) is remembered.

    An edit older than one already decided is refused as late, so nothing that arrives goes without an answer. A
    repeated delivery looks the same; ``unique_edits`` takes those out before.
    """
    run_id, target = key
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values("seq").drop_duplicates("seq")
    present, last_seq = state.get if state.exists else (bool(rows["starts"].iloc[0]), -1)
    out = []
    for seq, kind in zip(rows["seq"], rows["kind"], strict=True):
        if seq <= last_seq:
            out.append((run_id, target, int(seq), kind, False, True))
            continue
        accepted = (not present) if kind == "add" else present
        out.append((run_id, target, int(seq), kind, bool(accepted), False))
        present = True if kind == "add" else False if kind == "delete" else present
        last_seq = int(seq)
    state.update((bool(present), int(last_seq)))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=["run_id", "target", "seq", "kind", "accepted", "late"])


def decisions(edits: DataFrame) -> DataFrame:
    """Streaming ``edits(run_id, target, seq, kind, starts)`` to accepted and refused edits.

    State is kept per planting and not per run: the plan of a large street never has to fit in
    one task, and a busy run is spread over all of them.
    """
    return edits.groupBy("run_id", "target").applyInPandasWithState(_decide, DECISIONS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def unique_edits(edits: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of (run, seq) that arrive within the watermark."""
    return edits.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["run_id", "seq"])


def stage_load(stages: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Live view of the run log: time per stage in tumbling windows, late rows within the watermark."""
    return (
        stages.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "stage")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"))
        .select(F.col("w.start").alias("start"), "stage", "n", "ms")
    )
