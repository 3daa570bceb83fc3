"""Edit journal and run log: batch replay and the same logic for the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(edits: DataFrame) -> DataFrame:
    """Each (run, seq) counts once however often it is delivered."""
    return edits.dropDuplicates(["run_id", "seq"])


def replay(edits: DataFrame, exists_at_start: Column) -> DataFrame:
    """Apply edits in sequence per planting and mark each as accepted or refused.

    Whether a planting exists before an edit is decided by the last add or delete before it: an
    add always leaves it present and a delete always leaves it absent, accepted or not. So no
    state is carried by hand, and one planting's edits are all a task has to order.
    """
    w = Window.partitionBy("run_id", "target").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("kind") == "add", True).when(F.col("kind") == "delete", False)
    present = F.coalesce(F.last(turn, ignorenulls=True).over(before), exists_at_start)
    accepted = F.when(F.col("kind") == "add", ~present).otherwise(present)
    return edits.withColumn("present", present).withColumn("accepted", accepted)


def marks(replayed: DataFrame, exists_at_start: Column) -> DataFrame:
    """One net mark per planting: add, move or delete, with first origin and last position.

    An added planting that is deleted again leaves no mark; a planting deleted and added anew is
    a move of the planting that stood there.
    """
    done = replayed.where("accepted")
    placed = F.col("kind").isin("add", "move")
    folded = done.groupBy("run_id", "target").agg(
        F.max_by("kind", "seq").alias("last_kind"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.max_by(F.when(placed, F.col("position")), F.when(placed, F.col("seq"))).alias("position"), F.count(F.lit(1)).alias("edits"),
    )
    now = F.col("last_kind") != "delete"
    mark = (
        F.when(exists_at_start & now, "move").when(exists_at_start & ~now, "delete").when(~exists_at_start & now, "add")
    )
    return folded.withColumn("mark", mark).where(F.col("mark").isNotNull()).withColumn("position", F.when(F.col("mark") != "delete", F.col("position")))
