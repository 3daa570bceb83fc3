"""Ordered scans that no single task has to hold: distributed prefix sums and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetgrove.session import Growing, cut


def prefix_sum(df: DataFrame, value: Column | str, *, by: Sequence[str], order: Sequence[str], name: str = "running") -> DataFrame:
    """Running total of ``value`` within ``by`` in ``order`` (inclusive), whatever the size of a group.

    Rows are range-partitioned on (by, order), so a hot group is spread over many tasks. Each
    block sums itself, the few block totals are accumulated, and the offset is added back.
    ``order`` must make rows unique within ``by``.
    """
    blocks = cut(
        df.withColumn("_v", value if isinstance(value, Column) else F.col(value))
        .repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id()),
        "blocks",
    )
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*by, "_block").agg(F.sum("_v").alias("_t")).withColumn("_offset", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    return (
        blocks.withColumn("_local", F.sum("_v").over(inside)).join(totals, [*by, "_block"])
        .withColumn(name, F.col("_local") + F.col("_offset")).drop("_v", "_block", "_local", "_offset")
    )


def top_k(df: DataFrame, k: int, *, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark cuts each task to ``k`` rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


BUCKETS = 1024  # parts that a range of values is narrowed to at once


def order_statistics(rows: DataFrame, value: str, shares: Sequence[float], *, by: Sequence[str]) -> DataFrame:
    """(by..., n, q0, q1, ...): exact interpolated quantiles of ``value`` per group, no group's values held anywhere.

    A rank is narrowed down from range to range: rows count themselves by ``BUCKETS`` parts of the range that still holds the
    rank (combined before the shuffle), the part with the rank is found in the running total of these counts, and its own
    least and greatest value are the next range. It ends where a range is one value or two rows. Null and NaN do not count.
    """
    by = list(by)
    known = cut(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v")), "values")
    sizes = cut(known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "sizes")
    asked = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(s) * (F.col("n") - 1)), F.ceil(F.lit(s) * (F.col("n") - 1))) for s in shares])))
    state = sizes.withColumn("_rank", F.explode(asked)).select(*by, "_rank", F.lit(0).cast("long").alias("_base"), F.col("n").alias("_n"), "_low", "_high")
    settled = (F.col("_low") == F.col("_high")) | (F.col("_n") <= 2)
    found = Growing("ranks")
    while True:
        state = cut(state, "ranges")
        answer = F.when((F.col("_n") == 2) & (F.col("_rank") > F.col("_base")), F.col("_high")).otherwise(F.col("_low"))
        found.add(state.where(settled).select(*by, "_rank", answer.alias("_value")))
        state = state.where(~settled)
        if state.isEmpty():
            break
        ranges = state.select(*by, "_low", "_high").distinct()
        part = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * BUCKETS)).cast("int")
        inside = known.join(ranges, by).where(F.col("_v").between(F.col("_low"), F.col("_high"))) if by else known.crossJoin(ranges).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        counts = inside.groupBy(*by, "_low", "_high", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = Window.partitionBy(*by, "_low", "_high").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        offset = F.col("_rank") - F.col("_base")
        state = state.drop("_n").join(counts, [*by, "_low", "_high"]).where((offset >= F.col("_before")) & (offset < F.col("_before") + F.col("_c"))).select(
            *by, "_rank", (F.col("_base") + F.col("_before")).alias("_base"), F.col("_c").alias("_n"), F.col("_a").alias("_low"), F.col("_b").alias("_high"))
    ranks = found.all().groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_of"))  # two ranks a share at most
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    low, high = [F.col("_of")[F.floor(a)] for a in at], [F.col("_of")[F.ceil(a)] for a in at]
    values = [(p + (q - p) * (a - F.floor(a))).alias(f"q{k}") for k, (a, p, q) in enumerate(zip(at, low, high, strict=True))]
    return (sizes.join(ranks, by) if by else sizes.crossJoin(ranks)).select(*by, "n", *values)
