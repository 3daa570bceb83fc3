"""Queries run in a session of their own, where files that look small are not broadcast before their rows are counted."""

import random

from pyspark.sql import functions as F

from streetgrove.plans import registry
from streetgrove.session import BROADCAST_CONF, CHECKPOINT_CONF, measured_joins


def static_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_small_file_whose_rows_are_repeated_is_not_broadcast_unseen(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.random(), rng.random()) for k in range(20_000)]
    spark.createDataFrame(rows, "id long, x double, y double").repartition(1).write.parquet(str(tmp_path / "edges"))
    spark.range(2_000_000).write.parquet(str(tmp_path / "points"))
    before = dict(spark.conf.getAll)

    def query(t):
        edges = t.spark.read.parquet(str(tmp_path / "edges")).withColumn("cell", F.explode(F.sequence(F.col("id"), F.col("id") + 400)))
        return t.spark.read.parquet(str(tmp_path / "points")).join(edges, "id")

    try:
        registry.query("repeated_rows")(query)
        asked = query(registry.Tables(spark, str(tmp_path)))
        assert "BroadcastHashJoin" in static_plan(asked)
        found = registry.QUERIES["repeated_rows"](spark, str(tmp_path))
        assert "BroadcastHashJoin" not in static_plan(found)
    finally:
        registry.QUERIES.pop("repeated_rows", None)
        registry.MODULE_OF.pop("repeated_rows", None)
    assert dict(spark.conf.getAll) == before


def test_settings_of_the_caller_hold(spark):
    own = measured_joins(spark)
    assert own is measured_joins(spark) and own.conf.get(BROADCAST_CONF) == "65536"
    for limit, want in (("-1", "-1"), ("1k", "1024"), ("20MB", "65536")):
        spark.conf.set(BROADCAST_CONF, limit)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            own = measured_joins(spark)
            assert own.conf.get(BROADCAST_CONF) == want and own.conf.get("spark.sql.shuffle.partitions") == "7"
            assert spark.conf.get(BROADCAST_CONF) == limit
        finally:
            spark.conf.unset(BROADCAST_CONF)
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert measured_joins(spark).conf.get("spark.sql.shuffle.partitions") == "4"
    assert spark.conf.get(CHECKPOINT_CONF, None) == measured_joins(spark).conf.get(CHECKPOINT_CONF, None)
