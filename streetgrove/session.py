"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import suppress
from weakref import WeakKeyDictionary

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BROADCAST_CONF = "spark.sql.autoBroadcastJoinThreshold"
MEASURED_CONF = "spark.sql.adaptive.autoBroadcastJoinThreshold"
SMALL_FILE = 64 << 10  # bytes of a file that may be broadcast before its rows are counted


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "streetgrove") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STREETGROVE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


_beside: WeakKeyDictionary[SparkSession, SparkSession] = WeakKeyDictionary()


def measured_joins(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings, where a join broadcasts a table for its measured size and not for that of its files.

    Files are compressed, and their rows are repeated over cells before they are joined; the driver holds what is broadcast. So only
    tables of ``SMALL_FILE`` are broadcast unseen, others up to the limit of ``spark`` once they are counted. ``spark`` is left as it is.
    """
    own = _beside.get(spark)
    if own is None:
        own = _beside[spark] = spark.newSession()
    asked = spark.conf.getAll
    for key, value in asked.items():
        if key not in (BROADCAST_CONF, MEASURED_CONF) and own.conf.get(key, None) != value:
            with suppress(PySparkException):  # what a session may not set holds for all of them
                own.conf.set(key, value)
    limit = spark.conf.get(BROADCAST_CONF)
    own.conf.set(BROADCAST_CONF, str(min(_bytes(limit), SMALL_FILE)))
    own.conf.set(MEASURED_CONF, asked.get(MEASURED_CONF, limit))
    return own


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch folder only on a local master."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


class Growing:
    """Rows that are added round by round. Each round is written once to the shared folder; all rounds are read by one
    scan, so the plan does not grow with their number."""

    def __init__(self, label: str = "rounds") -> None:
        self.label, self.path, self.last, self.rounds = label, "", None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        spark = df.sparkSession
        self.path = self.path or f"{checkpoint_root(spark).rstrip('/')}/streetgrove/{self.label}-{uuid.uuid4().hex}"
        part = f"{self.path}/round{self.rounds:06d}"
        df.write.parquet(part)
        self.rounds += 1
        self.last = spark.read.schema(df.schema).parquet(part)
        return self.last

    def all(self) -> DataFrame:
        """Every row added so far."""
        return self.last.sparkSession.read.schema(self.last.schema).option("recursiveFileLookup", True).parquet(self.path)


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    One durable columnar copy cuts the lineage of iterative jobs and survives the loss of
    executors. Unlike a reliable RDD checkpoint the plan is computed once, not twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/streetgrove/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
