"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  # makes pa.compute there
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetgrove.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of text that a task hands to Python at once, where the session has Spark's default of 10000: texts can be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task and its Python worker hold of a table of texts; a setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of ``docs``; a null text is empty, other columns are left behind."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Identifiers up to this number go to the tasks by broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def without(docs: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``gone``; rows without doc_id stay."""
    ids = cut(gone.select(F.col("doc_id").alias("gone_id")).where("gone_id is not null").distinct(), label)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, docs["doc_id"] == ids["gone_id"], "left_anti")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``max_bytes`` in each, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
