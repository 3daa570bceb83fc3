"""Registry of queries: a callable on (spark, sf_dir) and, where SQL can say it, checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streetgrove.plans import fixtures
from streetgrove.session import measured_joins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}


class Tables:
    """Lazy access to base and canonical tables: ``t.points``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)


def query(name: str, *, sql: str | None = None, uses: tuple[str, ...] = (), extra: str = "", recursive: bool = False):
    """Register ``fn(t: Tables) -> DataFrame``; ``sql`` may name the canonical tables in ``uses``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(measured_joins(spark), sf_dir))
        MODULE_OF[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            parts = [p for p in (fixtures.ctes(*uses) if uses else "", extra.strip().rstrip(",")) if p]
            prefix = ("with " + ("recursive " if recursive else "") + ",\n".join(parts) + "\n") if parts else ""
            body = sql.strip()
            if prefix and body.lower().startswith("with "):
                prefix, body = prefix.rstrip() + ",\n", body[5:]
            ORACLES[name] = prefix + body
        return fn

    return add
