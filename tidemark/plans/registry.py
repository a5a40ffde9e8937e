"""Query registry: a Spark callable, and where one exists the DuckDB statement it must equal."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.models import MODEL_CONF, MODEL_DEFAULT
from tidemark.operators.ordered import group_is_hot, hot_limit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


class Tables:
    """The parquet tables of one scale-factor folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._counts = spark, folder, {}

    def rows(self, name: str) -> int:
        """Row count of a table from the Parquet footers, read once for each query."""
        if name not in self._counts:
            self._counts[name] = getattr(self, name).count()
        return self._counts[name]

    def hot(self, *names: str, fanout: float = 1) -> bool | None:
        """False when the largest named table, times a known fan-out, cannot hold a hot group.

        None otherwise: the operator then measures its largest group itself.
        """
        bound = max(self.rows(n) for n in names) * fanout
        return False if bound <= hot_limit(self.spark) else None

    def one_hot(self, name: str, key: str) -> bool:
        """Whether the rows of one value of ``key`` are hot; measured once for each query, unless the whole table is not."""
        if (name, key) not in self._counts:
            self._counts[name, key] = self.hot(name) is not False and group_is_hot(getattr(self, name), [key])
        return self._counts[name, key]

    def large(self, *names: str, fanout: float = 1) -> bool | None:
        """False when no group can outgrow a task that fits models; None = measure."""
        limit = int(self.spark.conf.get(MODEL_CONF, str(MODEL_DEFAULT)))
        return False if max(self.rows(n) for n in names) * fanout <= limit else None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
