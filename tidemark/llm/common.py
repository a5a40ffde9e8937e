"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    A column used inside a lambda would otherwise be inlined into it and evaluated for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one struct, so that none can clash with the columns of an operator."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name)
