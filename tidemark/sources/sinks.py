"""Sinks: feature cube, spine, report, incremental append, merge by key, class-wise manifest."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import finite


def write_cube(df: DataFrame, path: str, cond: str = "cond") -> None:
    """One folder per condition, so a reader of one condition touches only its files."""
    df.write.mode("overwrite").partitionBy(cond).parquet(path)


def read_cube(spark: SparkSession, path: str, conds: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if conds is None else df.filter(F.col("cond").isin(list(conds)))


def with_flags(df: DataFrame) -> DataFrame:
    """Derived label flags are always recomputed, never stored."""
    return df.withColumns({"impaired": F.col("label").isin(dims.IMPAIRED).cast("int"),
                           "in_screening": F.col("label").isin(dims.SCREENING).cast("int")})


def write_spine(df: DataFrame, path: str) -> None:
    df.drop("impaired", "in_screening").write.mode("overwrite").parquet(path)


def load_spine(spark: SparkSession, path: str) -> DataFrame:
    return with_flags(spark.read.parquet(path))


def clean(df: DataFrame) -> DataFrame:
    """Non-finite doubles become null in every floating column."""
    return df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def as_json(df: DataFrame, keys: Sequence[str], name: str = "report") -> DataFrame:
    """Keys plus one JSON document of the remaining columns, nulls kept."""
    cols = [c for c in df.columns if c not in keys]
    return clean(df).select(*keys, F.to_json(
        F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))


def append_new(spark: SparkSession, src: DataFrame, path: str, key: str, measure) -> DataFrame:
    """Measure only keys the sink does not hold yet and append them; returns the sink."""
    done = spark.read.parquet(path).select(key)
    todo = src.join(done, key, "left_anti")
    measure(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows of the same key; all other old rows stay."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def write_classes(df: DataFrame, path: str, cls: str, sid: str) -> DataFrame:
    """Class-wise copy; returns the manifest sorted by (class, id)."""
    df.write.mode("overwrite").partitionBy(cls).parquet(path)
    return df.orderBy(cls, sid)
