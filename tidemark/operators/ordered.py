"""Ordered computations that stay distributed when one group is huge.

A window over a group runs in one task. Each entry point measures its largest group first. Below the
limit the plain window is used; above it the input is stored once and range-sorted by group and order,
every range is scanned on its own, and the totals of a group's earlier ranges (one row for each group and
range) are carried in. Ranges split a group anywhere, also among ties of the leading columns, whatever
their type. Both ways give the same rows: null keys are a group, and a sum is null until its first value.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import stored

HOT_CONF = "spark.tidemark.hotGroupRows"
HOT_DEFAULT = 2_000_000
#: Rows from which a group has a task of its own where several sorts of it are held at once.
OWN_TASK_ROWS = 100_000


def hot_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_CONF, str(HOT_DEFAULT)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group; one partial aggregate, one number to the driver."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def group_is_hot(df: DataFrame, keys: Sequence[str], hot: bool | None = None) -> bool:
    """The caller's answer if it has one, else measured."""
    return hot if hot is not None else largest_group(df, keys) > hot_limit(df.sparkSession)


def apart(df: DataFrame, keys: Sequence[str], hot: bool | None = None) -> tuple[bool, DataFrame]:
    """Whether a group is hot, and the rows by group, so that large groups do not share a task.

    A plan that sorts its groups by several orders keeps them all in the task at once, and small partitions are merged by their
    bytes in the shuffle, which are fewer. Ranges of the keys never split a group. Without a count (``hot`` given) rows stay as they are.
    """
    if hot is not None or not keys:
        return group_is_hot(df, keys, hot), df
    most, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) > hot_limit(df.sparkSession):
        return True, df
    n = -(-(total or 0) // OWN_TASK_ROWS)
    return False, df.repartitionByRange(n, *keys) if n > 1 else df


def same_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the columns of ``left`` come first, keys once."""
    if not keys:
        return left.crossJoin(right)
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"__r_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def _ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df``, evaluated once, with ``__range``: numbers that follow ``keys`` and ``order``."""
    rows = stored(df, "rows")
    n = max(2, -(-rows.count() // hot_limit(df.sparkSession)))
    spread = rows.repartitionByRange(n, *keys, *order)
    return stored(spread.withColumn("__range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            values: Mapping[str, Column], hot: bool | None = None, how: str = "sum") -> DataFrame:
    """Inclusive running sums (or maxima) in ``order`` within ``keys``; the order must be total.

    A null value adds nothing; the result is null before the first value.
    """
    keys = list(keys)
    fn = {"sum": F.sum, "max": F.max}[how]
    to_row = (W.unboundedPreceding, W.currentRow)
    if not group_is_hot(df, keys, hot):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(*to_row)
        return df.withColumns({name: fn(e).over(w) for name, e in values.items()})
    cut = _ranges(df, keys, order)
    part = [*keys, "__range"]
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(*to_row)
    local = cut.withColumns({name: fn(e).over(w) for name, e in values.items()})
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (cut.groupBy(*part).agg(*[fn(e).alias(f"__t_{n}") for n, e in values.items()])
               .select(*part, *[fn(f"__t_{n}").over(before).alias(f"__o_{n}") for n in values]))
    joined = same_group(local, offsets, part)
    if how == "sum":
        carried = {n: F.coalesce(F.col(f"__o_{n}") + F.col(n), f"__o_{n}", n) for n in values}
    else:
        carried = {n: F.greatest(f"__o_{n}", n) for n in values}
    return joined.withColumns(carried).drop("__range", *[f"__o_{n}" for n in values])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
                hot: bool | None = None) -> DataFrame:
    """1-based position in ``order`` within ``keys``."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, hot)


def histogram(df: DataFrame, keys: Sequence[str], value: str,
              sums: Mapping[str, Column]) -> DataFrame:
    """Collapse ties: one row per distinct value, so a repeated value costs one row."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(*[F.sum(e).alias(n) for n, e in sums.items()]))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float],
              hot: bool | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, nulls skipped."""
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull())
    is_hot = group_is_hot(df, keys, hot)
    if not is_hot:
        return df.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(float(q))).alias(n) for n, q in qs.items()])
    hist = stored(histogram(df, keys, value, {"__n": F.lit(1)}), "histogram")
    cum = running(hist, keys, [value], {"__c": F.col("__n")})
    cum = same_group(cum, hist.groupBy(*keys).agg(F.sum("__n").alias("__total")), keys)
    aggs = []
    for i, q in enumerate(qs.values()):
        pos = (F.col("__total") - 1) * F.lit(float(q))
        aggs += [F.min(F.when(F.col("__c") > F.floor(pos), F.col(value))).alias(f"__lo{i}"),
                 F.min(F.when(F.col("__c") > F.ceil(pos), F.col(value))).alias(f"__hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"__f{i}")]
    out = cum.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"__lo{i}") * (1 - F.col(f"__f{i}")) + F.col(f"__hi{i}") * F.col(f"__f{i}")).alias(n)
        for i, n in enumerate(qs)])


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str,
            hot: bool | None = None) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, hot)


def counts_through(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column],
                   hot: bool | None = None) -> DataFrame:
    """Per row, for each weight: total at smaller values plus half the total at its own value.

    Rows keep their identity; ``value`` must not be null.
    """
    keys = list(keys)
    is_hot = group_is_hot(df, keys, hot)
    if not is_hot:
        upto = (W.partitionBy(*keys).orderBy(value)
                .rangeBetween(W.unboundedPreceding, W.currentRow))
        tie = W.partitionBy(*keys, value)
        return df.withColumns({n: F.sum(e).over(upto) - F.sum(e).over(tie) / 2
                               for n, e in sums.items()})
    df = stored(df, "rows")
    hist = stored(histogram(df, keys, value, {f"__h_{n}": e for n, e in sums.items()}), "histogram")
    cum = running(hist, keys, [value], {f"__c_{n}": F.col(f"__h_{n}") for n in sums})
    placed = cum.select(*keys, value, *[
        (F.col(f"__c_{n}") - F.col(f"__h_{n}") / 2).alias(n) for n in sums])
    return same_group(df, placed, [*keys, value])


def midranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "midrank",
             hot: bool | None = None) -> DataFrame:
    """Average rank of tied values, 1-based."""
    out = counts_through(df, keys, value, {name: F.lit(1)}, hot)
    return out.withColumn(name, F.col(name) + 0.5)


def neighbours(df: DataFrame, keys: Sequence[str], value: str, is_ref: str,
               hot: bool | None = None) -> DataFrame:
    """Add lo and hi: the closest reference values at or below and at or above each row's value.

    A row without a value has neither. Both sides are sorted together once; pairs are never enumerated.
    """
    keys = list(keys)
    ref = F.when(F.col(is_ref) == 1, F.col(value))
    if not group_is_hot(df, keys, hot):
        # Spark adds up a frame that only grows; one that ends at the group's last row is read again for every row.
        w = W.partitionBy(*keys)
        so_far = (W.unboundedPreceding, W.currentRow)
        known = F.col(value).isNotNull()
        return df.withColumns({
            "lo": F.when(known, F.max(ref).over(w.orderBy(F.asc(value)).rangeBetween(*so_far))),
            "hi": F.when(known, F.min(ref).over(w.orderBy(F.desc(value)).rangeBetween(*so_far)))})
    # Distinct values carry the running maximum of the references; the mirror image gives hi.
    df = stored(df, "rows")
    vals = stored(df.groupBy(*keys, value).agg(F.max(ref).alias("__r")).withColumn("__neg", -F.col(value)), "values")
    up = running(vals, keys, [value], {"lo": F.col("__r")}, how="max")
    down = running(vals, keys, ["__neg"], {"__m": -F.col("__r")}, how="max")
    both = same_group(up.select(*keys, value, "lo"), down.select(*keys, value, (-F.col("__m")).alias("hi")), [*keys, value])
    return same_group(df, both, [*keys, value])
