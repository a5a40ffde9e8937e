"""Joins the study needs beyond plain equality: nearest, pinned, paired, verified."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import neighbours, same_group


def nearest_site(targets: DataFrame, grid: DataFrame, coords: Sequence[str],
                 target: str = "target", site: str = "site") -> DataFrame:
    """Nearest grid site of every target in Euclidean distance; the grid is a fixed electrode map.

    The map (about a hundred sites) is a constant, so every target row is compared with it in
    place: no shuffle and no pair is written out.
    """
    sites = grid.agg(F.collect_list(F.struct(F.col(site), *coords)).alias("__grid"))
    dist = lambda g: F.sqrt(sum((g[c] - F.col(c)) * (g[c] - F.col(c)) for c in coords))
    best = F.array_min(F.transform("__grid", lambda g: F.struct(
        dist(g).alias("distance"), g[site].alias("site"))))
    return (targets.crossJoin(F.broadcast(sites)).withColumn("__b", best)
            .select(target, F.col("__b.site").alias("site"), F.col("__b.distance").alias("distance")))


def nearest_value(df: DataFrame, keys: Sequence[str], value: str, is_ref: str, caliper: float,
                  hot: bool | None = None) -> DataFrame:
    """For every non-reference row the nearest reference value within the caliper.

    Both sides are sorted once and the last reference value before and after is carried along, so
    the cost is linear; the pairs inside the caliper are never enumerated. On equal distance the
    lower reference value is taken.
    """
    rows = neighbours(df.filter(F.col(value).isNotNull()), keys, value, is_ref, hot)
    low = F.when(F.col(value) - F.col("lo") <= caliper, F.col("lo"))
    high = F.when(F.col("hi") - F.col(value) <= caliper, F.col("hi"))
    pick = (F.when(low.isNull(), high).when(high.isNull(), low)
            .when(F.col(value) - low <= high - F.col(value), low).otherwise(high))
    return (rows.filter(F.col(is_ref) == 0).withColumn("nearest", pick)
            .withColumn("distance", F.abs(F.col(value) - F.col("nearest"))).drop("lo", "hi"))


def pinned(windows: DataFrame, offsets: DataFrame, rec: str, start: str, length: int,
           total: DataFrame) -> DataFrame:
    """Windows at offsets chosen in another arm; offsets that run past the end are dropped."""
    ok = offsets.join(total, rec).filter(F.col(start) + length <= F.col("n_samples"))
    return windows.join(ok.select(rec, start), [rec, start])


def complete_cases(df: DataFrame, subject: str | Sequence[str], arm: str, arms: DataFrame) -> DataFrame:
    """Rows of subjects present in every arm; a subject may be named by several columns."""
    subject = [subject] if isinstance(subject, str) else list(subject)
    n_arms = arms.select(arm).distinct().agg(F.count("*").alias("__n"))
    full = (df.select(*subject, arm).distinct().groupBy(*subject).agg(F.count("*").alias("__k"))
            .crossJoin(F.broadcast(n_arms)).filter("__k = __n").select(*subject))
    return same_group(df, full, subject)


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str,
           by: Sequence[str] = ()) -> DataFrame:
    """Compare two cubes cell by cell: rows on one side only, largest difference, null masks."""
    left = a.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__in_a"))
    right = b.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__in_b"))
    j = left.join(right, list(keys), "full_outer")
    return j.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("__in_b").isNull()).alias("only_a"),
        F.count_if(F.col("__in_a").isNull()).alias("only_b"),
        F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_abs_diff"),
        F.bool_and(F.col("__a").isNull() == F.col("__b").isNull()).alias("same_nulls"))


def verified(recorded: DataFrame, current: DataFrame, name: str = "name") -> DataFrame:
    """Recorded against recomputed text values: match, drifted, vanished or new."""
    j = (recorded.withColumnRenamed("value", "stated")
         .join(current.withColumnRenamed("value", "current"), name, "full_outer"))
    return j.withColumn("status", F.when(F.col("current").isNull(), "vanished")
                        .when(F.col("stated").isNull(), "new")
                        .when(F.col("stated") == F.col("current"), "match").otherwise("drifted"))


def pair_counts(rows: DataFrame, subject: str, arm: str, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Subjects present in both arms of every declared pair.

    A row is sent to the pairs its arm belongs to and counted there, so arms are not joined to
    each other. ``pairs`` has (a, b); ``rows`` holds a subject at most once per arm and ``keys``.
    """
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias(arm))
    hit = rows.select(*keys, subject, arm).join(F.broadcast(sides), arm).groupBy("a", "b", *keys, subject).agg(
        F.count("*").alias("__k"))
    return hit.filter("__k = 2").groupBy("a", "b", *keys).agg(F.count("*").alias("n_pairs"))
