"""Resampling: summaries over bootstrap replicates, permutations and subsamples as hash-ordered keys."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import hash32
from tidemark.functions.scalars import substitution_ratio
from tidemark.operators.ordered import row_numbers, same_group


def replicated(df: DataFrame, n: int, name: str = "replicate") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def interval(df: DataFrame, keys: Sequence[str], value: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval over replicates (a design constant per key)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("se"),
                                 F.percentile(value, F.lit(lo)).alias("ci_lo"),
                                 F.percentile(value, F.lit(hi)).alias("ci_hi"),
                                 two_sided(F.col(value)).alias("p"), F.count(value).alias("n_replicates"))


def two_sided(d: Column) -> Column:
    """Twice the smaller tail share of the replicates, at most 1."""
    below = F.avg(F.when(d.isNotNull(), (d <= 0).cast("double")))
    above = F.avg(F.when(d.isNotNull(), (d >= 0).cast("double")))
    return F.least(F.lit(1.0), 2 * F.least(below, above))


def arm_difference(aucs: DataFrame, keys: Sequence[str], a: str, b: str, value: str = "auc") -> DataFrame:
    pick = lambda x: F.max(F.when(F.col("arm") == x, F.col(value)))
    return aucs.groupBy(*keys, "replicate").agg((pick(a) - pick(b)).alias("d"))


def ratio_replicates(total: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, replicate, rho) from two bootstrap AUC tables over overlapping samples."""
    m = matched.select(*keys, "replicate", F.col("auc").alias("__m"))
    return same_group(total, m, [*keys, "replicate"]).select(
        *keys, "replicate", substitution_ratio(F.col("auc"), F.col("__m")).alias("rho"))


def permuted(df: DataFrame, keys: Sequence[str], sid: str, carry: Sequence[str], n: int, seed: str,
             hot: bool | None = None) -> DataFrame:
    """Rows under ``n`` permutations: ``carry`` columns move together to another row's place."""
    keys = list(keys)
    place = row_numbers(df.drop(*carry), keys, [sid], "__i", hot)
    moved = replicated(df.select(*keys, sid, *carry), n, "perm").withColumn(
        "__h", hash32(seed, F.col("perm"), F.col(sid)))
    moved = row_numbers(moved, [*keys, "perm"], ["__h", sid], "__i", hot).drop("__h", sid)
    # Places are joined before they are copied; copies are no larger to Spark's estimate than their source, and would be sent to every task.
    return same_group(moved, place.hint("merge"), [*keys, "__i"]).select(*place.drop("__i").columns, "perm", *carry)


def permutation_p(null: DataFrame, observed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One-sided p against the null with its floor 1/(n+1)."""
    obs = observed.select(*keys, F.col(value).alias("observed"))
    j = same_group(null, obs, list(keys))
    n = F.count(value)
    return j.groupBy(*keys, "observed").agg(
        n.alias("n_perm"), F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"),
        ((1 + F.count_if(F.col(value) >= F.col("observed"))) / (n + 1)).alias("p_perm"),
        (1 / (n + 1)).alias("p_floor"))


def subsampled(df: DataFrame, keys: Sequence[str], sid: str, y: str, quota: DataFrame, n_draws: int,
               seed: str, hot: bool | None = None) -> DataFrame:
    """Draws without replacement: the first ``take`` of each class in the draw's hash order.

    ``quota`` has (keys, y, take).
    """
    keys = list(keys)
    rows = replicated(df, n_draws, "draw").withColumn("__h", hash32(seed, F.col("draw"), F.col(sid)))
    ranked = row_numbers(rows, [*keys, "draw", y], ["__h", sid], "__rn", hot)
    return same_group(ranked, quota.select(*keys, y, "take"), [*keys, y]).filter(
        F.col("__rn") <= F.col("take")).drop("__rn", "__h", "take")


def balanced_quota(counts: DataFrame, sizes: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """(keys, size, y, take): class sizes of a subsample that keeps the class balance.

    ``counts`` has (keys, n_pos, n_neg); sizes at or above the whole sample take all of it.
    """
    j = counts.crossJoin(F.broadcast(sizes))
    whole = F.col("n_pos") + F.col("n_neg")
    pos = F.greatest(F.lit(2), F.rint(F.col("size") * F.col("n_pos") / whole).cast("bigint"))
    neg = F.greatest(F.lit(2), F.col("size") - pos)
    full = F.col("size") >= whole
    take = F.create_map(F.lit(1), F.when(full, F.col("n_pos")).otherwise(F.least(pos, F.col("n_pos"))),
                        F.lit(0), F.when(full, F.col("n_neg")).otherwise(F.least(neg, F.col("n_neg"))))
    return j.select(*keys, "size", F.explode(take).alias(y, "take"))
