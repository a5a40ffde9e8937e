"""Tumbling windows over long samples(rec, channel, t, x): cut, reject, sample, summarise."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.draws import digest
from tidemark.session import stored


def windowed(samples: DataFrame, length: int) -> DataFrame:
    """Add ``win`` = t div length."""
    return samples.withColumn("win", F.floor(F.col("t") / length))


def window_stats(samples: DataFrame, length: int) -> DataFrame:
    """(rec, win, channel, n, ptp, mean, sd) of every window, complete or not."""
    return windowed(samples, length).groupBy("rec", "win", "channel").agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("ptp"),
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def full_windows(samples: DataFrame, length: int) -> DataFrame:
    """Statistics of complete windows; the tail is dropped."""
    return window_stats(samples, length).filter(F.col("n") == length)


def window_ptp(samples: DataFrame, length: int) -> DataFrame:
    """(rec, win, ptp, k): peak-to-peak of the worst of the k channels.

    Only windows in which every channel of the recording is complete are kept: a recording is cut
    as a whole, so its shortest channel sets the last window. The samples are read once; the
    per-window statistics, a thousandth of their size at 1024 samples, are written and reused.
    """
    stats = stored(window_stats(samples, length).select("rec", "win", "channel", "n", "ptp"), "stats")
    need = stats.groupBy("rec").agg(F.count_distinct("channel").alias("need"))
    per = stats.filter(F.col("n") == length).groupBy("rec", "win").agg(
        F.max("ptp").alias("ptp"), F.count("*").alias("k"))
    return per.join(need, "rec").filter("k = need").select("rec", "win", "ptp", "k")


def accepted(ptp: DataFrame, limit: float, fallback: int) -> DataFrame:
    """Windows at or under the limit; if a recording has none, its ``fallback`` quietest.

    Adds n_windows, n_ok and rejected per recording. The fallback is a row_number limit, which
    Spark applies inside every task before the shuffle, so a long recording is not sorted whole.
    """
    ok = (F.col("ptp") <= limit)
    per = ptp.groupBy("rec").agg(F.count("*").alias("n_windows"), F.count_if(ok).alias("n_ok"))
    rows = ptp.join(per, "rec")
    kept = rows.filter(ok)
    order = F.row_number().over(W.partitionBy("rec").orderBy("ptp", "win"))
    quiet = (rows.filter("n_ok = 0").withColumn("__k", order)
             .filter(F.col("__k") <= fallback).drop("__k"))
    out = kept.unionByName(quiet)
    return out.withColumn("rejected", F.when(F.col("n_ok") > 0, F.col("n_windows") - F.col("n_ok"))
                          .otherwise(F.col("n_windows") - F.least("n_windows", F.lit(fallback))))


def sampled(windows: DataFrame, quota: int, keys: tuple = ("rec",)) -> DataFrame:
    """At most ``quota`` windows per recording in hash order; the same set in any partitioning."""
    h = windows.withColumn("__h", digest(*[F.col(k) for k in keys], F.col("win")))
    k = F.row_number().over(W.partitionBy(*keys).orderBy("__h"))
    return h.withColumn("__k", k).filter(F.col("__k") <= quota).drop("__k", "__h")


def matrices(samples: DataFrame, kept: DataFrame | None, length: int) -> DataFrame:
    """(rec, win, channels, xs): a kept window (None: any window) as one row, samples in (channel, time) order.

    One shuffle; the group is one window, bounded by electrodes times window length.
    """
    rows = windowed(samples, length)
    if kept is not None:
        rows = rows.join(kept.select("rec", "win"), ["rec", "win"], "left_semi")
    cells = F.array_sort(F.collect_list(F.struct("channel", "t", "x")))
    return rows.groupBy("rec", "win").agg(
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.transform(cells, lambda s: s["x"]).alias("xs"))


def standardised(samples: DataFrame, length: int) -> DataFrame:
    """(x − mean) / (population sd + 1e-8) inside each window and channel; groups are one window."""
    w = W.partitionBy("rec", "win", "channel")
    return windowed(samples, length).withColumn(
        "z", (F.col("x") - F.avg("x").over(w)) / (F.stddev_pop("x").over(w) + 1e-8))


def subject_scores(scored: DataFrame, subject: str, score: str) -> DataFrame:
    return scored.groupBy(subject).agg(F.avg(score).alias(score), F.count("*").alias("n_windows"))


def quota_grid(spark) -> DataFrame:
    return dims.table(spark, list(dims.SHORT_QUOTAS.items()), "cond, quota")


def sampled_by_condition(windows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Hash sample under every quota at once: the k-th window serves each quota of k or more."""
    top = max(dims.SHORT_QUOTAS.values())
    h = windows.withColumn("__h", digest(F.col("rec"), F.col("win")))
    k = F.row_number().over(W.partitionBy("rec").orderBy("__h"))
    ranked = h.withColumn("__k", k).filter(F.col("__k") <= top)
    return ranked.join(F.broadcast(quotas), F.col("__k") <= F.col("quota")).drop("__k", "__h")
