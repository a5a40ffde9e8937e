"""Recording quality: units, live channels, amplitude guard, robust scale, block structure."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import Z95_FULL, finite
from tidemark.operators.ordered import group_is_hot, medians, quantiles, same_group
from tidemark.session import stored

UNIT_LIMIT, UNIT_FACTOR, FLAT_SD = 1e-3, 1e-6, 1e-15


def channel_levels(samples: DataFrame, hot: bool | None = None) -> DataFrame:
    """(rec, channel, med_abs): median of |x|."""
    return medians(samples.withColumn("__a", F.abs("x")), ["rec", "channel"], "__a", "med_abs", hot)


def units(samples: DataFrame, limit: float = UNIT_LIMIT, hot: bool | None = None) -> DataFrame:
    """Per recording: level over live channels, the unit factor it implies, and channel warnings."""
    lv = channel_levels(samples, hot)
    live = F.when(F.col("med_abs") > 0, F.col("med_abs"))
    per = lv.groupBy("rec").agg(F.coalesce(F.percentile(live, 0.5), F.lit(0.0)).alias("median_abs"),
                                F.count("*").alias("n_channels"),
                                F.count_if(F.col("med_abs") > 0).alias("n_live"))
    return per.withColumns({
        "unit_factor": F.when(F.col("median_abs") > limit, UNIT_FACTOR).otherwise(1.0),
        "low_density": F.col("n_live") < 0.5 * F.col("n_channels")})


def flat_channels(samples: DataFrame, limit: float = FLAT_SD) -> DataFrame:
    sd = samples.groupBy("rec", "channel").agg(F.stddev_pop("x").alias("sd"))
    return sd.groupBy("rec").agg(F.count("*").alias("n_channels"),
                                 F.count_if(F.col("sd") < limit).alias("n_flat"))


def amplitude_ratio(before: DataFrame, after: DataFrame, lo: float = 0.05, hi: float = 20.0,
                    halt: bool = True, hot: bool | None = None) -> DataFrame:
    """Median |x| after over before per recording; outside [lo, hi] the job stops or flags."""
    def level(df, name):
        return medians(df.withColumn("__a", F.abs("x")), ["rec"], "__a", name, hot)
    j = same_group(level(before, "before"), level(after, "after"), ["rec"], "left")
    ratio = F.when(F.col("before") > 0, F.coalesce("after", F.lit(0.0)) / F.col("before"))
    j = j.withColumn("ratio", ratio)
    bad = (F.col("ratio") < lo) | (F.col("ratio") > hi)
    if halt:
        msg = F.concat(F.lit("amplitude collapsed in recording "), F.col("rec").cast("string"))
        return j.withColumn("ok", F.when(bad, F.raise_error(msg).cast("boolean")).otherwise(True))
    return j.withColumn("ok", ~F.coalesce(bad, F.lit(False)))


def robust_scaled(samples: DataFrame, keys: Sequence[str], hot: bool | None = None) -> DataFrame:
    """(x − median) / IQR with the given scope; an undefined result is 0."""
    q = quantiles(samples, keys, "x", {"__q1": 0.25, "__med": 0.5, "__q3": 0.75}, hot)
    iqr = F.col("__q3") - F.col("__q1")
    out = same_group(samples, q, list(keys)).withColumn(
        "scaled", F.coalesce(F.when(iqr != 0, finite((F.col("x") - F.col("__med")) / iqr)), F.lit(0.0)))
    return out.drop("__q1", "__med", "__q3")


def longest_recording(recs: DataFrame, subject: str, order: str, n: str, min_n: int) -> DataFrame:
    """One row per subject: its longest recording; first positive age and known sex over all rows."""
    return recs.groupBy(subject).agg(
        F.max_by(order, F.struct(F.col(n), (-F.col(order)).alias("o"))).alias("row"),
        F.max(n).alias("n_samples"),
        F.min_by(F.when(F.col("age") > 0, F.col("age")),
                 F.when(F.col("age") > 0, F.col(order))).alias("age"),
        F.min_by("sex", F.when(F.col("sex").isNotNull(), F.col(order))).alias("sex")
    ).filter(F.col("n_samples") >= min_n)


def preferred_copy(copies: DataFrame, subject: str, has_data: str, path: str) -> DataFrame:
    """One copy per subject: present data first, then path order."""
    return copies.groupBy(subject).agg(
        F.min_by(F.struct(path, has_data),
                 F.struct((~F.col(has_data)).alias("m"), F.col(path).alias("p"))).alias("__b"),
        F.count("*").alias("n_copies")).select(subject, f"__b.{path}", f"__b.{has_data}", "n_copies")


def _pair_rows(table: pa.Table) -> pa.Table:
    """(rec, a, b, r) of one recording, in both orders: correlations over the instants that both channels have."""
    table = table.filter(pc.is_valid(table["channel"]))
    coded = pc.dictionary_encode(table["channel"]).combine_chunks()
    names = coded.dictionary.to_pylist() if len(coded) else []
    order = np.argsort(np.array(names, object), kind="stable") if names else np.empty(0, int)
    kind = table.schema.field("rec").type
    if len(names) < 2:
        return pa.table([pa.array([], kind), pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], ["rec", "a", "b", "r"])
    code, v, known = np.argsort(order)[coded.indices.to_numpy()], table["x"].to_numpy().astype(float), table["x"].is_valid().to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.bincount(code[known], weights=v[known], minlength=len(names)) / np.bincount(code[known], minlength=len(names))
    _, at = np.unique(table["t"].to_numpy(), return_inverse=True)
    x = np.full((at.max() + 1, len(names)), np.nan)
    x[at[known], code[known]] = v[known] - mean[code[known]]
    m = ~np.isnan(x)
    x, m = np.where(m, x, 0.0), m.astype(float)
    n, sa, saa, sab = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
    with np.errstate(invalid="ignore", divide="ignore"):
        var = saa - sa * sa / n
        cov, scale = sab - sa * sa.T / n, var * var.T
        r = np.where((var > 0) & (var.T > 0), cov / np.sqrt(scale), np.nan)
    first, second = np.nonzero((n > 0) & ~np.eye(len(names), dtype=bool))
    names = [names[i] for i in order]
    return pa.table([pa.array([table["rec"][0].as_py()] * len(first), kind), pa.array([names[i] for i in first]), pa.array([names[i] for i in second]),
                     pa.array(r[first, second], from_pandas=True)], ["rec", "a", "b", "r"])


def channel_correlations(samples: DataFrame, hot: bool | None = None) -> DataFrame:
    """(rec, a, b, r) for every channel pair of a recording, in both orders.

    A recording meets in one task. With a hot one, the channels of an instant meet in one row (bounded by the electrode count), rows are put in
    order, and a task adds its instants up to one co-moment matrix a recording, over the instants that both channels have, about each
    channel's mean; matrices are summed. No row is made for a pair of samples.
    """
    if not group_is_hot(samples, ["rec"], hot):
        kind = samples.schema["rec"].dataType.simpleString()
        return samples.select("rec", "channel", "t", "x").groupBy("rec").applyInArrow(_pair_rows, f"rec {kind}, a string, b string, r double")
    means = samples.groupBy("rec", "channel").agg(F.avg("x").alias("m"))
    centred = same_group(samples, means, ["rec", "channel"]).select("rec", "t", "channel", (F.col("x") - F.col("m")).alias("x"))
    at = stored(centred.groupBy("rec", "t").agg(F.collect_list(F.struct("channel", "x")).alias("c")), "instants")
    # In order, a batch holds few recordings, and adds each of them up to one matrix.
    at = at.repartitionByRange("rec", "t").sortWithinPartitions("rec", "t").select("rec", "c")

    def run(batches):
        for pdf in batches:
            for rec, part in pdf.groupby("rec", sort=False, dropna=False):
                names = sorted({e["channel"] for c in part["c"] for e in c})
                # A batch may end with instants of a single channel: they make no pair, and a frame without rows cannot be returned.
                if len(names) < 2:
                    continue
                place = {n: i for i, n in enumerate(names)}
                x = np.full((len(part), len(names)), np.nan)
                for i, c in enumerate(part["c"]):
                    for e in c:
                        x[i, place[e["channel"]]] = np.nan if e["x"] is None else e["x"]
                known = ~np.isnan(x)
                x, m = np.where(known, x, 0.0), known.astype(float)
                sums = {"n": m.T @ m, "sa": x.T @ m, "sb": m.T @ x, "saa": (x * x).T @ m, "sbb": m.T @ (x * x), "sab": x.T @ x}
                first, second = np.triu_indices(len(names), 1)
                yield pd.DataFrame({"rec": [rec] * len(first), "a": [names[i] for i in first], "b": [names[i] for i in second],
                                    **{k: v[first, second] for k, v in sums.items()}})

    parts = ["n", "sa", "sb", "saa", "sbb", "sab"]
    schema = f"rec {at.schema['rec'].dataType.simpleString()}, a string, b string, " + ", ".join(f"{c} double" for c in parts)
    s = at.mapInPandas(run, schema).groupBy("rec", "a", "b").agg(*[F.sum(c).alias(c) for c in parts])
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    r = F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    half = s.filter(n > 0).select("rec", "a", "b", r.alias("r"))
    both = F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return half.select("rec", F.inline(both))


def block_structure(corr: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mean correlation within and between channel blocks, paired over recordings.

    ``blocks`` has (block, channel). Recordings with an undefined pair are left out.
    """
    good = corr.withColumn("__ok", F.bool_and(finite(F.col("r")).isNotNull()).over(W.partitionBy("rec"))).filter("__ok")
    ba = blocks.select(F.col("block"), F.col("channel").alias("a"))
    bb = blocks.select(F.col("block").alias("block_b"), F.col("channel").alias("b"))
    j = good.join(F.broadcast(ba), "a").join(F.broadcast(bb), "b", "left")
    inside = F.col("block").eqNullSafe(F.col("block_b"))
    per = j.groupBy("rec", "block").agg(F.avg(F.when(inside, F.col("r"))).alias("w"),
                                        F.avg(F.when(~inside, F.col("r"))).alias("b"))
    d = F.col("w") - F.col("b")
    n = F.count("*")
    half = Z95_FULL * F.stddev_samp(d) / F.sqrt(n)
    return per.groupBy("block").agg(
        n.alias("n_recordings"), F.avg("w").alias("mean_within"), F.avg("b").alias("mean_between"),
        F.avg(d).alias("separation"), (F.avg(d) - half).alias("ci_lo"), (F.avg(d) + half).alias("ci_hi"),
        (F.avg("w") > F.avg("b")).alias("separated"))
