"""Caliper matching on one covariate, one to one and without replacement.

Pairs are taken closest first (on equal distance the lower control first, then hash order). All
cases of one value are interchangeable up to hash order, so the matching is settled on the table
of distinct values and counts; identities are assigned afterwards by rank. Pairs of rows are never
enumerated, and a value shared by a third of all rows is one row of that table. Values further apart than the
caliper cannot meet, so each run of close values is settled on its own; only a run with more than
``spark.tidemark.matchValuesPerTask`` values takes rounds of mutual choices.
"""
from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import hash32
from tidemark.operators.ordered import neighbours, row_numbers, running, same_group
from tidemark.session import stored

VALUES_CONF, VALUES_DEFAULT = "spark.tidemark.matchValuesPerTask", 1_000_000


def closest_first(v: np.ndarray, n_case: np.ndarray, n_ctrl: np.ndarray, caliper: float) -> list[tuple]:
    """(case value, control value, count) in the order taken; ``v`` ascending and distinct."""
    left, right = n_case.copy(), n_ctrl.copy()
    size = len(v)
    down, up = np.arange(size), np.arange(size)  # nearest index with controls left, path-halved

    def seek(link: np.ndarray, i: int, step: int) -> int:
        while 0 <= i < size and right[i] == 0:
            if link[i] == i:
                link[i] = i + step
            nxt = link[i]
            if 0 <= nxt < size:
                link[i] = link[nxt] if right[nxt] == 0 and link[nxt] != nxt else nxt
            i = nxt
        return i

    def best(i: int):
        lo, hi = seek(down, i, -1), seek(up, i, 1)
        options = []
        if lo >= 0:
            options.append((v[i] - v[lo], 0, i, lo))
        if hi < size:
            options.append((v[hi] - v[i], 1 if hi != i else 0, i, hi))
        options = [o for o in options if o[0] <= caliper]
        return min(options) if options else None

    heap = [b for b in (best(i) for i in np.flatnonzero(left)) if b]
    heapq.heapify(heap)
    out = []
    while heap:
        d, side, i, j = heapq.heappop(heap)
        if left[i] == 0:
            continue
        m = min(left[i], right[j])
        if m > 0:
            left[i] -= m
            right[j] -= m
            out.append((v[i], v[j], int(m), side))
        if left[i] > 0:
            nxt = best(i)
            if nxt:
                heapq.heappush(heap, nxt)
    return out


def _in_task(values: DataFrame, keys: list[str], caliper: float) -> DataFrame:
    types = dict(values.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "case_value double, control_value double, m bigint, side int"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        got = closest_first(pdf["v"].to_numpy(), pdf["n_case"].to_numpy(), pdf["n_ctrl"].to_numpy(), caliper)
        return pd.DataFrame([(*key, *g) for g in got],
                            columns=[*keys, "case_value", "control_value", "m", "side"])

    return values.groupBy(*keys).applyInPandas(run, schema)


def _side(values: DataFrame, keys: list[str], own: str, other: str, caliper: float, is_case: bool) -> DataFrame:
    """Preferred partner value of every value that still has ``own`` rows."""
    rows = values.filter(F.col(own) > 0).select(*keys, "v", F.lit(0).alias("__ref")).unionByName(
        values.filter(F.col(other) > 0).select(*keys, "v", F.lit(1).alias("__ref")))
    n = neighbours(rows, keys, "v", "__ref").filter("__ref = 0")
    d_lo, d_hi = F.col("v") - F.col("lo"), F.col("hi") - F.col("v")
    first_lo = d_lo <= d_hi if is_case else d_lo < d_hi  # the pair with the lower control is first
    pick = (F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo"))
            .when(first_lo, F.col("lo")).otherwise(F.col("hi")))
    return n.select(*keys, "v", pick.alias("w")).filter(F.abs(F.col("w") - F.col("v")) <= caliper)


def _rounds(values: DataFrame, keys: list[str], caliper: float) -> DataFrame:
    """Mutually preferred values are settled together, until no pair is left in the caliper.

    A value's closest partner is strict, so a mutual choice is exactly what closest-first would
    take; every round exhausts one side of each mutual pair.
    """
    state, parts = stored(values, "match"), []
    while True:
        a = _side(state, keys, "n_case", "n_ctrl", caliper, True)
        b = _side(state, keys, "n_ctrl", "n_case", caliper, False).select(
            *keys, F.col("w").alias("v"), F.col("v").alias("w"))
        mutual = same_group(a, b, [*keys, "v", "w"])
        case_n = state.select(*keys, "v", F.col("n_case").alias("__a"))
        ctrl_n = state.select(*keys, F.col("v").alias("w"), F.col("n_ctrl").alias("__b"))
        got = stored(same_group(same_group(mutual, case_n, [*keys, "v"]), ctrl_n, [*keys, "w"]).select(
            *keys, F.col("v").alias("case_value"), F.col("w").alias("control_value"),
            F.least("__a", "__b").alias("m"), (F.col("w") > F.col("v")).cast("int").alias("side")), "match")
        if got.isEmpty():
            break
        parts.append(got)
        used = (got.select(*keys, F.col("case_value").alias("v"), F.col("m").alias("__a"), F.lit(0).alias("__b"))
                .unionByName(got.select(*keys, F.col("control_value").alias("v"), F.lit(0).alias("__a"),
                                        F.col("m").alias("__b")))
                .groupBy(*keys, "v").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b")))
        state = stored(same_group(state, used, [*keys, "v"], "left").select(
            *keys, "v", (F.col("n_case") - F.coalesce("__a", F.lit(0))).alias("n_case"),
            (F.col("n_ctrl") - F.coalesce("__b", F.lit(0))).alias("n_ctrl")).filter("n_case + n_ctrl > 0"), "match")
    out = parts[0] if parts else got
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matched_values(df: DataFrame, keys: Sequence[str], y: str, value: str, caliper: float,
                   large: bool | None = None) -> DataFrame:
    keys = list(keys)
    v = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v"))
         .agg(F.sum((F.col(y) == 1).cast("bigint")).alias("n_case"),
              F.sum((F.col(y) == 0).cast("bigint")).alias("n_ctrl")))
    limit = int(df.sparkSession.conf.get(VALUES_CONF, str(VALUES_DEFAULT)))
    if large is not None:
        return _rounds(v, keys, caliper) if large else _in_task(v, keys, caliper)
    v = stored(islands(v, keys, caliper), "values")
    within = [*keys, "__island"]
    big = stored(v.groupBy(*within).count().filter(F.col("count") > limit).select(*within), "large-islands")
    if big.isEmpty():
        return _in_task(v, within, caliper).drop("__island")
    named = big.withColumnsRenamed({k: f"__k_{k}" for k in within})
    on = [v[k].eqNullSafe(named[f"__k_{k}"]) for k in within]
    small = _in_task(v.join(named, on, "left_anti"), within, caliper)
    return small.unionByName(_rounds(v.join(named, on, "left_semi"), within, caliper)).drop("__island")


def islands(values: DataFrame, keys: Sequence[str], caliper: float) -> DataFrame:
    """Add ``__island``: values of different islands are more than the caliper apart, so each is matched on its own.

    An island is a run of occupied cells one caliper wide: cell minus rank does not change along a run.
    """
    keys = list(keys)
    if caliper <= 0:
        return values.withColumn("__island", F.xxhash64("v"))
    cell = F.floor(F.col("v") / caliper)
    cells = row_numbers(values.select(*keys, cell.alias("__cell")).distinct(), keys, ["__cell"], "__rank")
    cells = cells.select(*keys, "__cell", (F.col("__cell") - F.col("__rank")).alias("__island"))
    return same_group(values.withColumn("__cell", cell), cells, [*keys, "__cell"]).drop("__cell")


def caliper_match(df: DataFrame, keys: Sequence[str], sid: str, y: str, value: str, caliper: float,
                  seed: str = "match", large: bool | None = None, hot: bool | None = None) -> DataFrame:
    """(keys, case_id, control_id, case_value, control_value)"""
    keys = list(keys)
    d = F.abs(F.col("case_value") - F.col("control_value"))
    chunks = matched_values(df, keys, y, value, caliper, large).withColumn("__d", d)
    chunks = stored(chunks, "chunks")
    by_case = running(chunks, [*keys, "case_value"], ["__d", "side"], {"__ce": F.col("m")}, hot)
    by_ctrl = running(by_case, [*keys, "control_value"], ["__d", "side"], {"__ke": F.col("m")}, hot)
    # __d and side order the chunks of one control value too: its partners differ in one of them.
    chunks = by_ctrl.withColumns({"__c0": F.col("__ce") - F.col("m"), "__k0": F.col("__ke") - F.col("m")})
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, sid, y, F.col(value).cast("double").alias("__v"), hash32(seed, F.col(sid)).alias("__h"))
    ranked = row_numbers(rows, [*keys, y, "__v"], ["__h", sid], "__rn", hot)
    cases = ranked.filter(F.col(y) == 1).select(
        *keys, F.col(sid).alias("case_id"), F.col("__v").alias("case_value"), F.col("__rn").alias("__cr"))
    ctrls = ranked.filter(F.col(y) == 0).select(
        *keys, F.col(sid).alias("control_id"), F.col("__v").alias("control_value"), F.col("__rn").alias("__kr"))
    hit = same_group(cases, chunks, [*keys, "case_value"]).filter(
        (F.col("__cr") > F.col("__c0")) & (F.col("__cr") <= F.col("__ce")))
    hit = hit.withColumn("__kr", F.col("__k0") + F.col("__cr") - F.col("__c0"))
    return same_group(hit, ctrls, [*keys, "control_value", "__kr"]).select(
        *keys, "case_id", "control_id", "case_value", "control_value")
