"""Caliper matching in priority order: each case in turn takes the nearest control that is still free.

The order is the hash of the case's id; on equal distance the lower control is nearer. Cases are settled in blocks of
``spark.tidemark.matchCasesPerTask`` for every run of close values (see ``matching.islands``), so the rounds are the
cases of the largest run divided by that number. A block meets only controls that it can reach. Let a queue walk up the
values: cases join it, each free control serves one. A control that finds the queue empty cannot be taken from below,
since a case passes a control only when that is taken, and what is taken between two free controls is taken by the cases
between them. The same holds from above, so a block of ``n`` cases needs at most ``2 n`` control values, and both queues
are running sums.

Defined results: rows without a finite value or without a class take no part; a null key is a group; repeated rows are
rows of their own; a case without a free control inside the caliper stays out and uses nothing; control rows of one
value are given out in hash order. Nothing depends on the size of a block.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import hash32
from tidemark.operators.matching import islands
from tidemark.operators.ordered import row_numbers, running, same_group
from tidemark.session import stored

CASES_CONF, CASES_DEFAULT = "spark.tidemark.matchCasesPerTask", 500_000


def nearest_in_order(cases: Sequence[float], controls: Sequence[float], counts: Sequence[int], caliper: float) -> np.ndarray:
    """Index of the control value that each case takes, -1 for none; ``controls`` ascending and distinct."""
    w, left, size = list(controls), list(counts), len(controls)
    # Link i leads to the next value with controls left, at i itself while it has some; one place is added at each end.
    up, down = list(range(size + 1)), list(range(size + 1))

    def root(link: list[int], i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    taken = np.full(len(cases), -1, dtype=np.int64)
    for n, v in enumerate(cases):
        at = bisect_left(w, v)
        hi, lo = root(up, at), root(down, at) - 1
        d_hi = w[hi] - v if hi < size else np.inf
        d_lo = v - w[lo] if lo >= 0 else np.inf
        j, d = (lo, d_lo) if d_lo <= d_hi else (hi, d_hi)
        if d > caliper or d == np.inf:
            continue
        taken[n] = j
        left[j] -= 1
        if left[j] == 0:
            up[j], down[j + 1] = j + 1, j
    return taken


def _queue(points: DataFrame, within: list[str], order: str, name: str, hot: bool | None) -> DataFrame:
    """Add the length of the queue that reaches each value along ``order``, its own cases included."""
    sums = running(points, within, [order], {"__c": F.col("c"), "__n": F.col("n")}, hot)
    before = sums.withColumn("__z", (F.col("__c") - F.col("c")) - (F.col("__n") - F.col("n")))
    low = running(before, within, [order], {"__m": -F.col("__z")}, hot, how="max")
    return low.withColumn(name, F.col("__z") + F.col("c") + F.col("__m")).drop("__c", "__n", "__z", "__m")


def reachable(block: DataFrame, free: DataFrame, within: Sequence[str], hot: bool | None = None) -> DataFrame:
    """The control values (``within``, ``v``, ``n``) that the cases of a block may take, at most two a case."""
    within = list(within)
    arrivals = block.groupBy(*within, "v").agg(F.count("*").alias("c"))
    live = same_group(free, block.select(*within).distinct(), within)
    points = (arrivals.withColumn("n", F.lit(0).cast("bigint")).unionByName(live.select(*within, "v", F.lit(0).cast("bigint").alias("c"), "n"))
              .groupBy(*within, "v").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).withColumn("__neg", -F.col("v")))
    both = _queue(_queue(points, within, "v", "__up", hot), within, "__neg", "__down", hot)
    return both.filter((F.col("n") > 0) & ((F.col("__up") > 0) | (F.col("__down") > 0))).select(*within, "v", "n")


def _settled(block: DataFrame, controls: DataFrame, within: list[str], sid: str, caliper: float) -> DataFrame:
    out = [*within, sid, "v", "__rn"]
    types = dict(block.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in out], "w double"])

    def run(t: pa.Table) -> pa.Table:
        rn, v, n = (t.column(c).to_numpy() for c in ("__rn", "v", "n"))
        cases, ctrls = np.flatnonzero(rn > 0), np.flatnonzero(rn == 0)
        cases, ctrls = cases[np.argsort(rn[cases])], ctrls[np.argsort(v[ctrls])]
        taken = nearest_in_order(v[cases].tolist(), v[ctrls].tolist(), n[ctrls].tolist(), caliper)
        hit = taken >= 0
        return t.select(out).take(pa.array(cases[hit])).append_column("w", pa.array(v[ctrls][taken[hit]], pa.float64()))

    rows = block.select(*out, F.lit(0).cast("bigint").alias("n")).unionByName(
        controls.select(*within, F.lit(None).cast(types[sid]).alias(sid), "v", F.lit(0).cast("bigint").alias("__rn"), "n"))
    return rows.groupBy(*within).applyInArrow(run, schema)


def priority_match(df: DataFrame, keys: Sequence[str], sid: str, y: str, value: str, caliper: float,
                   seed: str = "match", hot: bool | None = None) -> DataFrame:
    """(keys, case_id, control_id, case_value, control_value)"""
    keys = list(keys)
    within = [*keys, "__island"]
    v = F.col(value).cast("double") + F.lit(0.0)  # one zero
    rows = df.select(*keys, sid, y, v.alias("v"), hash32(seed, F.col(sid)).alias("__h")).filter(
        F.col(y).isin(0, 1) & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    rows = stored(rows, "match-rows")
    placed = islands(rows.select(*keys, "v").distinct(), keys, caliper).select(*within, "v")
    cases = same_group(rows.filter(F.col(y) == 1).select(*keys, sid, "v", "__h"), placed, [*keys, "v"])
    cases = stored(row_numbers(cases, within, ["__h", sid, "v"], "__rn", hot), "match-cases")
    free = same_group(rows.filter(F.col(y) == 0).groupBy(*keys, "v").agg(F.count("*").alias("n")), placed, [*keys, "v"])
    free = stored(free.select(*within, "v", "n"), "match-free")

    size = int(df.sparkSession.conf.get(CASES_CONF, str(CASES_DEFAULT)))
    most = cases.agg(F.max("__rn")).first()[0] or 0
    parts = []
    for start in range(0, max(most, 1), size):
        block = cases.filter(F.col("__rn").between(start + 1, start + size))
        got = stored(_settled(block, reachable(block, free, within, hot), within, sid, caliper), "match-pairs")
        parts.append(got)
        if start + size < most:
            used = got.groupBy(*within, F.col("w").alias("v")).agg(F.count("*").alias("__used"))
            free = stored(same_group(free, used, [*within, "v"], "left").select(
                *within, "v", (F.col("n") - F.coalesce("__used", F.lit(0))).alias("n")).filter("n > 0"), "match-free")
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)

    # The r-th case of a control value takes its r-th control in hash order.
    pairs = row_numbers(pairs, [*keys, "w"], ["__rn"], "__r", hot).select(
        *keys, F.col(sid).alias("case_id"), F.col("v").alias("case_value"), F.col("w").alias("control_value"), "__r")
    ctrls = row_numbers(rows.filter(F.col(y) == 0).select(*keys, sid, "v", "__h"), [*keys, "v"], ["__h", sid], "__r", hot).select(
        *keys, F.col(sid).alias("control_id"), F.col("v").alias("control_value"), "__r")
    return same_group(pairs, ctrls, [*keys, "control_value", "__r"]).select(
        *keys, "case_id", "control_id", "case_value", "control_value")
