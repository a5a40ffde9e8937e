"""Fold assignment from identifier hashes: stratified rows, stratified groups, repeats as a key."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import hash32
from tidemark.operators.ordered import row_numbers, same_group


def with_repeats(df: DataFrame, repeats: int, name: str = "repeat") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def stratified(df: DataFrame, keys: Sequence[str], sid: str, y: str, k: int, repeats: int,
               hot: bool | None = None) -> DataFrame:
    """Adds repeat and fold: position in hash order within (keys, repeat, class), modulo k."""
    rows = with_repeats(df, repeats).withColumn("__h", hash32(F.col("repeat"), F.col(sid)))
    out = row_numbers(rows, [*keys, "repeat", y], ["__h", sid], "__rn", hot)
    return out.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn", "__h")


def fold_counts(p: np.ndarray, q: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Groups of each kind (``m`` groups of ``p`` positives and ``q`` negatives) that go to each fold.

    Kinds are taken by falling load (share of all positives plus share of all negatives), and each group goes to the fold with
    the least load, the first of equals. All groups of a kind are settled at once: folds are filled up to one level. Integers throughout.
    """
    total_p, total_q = max(1, int((p * m).sum())), max(1, int((q * m).sum()))
    load = [int(a) * total_q + int(b) * total_p for a, b in zip(p, q)]
    held, out = [0] * k, np.zeros((len(p), k), np.int64)
    for i in sorted(range(len(p)), key=lambda i: (-load[i], -int(p[i]))):
        w, left = load[i], int(m[i])
        if w == 0:
            out[i, 0] += left
            continue
        lo, hi = min(held), max(held) + w * (left + 1)
        below = lambda level: [max(0, -(-(level - h) // w)) for h in held]
        # The highest level below which no more groups fit than there are.
        while lo < hi:
            middle = (lo + hi + 1) // 2
            lo, hi = (middle, hi) if sum(below(middle)) <= left else (lo, middle - 1)
        n = below(lo)
        rest = left - sum(n)
        for f in sorted(range(k), key=lambda f: (held[f] + n[f] * w, f))[:rest]:
            n[f] += 1
        held = [h + c * w for h, c in zip(held, n)]
        out[i] = n
    return out


def group_stratified(df: DataFrame, keys: Sequence[str], group: str, y: str, k: int, repeats: int,
                     hot: bool | None = None) -> DataFrame:
    """Folds of whole groups, balanced in both classes by the sizes of the groups; too few groups is an error.

    The packing is settled on the table of distinct (positives, negatives) with counts; the groups of a kind go to the folds in
    hash order, so repeats differ in which groups meet, not in how many.
    """
    keys = list(keys)
    per = df.groupBy(*keys, group).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("__p"), F.sum((F.col(y) != 1).cast("bigint")).alias("__q"))
    kinds = per.groupBy(*keys, "__p", "__q").agg(F.count("*").alias("__m"))
    types = {f.name: f.dataType.simpleString() for f in kinds.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["__m"].sum() < k:
            raise ValueError(f"need at least {k} groups, got {int(pdf['__m'].sum())}")
        n = fold_counts(pdf["__p"].to_numpy(), pdf["__q"].to_numpy(), pdf["__m"].to_numpy(), k)
        ends = n.cumsum(axis=1)
        return pd.DataFrame([(*key, int(a), int(b), f, int(e[f] - c[f]), int(e[f])) for a, b, c, e in zip(pdf["__p"], pdf["__q"], n, ends) for f in range(k)],
                            columns=[*keys, "__p", "__q", "fold", "__lo", "__hi"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "__p bigint, __q bigint, fold int, __lo bigint, __hi bigint"])
    ranges = kinds.groupBy(*keys).applyInPandas(run, schema)
    ranked = with_repeats(per, repeats).withColumn("__h", hash32(F.col("repeat"), F.col(group)))
    ranked = row_numbers(ranked, [*keys, "repeat", "__p", "__q"], ["__h", group], "__rn", hot)
    placed = same_group(ranked, ranges, [*keys, "__p", "__q"]).filter((F.col("__rn") > F.col("__lo")) & (F.col("__rn") <= F.col("__hi")))
    return same_group(df, placed.select(*keys, group, "repeat", "fold"), [*keys, group])
