"""Rank statistics over (group, label, score): AUC, DeLong, operating points, decision curves."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import Z95, normal_two_sided, ratio
from tidemark.operators.ordered import (apart, counts_through, group_is_hot, histogram, largest_group, quantiles,
                                        running, same_group)
from tidemark.session import stored

Y1, Y0 = 1, 0
#: Entries of the rows of a group that one task tests or reads.
TASK_CELLS = 80_000_000


def positives(y: str) -> Column:
    return (F.col(y) == 1).cast("bigint")


def negatives(y: str) -> Column:
    return (F.col(y) == 0).cast("bigint")


def auc(df: DataFrame, keys: Sequence[str], y: str, s: str, weight: str | None = None,
        name: str = "auc", hot: bool | None = None) -> DataFrame:
    """Mann-Whitney AUC with midranks per group, read from the tie histogram; null if one-class."""
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    df = df.filter(F.col(s).isNotNull())
    p, q = w * positives(y), w * negatives(y)
    hot = group_is_hot(df, keys, hot)
    hist = histogram(df, keys, s, {"__p": p, "__q": q})
    cum = running(stored(hist, "histogram") if hot else hist, keys, [s], {"__cq": F.col("__q")}, None if hot else False)
    cum = cum.withColumn("__b", F.col("__cq") - F.col("__q") / 2)
    out = cum.groupBy(*keys).agg(
        F.sum("__p").cast("double").alias("__P"), F.sum("__q").cast("double").alias("__Q"),
        F.sum(F.col("__p") * F.col("__b")).alias("__u"))
    return out.select(*keys, ratio(F.col("__u"), F.col("__P") * F.col("__Q")).alias(name),
                      F.col("__P").cast("bigint").alias("n_pos"),
                      F.col("__Q").cast("bigint").alias("n_neg"))


def long_scores(df: DataFrame, keys: Sequence[str], y: str, scores: Sequence[str],
                name: str = "arm", value: str = "s") -> DataFrame:
    """One row per (row, score column): the loop over scores becomes a key."""
    return df.select(*keys, y, F.explode(F.create_map(
        *[c for s in scores for c in (F.lit(s), F.col(s).cast("double"))])).alias(name, value))


def placements(df: DataFrame, keys: Sequence[str], y: str, s: str, name: str,
               hot: bool | None = None) -> DataFrame:
    """Structural component of each row: the share of the other class it outranks correctly."""
    keys = list(keys)
    out = counts_through(df, keys, s, {"__bn": negatives(y), "__bp": positives(y)}, hot)
    return out.withColumn(
        name, F.when(F.col(y) == 1, ratio(F.col("__bn"), F.col("__n0")))
        .otherwise(1 - ratio(F.col("__bp"), F.col("__n1")))).drop("__bn", "__bp")


def delong(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str, min_n: int = 10,
           hot: bool | None = None) -> DataFrame:
    """Paired DeLong comparison of two scores per group, on the rows where both exist."""
    keys = list(keys)
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, y, a, *([b] if b != a else []))
    hot, rows = apart(rows, keys, hot)
    counts = {"__n1": F.sum(positives(y)), "__n0": F.sum(negatives(y))}
    if hot:
        rows = stored(rows, "paired")
        rows = with_group(rows, rows.groupBy(*keys).agg(*[e.alias(n) for n, e in counts.items()]), keys)
    else:
        rows = rows.withColumns({n: e.over(W.partitionBy(*keys)) for n, e in counts.items()})
    placed = placements(placements(rows, keys, y, a, "__va", hot), keys, y, b, "__vb", hot)
    pos, neg = F.col(y) == 1, F.col(y) == 0

    def cov(cls: Column, u: str, v: str) -> Column:
        return F.covar_samp(F.when(cls, F.col(u)), F.when(cls, F.col(v)))

    def own(cls: Column, n: str) -> Column:
        return (cov(cls, "__va", "__va") + cov(cls, "__vb", "__vb")) / F.max(n)

    def term(cls: Column, n: str) -> Column:
        return own(cls, n) - 2 * cov(cls, "__va", "__vb") / F.max(n)

    n = F.max(F.col("__n1") + F.col("__n0"))
    ok = (F.max("__n1") > 0) & (F.max("__n0") > 0) & (n >= min_n)
    est = placed.groupBy(*keys).agg(
        n.alias("n"),
        F.when(ok, F.avg(F.when(pos, F.col("__va")))).alias("auc_a"),
        F.when(ok, F.avg(F.when(pos, F.col("__vb")))).alias("auc_b"),
        F.when(ok, term(pos, "__n1") + term(neg, "__n0")).alias("__var"),
        F.when(ok, own(pos, "__n1") + own(neg, "__n0")).alias("__own"))
    return _tested(est, keys)


def _tested(est: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, AUCs, difference, its test and interval) from (keys, n, auc_a, auc_b, __var, __own)."""
    diff = F.col("auc_a") - F.col("auc_b")
    # Zero up to rounding, measured against the two variances it is the difference of.
    flat = F.col("__var") <= 1e-13 * F.col("__own")
    est = est.select(*keys, "n", "auc_a", "auc_b", diff.alias("diff"),
                     F.when(flat, 0.0).otherwise(F.sqrt("__var")).alias("se"), flat.alias("__flat"))
    est = est.withColumn("z", F.when(F.col("__flat"), 0.0).otherwise(F.col("diff") / F.col("se")))
    est = est.withColumn("p", F.when(
        F.col("__flat"), F.when(F.abs("diff") < 1e-12, 1.0).otherwise(0.0))
        .otherwise(normal_two_sided(F.col("z"))))
    half = F.when(F.col("__flat"), 0.0).otherwise(Z95 * F.col("se"))
    centre = F.when(F.col("__flat"), 0.0).otherwise(F.col("diff"))
    return est.select(*keys, "n", "auc_a", "auc_b", "diff", "se", "z", "p",
                      (centre - half).alias("ci_lo"), (centre + half).alias("ci_hi"))


def _fits_a_task(wide: DataFrame, keys: Sequence[str], columns: int, hot: bool | None) -> bool:
    """Whether every group of a wide table is read by one task: rows that cannot be hot are, others are counted."""
    return hot is False or largest_group(wide, keys) * (columns + 2) <= TASK_CELLS


def _known(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Rows with a value in all columns."""
    out = np.ones(table.num_rows, bool)
    for c in columns:
        out &= table[c].is_valid().to_numpy()
    return out


def _half_below(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each value, how many of the sorted ``others`` are smaller, equal ones counted half."""
    return (np.searchsorted(others, values, "left") + np.searchsorted(others, values, "right")) / 2


def _delong_sums(one: np.ndarray, zero: np.ndarray, pair: Sequence[np.ndarray], min_n: int) -> tuple:
    """n, the two AUCs, the variance of their difference, and the sum of their own variances; None where undefined."""
    n1, n0 = int(one.sum()), int(zero.sum())
    if not n1 or not n0 or n1 + n0 < min_n:
        return n1 + n0, None, None, None, None
    cases, controls = [], []
    for s in pair:
        a, b = s[one], s[zero]
        cases.append(_half_below(a, np.sort(b)) / n0)
        controls.append(1 - _half_below(b, np.sort(a)) / n1)
    aucs = [float(v.mean()) for v in cases]
    if n1 < 2 or n0 < 2:
        return n1 + n0, *aucs, None, None
    var = own = 0.0
    for va, vb in (cases, controls):
        ca, cb, n = va - va.mean(), vb - vb.mean(), len(va)
        each = (ca @ ca + cb @ cb) / (n - 1)
        own += each / n
        var += (each - 2 * (ca @ cb) / (n - 1)) / n
    return n1 + n0, *aucs, float(var), float(own)


def delong_pairs(wide: DataFrame, keys: Sequence[str], y: str, pairs: Sequence[tuple[str, str, str]], min_n: int = 10, hot: bool | None = None) -> DataFrame:
    """``delong`` of named pairs of score columns, [(margin, a, b)], with the columns of ``delong`` by (keys, margin).

    A row is not copied by pair: a group meets in one task, which takes the pairs one after the other, unless it is too large for that.
    """
    keys, columns = list(keys), sorted({c for _, *ab in pairs for c in ab})
    if not _fits_a_task(wide, keys, len(columns), hot):
        arms = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(a).cast("double").alias("sa"), F.col(b).cast("double").alias("sb")) for m, a, b in pairs])
        rows = wide.select(*keys, y, F.explode(arms).alias("p")).select(*keys, y, "p.*")
        return delong(rows, [*keys, "margin"], y, "sa", "sb", min_n, hot)
    rows = wide.select(*keys, F.col(y).cast("int").alias("__y"), *[F.col(c).cast("double").alias(f"__s{i}") for i, c in enumerate(columns)])
    place = {c: f"__s{i}" for i, c in enumerate(columns)}
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def test(table: pa.Table) -> pa.Table:
        label, out = np.asarray(table["__y"].fill_null(-1)), []
        for margin, a, b in pairs:
            some = np.flatnonzero(_known(table, (place[a], place[b])))
            if len(some):
                own = label[some]
                out.append((margin, *_delong_sums(own == 1, own == 0, [table[place[c]].to_numpy()[some] for c in (a, b)], min_n)))
        made = [pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * 6, [pa.string(), pa.int64(), *[pa.float64()] * 4])]
        return pa.table([*[pa.array([table[c][0].as_py()] * len(out), table.schema.field(c).type) for c in keys], *made],
                        [*keys, "margin", "n", "auc_a", "auc_b", "__var", "__own"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "margin string, n bigint, auc_a double, auc_b double, __var double, __own double"])
    return _tested(rows.groupBy(*keys).applyInArrow(test, schema), [*keys, "margin"])


def arm_aucs(wide: DataFrame, keys: Sequence[str], y: str, arms: Sequence[str], hot: bool | None = None) -> DataFrame:
    """(keys, arm, auc, n_pos, n_neg): ``auc`` of every score column, of groups that meet in one task each unless they are too large."""
    keys, arms = list(keys), list(arms)
    if not _fits_a_task(wide, keys, len(arms), hot):
        return auc(long_scores(wide, keys, y, arms), [*keys, "arm"], y, "s", hot=hot)
    rows = wide.select(*keys, F.col(y).cast("int").alias("__y"), *[F.col(c).cast("double").alias(f"__s{i}") for i, c in enumerate(arms)])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def read(table: pa.Table) -> pa.Table:
        label, out = np.asarray(table["__y"].fill_null(-1)), []
        for i, arm in enumerate(arms):
            some = np.flatnonzero(_known(table, [f"__s{i}"]))
            if len(some):
                s, own = table[f"__s{i}"].to_numpy()[some], label[some]
                a, b = s[own == 1], s[own == 0]
                out.append((arm, float(_half_below(a, np.sort(b)).sum()) / (len(a) * len(b)) if len(a) and len(b) else None, len(a), len(b)))
        made = [pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * 4, [pa.string(), pa.float64(), pa.int64(), pa.int64()])]
        return pa.table([*[pa.array([table[c][0].as_py()] * len(out), table.schema.field(c).type) for c in keys], *made], [*keys, "arm", "auc", "n_pos", "n_neg"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "arm string, auc double, n_pos bigint, n_neg bigint"])
    return rows.groupBy(*keys).applyInArrow(read, schema)


def holm(df: DataFrame, family: Sequence[str], p: str, order: Sequence[str] = (),
         name: str = "p_holm", hot: bool | None = None) -> DataFrame:
    """Step-down adjusted p-values inside each declared family; null p-values stay null.

    ``order`` breaks ties of p, so that the order inside a family is total.
    """
    family = list(family)
    if not group_is_hot(df, family, hot):
        part = W.partitionBy(*family, F.col(p).isNotNull())
        by_p = part.orderBy(p, *order)
        scaled = df.withColumn(
            "__scaled", (F.count("*").over(part) - F.row_number().over(by_p) + 1) * F.col(p))
        run = F.max("__scaled").over(by_p.rowsBetween(W.unboundedPreceding, W.currentRow))
        return scaled.withColumn(
            name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), run))).drop("__scaled")
    rows = stored(df, "family")
    valid = rows.filter(F.col(p).isNotNull())
    n = valid.groupBy(*family).agg(F.count("*").alias("__n"))
    ranked = running(with_group(valid, n, family), family, [p, *order], {"__rank": F.lit(1)}, True)
    scaled = ranked.withColumn("__scaled", (F.col("__n") - F.col("__rank") + 1) * F.col(p))
    run = running(scaled, family, [p, *order], {"__run": F.col("__scaled")}, True, how="max")
    out = run.withColumn(name, F.least(F.lit(1.0), F.col("__run"))).select(*df.columns, name)
    return out.unionByName(rows.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def control_threshold(df: DataFrame, keys: Sequence[str], y: str, s: str, spec: float = 0.8,
                      name: str = "threshold", hot: bool | None = None) -> DataFrame:
    """Score quantile among controls that fixes the specificity."""
    return quantiles(df.filter(F.col(y) == 0), keys, s, {name: spec}, hot)


def with_group(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return same_group(df, table, list(keys), how)


def read_at(df: DataFrame, keys: Sequence[str], y: str, s: str, threshold: str = "threshold",
            spec_target: float = 0.8) -> DataFrame:
    """Sensitivity (s > threshold), specificity (s <= threshold) and what follows from them."""
    flag = (F.col(s) > F.col(threshold)).cast("double")
    n0 = F.sum(negatives(y))
    out = df.groupBy(*keys).agg(
        F.max(threshold).alias("threshold"),
        F.avg(F.when(F.col(y) == 1, flag)).alias("sensitivity"),
        F.avg(F.when(F.col(y) == 0, 1 - flag)).alias("specificity"),
        n0.alias("n_controls"))
    return out.withColumns({
        "youden_j": F.col("sensitivity") + F.col("specificity") - 1,
        "granularity": ratio(F.lit(1.0), F.col("n_controls")),
        "shortfall": spec_target - F.col("specificity")})


def average_precision(df: DataFrame, keys: Sequence[str], y: str, s: str,
                      name: str = "average_precision", hot: bool | None = None) -> DataFrame:
    """Sum of precision times the step in recall over the distinct scores, highest first."""
    keys = list(keys)
    neg = df.withColumn("__s", -F.col(s))
    hist = histogram(neg, keys, "__s", {"__p": positives(y), "__n": F.lit(1)})
    cum = running(hist, keys, ["__s"], {"__cp": F.col("__p"), "__cn": F.col("__n")}, hot)
    return cum.groupBy(*keys).agg(ratio(
        F.sum(F.col("__p") * F.col("__cp") / F.col("__cn")), F.sum("__p")).alias(name))


def net_benefit(df: DataFrame, keys: Sequence[str], y: str, prob: str, thresholds: DataFrame,
                prevalence: float | None = None) -> DataFrame:
    """Decision curve: the table is read once, every threshold is a conditional sum.

    ``thresholds`` is the swept grid (tens of rows). Each row adds to a small array of counts
    indexed by the number of grid points at or below its probability, so nothing is exploded.
    """
    keys = list(keys)
    rows = df.filter(F.col(prob).isNotNull())
    grid = thresholds.select("threshold").distinct()
    arr = grid.agg(F.array_sort(F.collect_list("threshold")).alias("__grid"))
    cell = rows.crossJoin(F.broadcast(arr)).select(
        *keys, F.size(F.filter("__grid", lambda t: t <= F.col(prob))).alias("__cell"),
        positives(y).alias("__p"), negatives(y).alias("__q"))
    counts = cell.groupBy(*keys, "__cell").agg(F.sum("__p").alias("__p"), F.sum("__q").alias("__q"))
    total = counts.groupBy(*keys).agg(F.sum("__p").alias("n_pos"), F.sum("__q").alias("n_neg"))
    points = arr.select(F.posexplode("__grid").alias("__i", "threshold"))
    axis = total.crossJoin(F.broadcast(points))
    named = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__cell", "__p", "__q")
    cond = F.col("__cell") > F.col("__i")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    at = (axis.join(named, cond, "left")
          .groupBy(*keys, "threshold", "n_pos", "n_neg")
          .agg(F.coalesce(F.sum("__p"), F.lit(0)).alias("tp"),
               F.coalesce(F.sum("__q"), F.lit(0)).alias("fp")))
    n = F.col("n_pos") + F.col("n_neg")
    observed = F.col("n_pos") / n
    prev = observed if prevalence is None else F.lit(float(prevalence))
    w1 = F.when(observed > 0, prev / observed).otherwise(0.0)
    w0 = F.when(observed < 1, (1 - prev) / (1 - observed)).otherwise(0.0)
    n_eff = w1 * F.col("n_pos") + w0 * F.col("n_neg")
    odds = F.col("threshold") / (1 - F.col("threshold"))
    tp, fp = w1 * F.col("tp"), w0 * F.col("fp")
    return at.select(
        *keys, "threshold", n.alias("n"), prev.alias("prevalence"),
        (tp / n_eff - fp / n_eff * odds).alias("net_benefit"),
        (prev - (1 - prev) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"),
        ((tp + fp) / n_eff).alias("flagged_fraction"))


POOL_SUMS = ("__k", "__sw", "__swd", "__swdd")


def _pool_sums(df: DataFrame, keys: Sequence[str], diff: str, se: str) -> DataFrame:
    ok = df.filter(F.col(diff).isNotNull() & (F.col(se) > 0)).withColumn(
        "__w", 1 / (F.col(se) * F.col(se)))
    return ok.groupBy(*keys).agg(
        F.count("*").alias("__k"), F.sum("__w").alias("__sw"),
        F.sum(F.col("__w") * F.col(diff)).alias("__swd"),
        F.sum(F.col("__w") * F.col(diff) * F.col(diff)).alias("__swdd"))


def _pooled(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    est = F.col("__swd") / F.col("__sw")
    out = sums.filter(F.col("__k") > 0).select(
        *keys, F.col("__k").alias("k"), est.alias("diff"), F.sqrt(1 / F.col("__sw")).alias("se"),
        F.greatest(F.col("__swdd") - F.col("__swd") * est, F.lit(0.0)).alias("q"))
    return out.withColumns({"ci_lo": F.col("diff") - Z95 * F.col("se"),
                            "ci_hi": F.col("diff") + Z95 * F.col("se"),
                            "p": normal_two_sided(F.col("diff") / F.col("se"))})


def pool(df: DataFrame, keys: Sequence[str], diff: str, se: str) -> DataFrame:
    """Fixed-effect inverse-variance pool with Cochran's Q; rows without a positive se are left out."""
    return _pooled(_pool_sums(df, keys, diff, se), keys)


def pool_leave_one_out(df: DataFrame, keys: Sequence[str], unit: str, diff: str, se: str,
                       name: str = "left_out") -> DataFrame:
    """The pool without each unit in turn, as total minus own; 'none' is the pool of all."""
    own = _pool_sums(df, [*keys, unit], diff, se)
    units = same_group(df.select(*keys, unit).distinct(), own, [*keys, unit], "left")
    total = own.groupBy(*keys).agg(*[F.sum(c).alias(f"t{c}") for c in POOL_SUMS])
    rest = with_group(units, total, keys).select(
        *keys, F.col(unit).cast("string").alias(name),
        *[(F.col(f"t{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in POOL_SUMS])
    whole = total.select(*keys, F.lit("none").alias(name), *[F.col(f"t{c}").alias(c) for c in POOL_SUMS])
    return _pooled(rest.unionByName(whole), [*keys, name])
