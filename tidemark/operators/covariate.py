"""Covariate models by moments: quadratic trends, normative reference, anchoring, cross-fitting."""
from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import batched as bt
from tidemark.operators import models as ml
from tidemark.operators.ordered import medians, same_group
from tidemark.session import stored

CENTRE, SPREAD, FLOOR = 50.0, 25.0, 1e-9
EULER_GAMMA = 0.5772156649015329
LOG_ABS_TO_SD = (EULER_GAMMA + math.log(2)) / 2
SUMS = ["n", "t1", "t2", "t3", "t4", "x0", "x1", "x2"]


def standard_age(age: Column) -> Column:
    """The covariate on a fixed centred scale, so that its powers stay well conditioned."""
    return (age - CENTRE) / SPREAD


def moment_sums(age: str, value: str, where: Column | None = None) -> list[Column]:
    ok = F.col(age).isNotNull() & F.col(value).isNotNull()
    ok = ok if where is None else ok & where
    t, x = standard_age(F.col(age)), F.col(value)
    terms = [F.lit(1.0), t, t * t, t * t * t, t * t * t * t, x, t * x, t * t * x]
    return [F.coalesce(F.sum(F.when(ok, e)), F.lit(0.0)).alias(n) for e, n in zip(terms, SUMS)]


def solved(sums: DataFrame, keys: Sequence[str], min_n: int) -> DataFrame:
    """(keys, n, b0, b1, b2) on the centred scale from the eight sums; null below ``min_n``."""
    n, t1, t2, t3, t4, x0, x1, x2 = (F.col(c) for c in SUMS)

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(n, t1, t2, t1, t2, t3, t2, t3, t4)
    ok = (n >= min_n) & (F.abs(whole) > 1e-12)
    out = [F.when(ok, d / whole).alias(name) for name, d in (
        ("b0", det(x0, t1, t2, x1, t2, t3, x2, t3, t4)),
        ("b1", det(n, x0, t2, t1, x1, t3, t2, x2, t4)),
        ("b2", det(n, t1, x0, t1, t2, x1, t2, t3, x2)))]
    return sums.select(*keys, n.cast("bigint").alias("n"), *out)


def trend(age: str) -> Column:
    t = standard_age(F.col(age))
    return F.col("b0") + F.col("b1") * t + F.col("b2") * t * t


def quadratic_fit(long: DataFrame, keys: Sequence[str], age: str, value: str, min_n: int = 10,
                  where: Column | None = None) -> DataFrame:
    """Quadratic least squares per group: one hash aggregate and a closed-form solve."""
    return solved(long.groupBy(*keys).agg(*moment_sums(age, value, where)), keys, min_n)


def residuals(long: DataFrame, fit: DataFrame, keys: Sequence[str], age: str, value: str,
              name: str = "resid") -> DataFrame:
    """Value minus trend; a feature without a fit keeps its value."""
    j = same_group(long, fit.drop("n"), list(keys), "left")
    return j.withColumn(name, F.coalesce(F.col(value) - trend(age), F.col(value))).drop("b0", "b1", "b2")


def crossfit_sums(long: DataFrame, keys: Sequence[str], fold: str, age: str, value: str, k: int,
                  where: Column | None = None) -> DataFrame:
    """Sums over everything but the held-out fold, as total minus fold (column ``mfold``)."""
    per = long.groupBy(*keys, fold).agg(*moment_sums(age, value, where))
    held = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = per.withColumn("mfold", held).filter(F.col("mfold") != F.col(fold))
    return rows.groupBy(*keys, "mfold").agg(*[F.sum(c).alias(c) for c in SUMS])


def normative_fit(long: DataFrame, keys: Sequence[str], age: str, value: str, min_n: int = 30) -> DataFrame:
    """Mean and log-spread of every feature given the covariate, on the rows handed in (controls).

    (keys, n, b0, b1, b2, g0, g1, usable, age_lo, age_hi)
    """
    keys = list(keys)
    mean = quadratic_fit(long, keys, age, value, min_n)
    r = same_group(long, mean.select(*keys, "b0", "b1", "b2"), keys).withColumn(
        "__l", F.log(F.abs(F.col(value) - trend(age)) + FLOOR))
    spread = r.groupBy(*keys).agg(F.regr_slope("__l", age).alias("g1"), F.regr_intercept("__l", age).alias("g0"),
                                  F.min(age).alias("age_lo"), F.max(age).alias("age_hi"))
    return same_group(mean, spread, keys, "left").withColumn(
        "usable", F.col("b0").isNotNull() & F.col("g0").isNotNull())


def deviations(long: DataFrame, model: DataFrame, keys: Sequence[str], age: str, value: str,
               anchor: DataFrame | None = None, anchor_keys: Sequence[str] = (), name: str = "z") -> DataFrame:
    """Signed z deviation from the expected value; optionally re-centred to a site's controls."""
    m = model.select(*keys, "b0", "b1", "b2", "g0", "g1", "usable")
    sigma = F.greatest(F.exp(F.col("g0") + F.col("g1") * F.col(age) + LOG_ABS_TO_SD), F.lit(FLOOR))
    z = same_group(long, m, list(keys)).withColumn(
        name, F.when(F.col("usable"), (F.col(value) - trend(age)) / sigma)).drop(
        "b0", "b1", "b2", "g0", "g1", "usable")
    if anchor is None:
        return z
    return same_group(z, anchor.select(*anchor_keys, "shift", "scale"), list(anchor_keys), "left").withColumn(
        name, (F.col(name) - F.coalesce("shift", F.lit(0.0))) / F.coalesce("scale", F.lit(1.0))).drop("shift", "scale")


def site_anchor(z_controls: DataFrame, keys: Sequence[str], z: str = "z", hot: bool | None = None) -> DataFrame:
    """Median and 1.4826·MAD of a site's control deviations; the identity where undefined."""
    keys = list(keys)
    med = medians(z_controls, keys, z, "shift", hot)
    dev = same_group(z_controls, med, keys).withColumn("__d", F.abs(F.col(z) - F.col("shift")))
    mad = medians(dev, keys, "__d", "__m", hot)
    out = same_group(med, mad, keys, "left").withColumn("__s", 1.4826 * F.col("__m"))
    return out.select(*keys, "shift", F.when(F.col("__s") > FLOOR, F.col("__s")).otherwise(1.0).alias("scale"))


def abnormality(z: DataFrame, keys: Sequence[str], weight: Column | None = None, name: str = "abnormality") -> DataFrame:
    """Root mean square deviation over the measurable features."""
    w = F.lit(1.0) if weight is None else weight
    v = F.col("z")
    num, den = F.sum(w * v * v), F.sum(F.when(v.isNotNull(), w))
    return z.groupBy(*keys).agg(F.when(den > 0, F.sqrt(num / den)).alias(name))


def _by_fold(fit: DataFrame, keys: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """(keys, name): a map from held-out fold to the parameters of its model."""
    entry = F.struct("mfold", F.struct(*values))
    return fit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def _crossfit_spread(rows: DataFrame, keys: Sequence[str], y: str, age: str, value: str, k: int) -> DataFrame:
    """(keys, mfold, g0, g1): regression of the log absolute residual on the covariate over each model's training controls.

    Every row feeds the sums of all models but its own fold's; nothing is copied.
    """
    t = standard_age(F.col(age))
    sums = []
    for m in range(k):
        p = F.try_element_at("__fit", F.lit(m))
        log = F.log(F.abs(F.col(value) - (p["b0"] + p["b1"] * t + p["b2"] * t * t)) + FLOOR)
        log = F.when((F.col("fold") != m) & (F.col(y) == 0), log)
        tt = F.when(log.isNotNull(), t)
        sums += [F.struct(F.lit(m).alias("mfold"), F.count(log).cast("double").alias("n"), F.sum(tt).alias("t"), F.sum(tt * tt).alias("tt"),
                          F.sum(log).alias("l"), F.sum(tt * log).alias("tl"))]
    s = rows.groupBy(*keys).agg(F.array(*sums).alias("__s")).select(*keys, F.explode("__s").alias("__e")).select(*keys, "__e.*")
    det = F.col("n") * F.col("tt") - F.col("t") * F.col("t")
    ok = (F.col("n") > 1) & (det > 1e-12 * F.col("n") * F.col("tt"))
    slope = (F.col("n") * F.col("tl") - F.col("t") * F.col("l")) / det
    return s.select(*keys, "mfold", F.when(ok, (F.col("l") - slope * F.col("t")) / F.col("n")).alias("g0"), F.when(ok, slope).alias("g1"))


def crossfitted(long: DataFrame, keys: Sequence[str], sid: str, y: str, age: str, value: str, k: int,
                how: str = "residual") -> DataFrame:
    """(keys, repeat, mfold, fold, sid, y, x): features transformed by each fold's own reference.

    ``how`` is "residual" (trend of the training controls) or "normative" (their z deviation). A
    subject appears once per model, so the transform never sees the fold it is applied to. The parameters of all models of a feature are
    joined to its rows as one map; rows are gathered by subject once, and only feature lists are unfolded by model.
    """
    g = [*keys, "repeat", "feature"]
    t = standard_age(F.col(age))
    controls = F.col(y) == 0
    fit = solved(crossfit_sums(long, g, "fold", age, value, k, controls), [*g, "mfold"], 5 if how == "residual" else 30)
    rows = same_group(long, _by_fold(fit, g, ["b0", "b1", "b2"], "__fit"), g)
    if how != "residual":
        rows = stored(rows, "crossfit")
        rows = same_group(rows, _by_fold(_crossfit_spread(rows, g, y, age, value, k), g, ["g0", "g1"], "__spread"), g)

    def transformed(m):
        p = F.try_element_at("__fit", m)
        r = F.col(value) - (p["b0"] + p["b1"] * t + p["b2"] * t * t)
        if how == "residual":
            return r
        q = F.try_element_at("__spread", m)
        return r / F.greatest(F.exp(q["g0"] + q["g1"] * t + LOG_ABS_TO_SD), F.lit(FLOOR))

    models = F.sequence(F.lit(0), F.lit(k - 1))
    entry = F.struct("feature", F.array(*[transformed(F.lit(m)) for m in range(k)]).alias("v"))
    lists = rows.groupBy(*keys, "repeat", "fold", sid, y).agg(F.array_sort(F.collect_list(entry)).alias("__l"))
    each = lists.withColumn("mfold", F.explode(models))
    known = F.filter("__l", lambda e: F.get(e["v"], F.col("mfold")).isNotNull())
    x = F.transform(known, lambda e: F.get(e["v"], F.col("mfold")))
    return each.select(*keys, "repeat", "mfold", "fold", sid, y, x.alias("x")).filter(F.size("x") > 0)


def crossfit_scores(rows: DataFrame, keys: Sequence[str], sid: str, y: str, age: str, x: str, folds: str, k: int, repeats: int, how: str = "residual",
                    hot: bool | None = None) -> DataFrame:
    """(keys, sid, y, s): out-of-fold scores whose transform and model both come from the training folds, rank-averaged over repeats.

    ``rows`` has one row a subject with its features ``x`` and the fold of each repeat ``folds``. It is stored once; transforms and models are
    fitted by passes over it, and each model transforms the rows inside the pass, so that nothing is copied by repeat or fold.
    """
    keys, min_n = list(keys), 5 if how == "residual" else 30
    groups = ml.numbered_groups(rows, keys)
    own = same_group(rows, groups, keys).select(F.col("__g").alias("g"), F.col(sid).alias("sid"), F.col(y).alias("label"), F.concat(x, F.array(F.col(age).cast("double"))).alias("x"),
                                                F.array(F.col(y).cast("double")).alias("y"), F.col(folds).alias("f"))
    own = stored(own, "crossfit")
    blocks = [ml.Block(r * k + m, None, 0, [(r, m)]) for r in range(repeats) for m in range(k)]

    def powers(a):
        t = (a - CENTRE) / SPREAD
        return np.column_stack([np.ones(len(t)), t, t * t])

    def moments(key, v, label, mask):
        c = mask[:, 0] & (label == 0)
        a = powers(v[c, -1])
        return np.concatenate([(a.T @ a).ravel(), (a.T @ v[c, :-1]).ravel()])

    trends = {}
    for key, v in ml._block_sums(own, blocks, None, moments).items():
        gram, right = v[:9].reshape(3, 3), v[9:].reshape(3, -1)
        ok = gram[0, 0] >= min_n and abs(np.linalg.det(gram)) > 1e-12
        trends[key] = np.linalg.solve(gram, right) if ok else None
    spreads: dict = {}
    if how != "residual":
        def logs(key, v, label, mask):
            if trends.get(key) is None:
                return None
            c = mask[:, 0] & (label == 0)
            a = powers(v[c, -1])
            return np.concatenate([(a.T @ a).ravel(), (a.T @ np.log(np.abs(v[c, :-1] - a @ trends[key]) + FLOOR)).ravel()])

        for key, v in ml._block_sums(own, blocks, None, logs).items():
            (n, t, tt), (l, tl, _) = (v[0], v[1], v[2]), v[9:].reshape(3, -1)
            det = n * tt - t * t
            if n > 1 and det > 1e-12 * n * tt:
                slope = (n * tl - t * l) / det
                spreads[key] = (l - slope * t) / n, slope

    def transform(group, block, v):
        fit = trends.get((group, block))
        if fit is None or how != "residual" and (group, block) not in spreads:
            return v[:, :0]
        a = powers(v[:, -1])
        r = v[:, :-1] - a @ fit
        if how == "residual":
            return r
        g0, g1 = spreads[group, block]
        return r / np.maximum(np.exp(g0 + a[:, [1]] * g1 + LOG_ABS_TO_SD), FLOOR)

    models = {key: (b0[0], coef[0]) for key, (b0, coef, _, _) in ml.fit_blocks(own, blocks, transform=transform).items()}

    def decide(batches):
        for batch in batches:
            t, g = pa.Table.from_batches([batch]), batch["g"].to_numpy()
            out = np.full((len(g), repeats), np.nan)
            for group in np.unique(g):
                at = np.flatnonzero(g == group)
                v, f = ml._matrix(t["x"], at), ml._matrix(t["f"], at)
                for b in blocks:
                    (r, m), (b0, coef) = b.models[0], models[int(group), b.name]
                    held = np.flatnonzero(f[:, r] == m)
                    z = transform(int(group), b.name, v[held])
                    if z.shape[1]:
                        out[at[held], r] = z @ coef + b0
            flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
            d = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * repeats), flat)
            yield pa.RecordBatch.from_arrays([batch["g"], batch["sid"], batch["label"], d], ["g", "sid", "label", "d"])

    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    decided = own.select("g", "sid", "label", "x", "f").mapInArrow(decide, f"g int, sid {types['sid']}, label {types['label']}, d array<double>")
    scored = bt.ranked_decisions(decided, 1, repeats, hot).select(F.col("g").alias("__g"), F.col("sid").alias("__sid"), F.col("label").alias("__label"), "scores")
    return scored.join(groups, "__g").select(*keys, F.col("__sid").alias(sid), F.col("__label").alias(y), F.get("scores", F.lit(0)).alias("s"))


# ---- anchored reading -------------------------------------------------------------------------
def anchor_prefixes(picked: DataFrame, keys: Sequence[str], order: str, sid: str, z: str, ks: Sequence[int]) -> DataFrame:
    """(keys, k, ids, shift, scale): median and 1.4826*MAD of the first k anchors for every k of the grid, from one sorted pass.

    ``picked`` holds the anchors of a group by ``order``; a group has at most max(ks) of them.
    """
    keys, ks = list(keys), sorted(ks)
    types = {f.name: f.dataType.simpleString() for f in picked.schema.fields}

    def run(key: tuple, whole: pd.DataFrame) -> pd.DataFrame:
        out = []
        for last, pdf in whole.sort_values(order).groupby(keys[-1], sort=False):
            ids, rows = pdf[sid].tolist(), np.stack(pdf[z].to_list())
            kept: list[list[float]] = [[] for _ in range(rows.shape[1])]
            for i, row in enumerate(rows, 1):
                for column, v in zip(kept, row):
                    bisect.insort(column, v)
                if i in ks:
                    prefix = np.array(kept).T
                    shift = (prefix[(i - 1) // 2] + prefix[i // 2]) / 2
                    scale = 1.4826 * np.median(np.abs(prefix - shift), axis=0)
                    out.append((*key, last, i, ids[:i], shift.tolist(), np.where(scale > FLOOR, scale, 1.0).tolist()))
        return pd.DataFrame(out, columns=[*keys, "k", "ids", "shift", "scale"])

    # The last key is the draw: all draws of a group, each with a bounded number of anchors, are one task.
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], f"k int, ids array<{types[sid]}>, shift array<double>, scale array<double>"])
    return picked.groupBy(*keys[:-1]).applyInPandas(run, schema)


def anchored_counts(targets: DataFrame, anchors: DataFrame, match: Sequence[str], keys: Sequence[str], sid: str, cells: int) -> DataFrame:
    """(keys, draw, arm, k, case_hit, n_case, held_hit, n_held): every arm read on the controls that no anchor of the draw has used.

    ``targets`` has ``keys``, sid, y, z, the head (``coef``, ``intercept``, ``slope``, ``offset``) and ``threshold`` of the deviations, and ``p_direct``,
    ``t_direct``, ``p_normative``. They are dealt into ``cells`` by hash and meet the anchors of their ``match`` columns; counts add up over cells.
    """
    keys, match = list(keys), list(match)
    own = targets.withColumn("cell", F.pmod(F.xxhash64(sid), F.lit(cells)).cast("int"))
    dealt = anchors.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    types = {f.name: f.dataType.simpleString() for f in targets.schema.fields}
    names = [*keys, "draw", "arm", "k", "case_hit", "n_case", "held_hit", "n_held"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not len(left) or not len(right):
            return pd.DataFrame(out, columns=names)
        deepest = (right["k"] == right.groupby("draw")["k"].transform("max")).to_numpy()
        draws, ks, used = right["draw"].to_numpy(), right["k"].to_numpy(), right["ids"].to_list()
        shifts, scales = np.stack(right["shift"].to_list()), np.stack(right["scale"].to_list())
        for key, rows in left.groupby(keys, sort=False, dropna=False):
            y, place, head = rows["y"].to_numpy(), pd.Index(rows[sid]), rows.iloc[0]
            x, case, control = np.stack(rows["z"].to_list()), y == 1, y == 0
            plain = {"direct": rows["p_direct"].to_numpy() > rows["t_direct"].to_numpy(), "normative": rows["p_normative"].to_numpy() > head["threshold"]}
            # The rows of this cell among each draw's anchors: those are not held out.
            at = [place.get_indexer(ids) for ids in used]
            at = [i[i >= 0] for i in at]
            held = [int(control.sum()) - int(control[i].sum()) for i in at]
            weights = np.array(head["coef"]) / scales
            offsets = head["intercept"] - (shifts * weights).sum(axis=1)
            for lo in range(0, len(at), 64):
                d = head["slope"] * (x @ weights[lo:lo + 64].T + offsets[lo:lo + 64]) + head["offset"]
                flags = 1 / (1 + np.exp(-np.clip(d, -700, 700))) > head["threshold"]
                for j in range(flags.shape[1]):
                    i = lo + j
                    arms = {"anchored": flags[:, j]} | (plain if deepest[i] else {})
                    for arm, flag in arms.items():
                        passed = int((control & ~flag).sum()) - int((control[at[i]] & ~flag[at[i]]).sum())
                        out.append((*key, draws[i], arm, ks[i], int((case & flag).sum()), int(case.sum()), passed, held[i]))
        return pd.DataFrame(out, columns=names)

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "draw int, arm string, k int, case_hit bigint, n_case bigint, held_hit bigint, n_held bigint"])
    part = own.groupBy(*match, "cell").cogroup(dealt.groupBy(*match, "cell")).applyInPandas(run, schema)
    return part.groupBy(*names[:-4]).agg(*[F.sum(c).alias(c) for c in names[-4:]])
