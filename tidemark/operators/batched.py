"""Many small logistic models of one set of rows at once, and the cross-validations that are made of them.

Folds, repeats, subsets and label vectors are masks over the rows of a group. All models of one design are one tensor: every
Newton step is three matrix products for all of them, and a model that has settled leaves the batch. A group is one task and its
rows are there once, whatever the number of arms; a group over ``spark.tidemark.modelGroupRows`` rows takes the distributed
passes of ``models`` instead. Both ways solve the same problem.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import hash32
from tidemark.operators import models as ml
from tidemark.operators.folds import stratified
from tidemark.operators.operating import rank_fraction
from tidemark.operators.ordered import hot_limit, largest_group, same_group
from tidemark.session import stored

#: Entries of one rows-by-models array, and of the rows of a large group that one task deals into folds or ranks.
CELLS, TASK_CELLS = 4_000_000, 80_000_000


def _solve(z1: np.ndarray, y: np.ndarray, m: np.ndarray, pen: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (coefficients by models) and which converged; ``y`` and ``m`` are rows by models."""
    d, total = z1.shape[1], m.shape[1]
    outer = np.einsum("ni,nj->nij", z1, z1).reshape(len(z1), d * d)
    w, fine, live = np.zeros((d, total)), np.zeros(total, bool), np.arange(total)
    n = m.sum(axis=0)

    def loss_at(at: np.ndarray, some: np.ndarray, eta: np.ndarray) -> np.ndarray:
        return c * (m[:, some] * (np.logaddexp(0.0, eta) - y[:, some] * eta)).sum(axis=0) + 0.5 * (pen[:, some] * at * at).sum(axis=0)

    for turn in range(ml.MAX_STEPS + 1):
        at = w[:, live]
        eta = z1 @ at
        p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
        g = c * (z1.T @ (m[:, live] * (p - y[:, live]))) + pen[:, live] * at
        h = c * (outer.T @ (m[:, live] * p * (1 - p))).T.reshape(-1, d, d) + np.einsum("im,ij->mij", pen[:, live], np.eye(d))
        try:
            step = np.linalg.solve(h, g.T[:, :, None])[:, :, 0].T
        except np.linalg.LinAlgError:
            step = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(h, g.T)], axis=1)
        done = (np.abs(g).max(axis=0) < ml.gradient_limit(n[live])) & (np.abs(step).max(axis=0) < 1e-6 * (1 + np.abs(at).max(axis=0)))
        fine[live[done]] = True
        live, at, step, eta = live[~done], at[:, ~done], step[:, ~done], eta[:, ~done]
        if not len(live) or turn == ml.MAX_STEPS:
            break
        old, size, waiting = loss_at(at, live, eta), np.ones(len(live)), np.arange(len(live))
        while len(waiting):
            trial = at[:, waiting] - size[waiting] * step[:, waiting]
            rose = loss_at(trial, live[waiting], z1 @ trial) > old[waiting] + 1e-9 * np.maximum(1.0, np.abs(old[waiting]))
            waiting = waiting[rose & (size[waiting] > ml.SHORTEST)]
            size[waiting] /= 2
        w[:, live] = at - size * step
    return w, fine


def fit_masks(x: np.ndarray, y: np.ndarray, masks: np.ndarray, c: float = 1.0, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts, coefficients (models by features) on the raw scale, and which models converged; NaN for a mask with one class.

    Each model is standardised by the rows of its own mask, which here is a penalty of its own on one common scale.
    """
    mu, scale = ml.scale_of(x)
    z = (x - mu) / scale
    labels = np.broadcast_to(y[:, None] if y.ndim == 1 else y, masks.shape)
    d, total = x.shape[1], masks.shape[1]
    b0, coef, fine = np.full(total, np.nan), np.full((total, d), np.nan), np.zeros(total, bool)
    some = max(1, min(256, CELLS // max(1, len(x))))
    for lo in range(0, total, some):
        m = masks[:, lo:lo + some].astype(float)
        own = labels[:, lo:lo + some].astype(float)
        n, ones = m.sum(axis=0), (m * own).sum(axis=0)
        fits = np.flatnonzero((ones > 0) & (ones < n))
        if not len(fits):
            continue
        m, own, n = m[:, fits], own[:, fits], n[fits]
        mean = (z.T @ m) / n
        var = np.stack([(m * (z[:, [j]] - mean[j]) ** 2).sum(axis=0) / n for j in range(d)]) if d else np.empty((0, len(fits)))
        raw_mean = mean * scale[:, None] + mu[:, None]
        spread = np.sqrt(var) * scale[:, None]
        usable = spread > 1e-12 * np.maximum(1.0, np.abs(raw_mean))
        pen = np.vstack([np.zeros((1, len(fits))), penalty * np.where(usable, var, (1 / scale ** 2)[:, None])])
        w, good = _solve(np.column_stack([np.ones(len(z)), z]), own, m, pen, c)
        raw = w[1:] / scale[:, None]
        b0[lo + fits], coef[lo + fits], fine[lo + fits] = w[0] - mu @ raw, raw.T, good
    return b0, coef, fine


def stratified_folds(order: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Fold of each row: its position in ``order`` within its class, modulo k. ``order`` lists the rows."""
    out = np.zeros(len(y), int)
    for cls in (0, 1):
        own = order[y[order] == cls]
        out[own] = np.arange(len(own)) % k
    return out


def midranks(s: np.ndarray) -> np.ndarray:
    """Average ranks of the known values, 1-based."""
    _, at, n = np.unique(s, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def fractions(s: np.ndarray) -> np.ndarray:
    """Midrank over the count, by column; NaN stays out."""
    out = np.full(s.shape, np.nan)
    for j in range(s.shape[1]):
        known = np.flatnonzero(~np.isnan(s[:, j]))
        if len(known):
            out[known, j] = midranks(s[known, j]) / len(known)
    return out


def mean_rank(d: np.ndarray, partial: bool = False) -> np.ndarray:
    """Rank fractions averaged over the columns: NaN where one is missing, or with ``partial`` where all are."""
    f = fractions(d)
    if not partial:
        return f.mean(axis=1)
    n = (~np.isnan(f)).sum(axis=1)
    return np.divide(np.nansum(f, axis=1), n, out=np.full(len(f), np.nan), where=n > 0)


def auc_of(y: np.ndarray, s: np.ndarray) -> float:
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return float("nan")
    return float((fractions(s[:, None])[y == 1, 0].sum() * len(y) - n1 * (n1 + 1) / 2) / (n1 * n0))


def held_out(x: np.ndarray, y: np.ndarray, orders: Sequence[np.ndarray], k: int, inside: np.ndarray | None = None,
             score_x: np.ndarray | None = None) -> np.ndarray:
    """Decisions (rows by repeats) by the model that did not see the row; NaN outside ``inside`` and where no model could be fitted."""
    rows = np.arange(len(y)) if inside is None else np.flatnonzero(inside)
    place = np.full(len(y), -1)
    place[rows] = np.arange(len(rows))
    folds = [stratified_folds(place[o[place[o] >= 0]], y[rows], k) for o in orders]
    masks = np.stack([f != j for f in folds for j in range(k)], axis=1) if len(rows) else np.zeros((0, 0), bool)
    out = np.full((len(y), len(orders)), np.nan)
    if not len(rows):
        return out
    b0, coef, _ = fit_masks(x[rows], y[rows], masks)
    seen = (x if score_x is None else score_x)[rows]
    for r, f in enumerate(folds):
        model = r * k + f
        out[rows, r] = (seen * coef[model]).sum(axis=1) + b0[model]
    return out


def _lists(values: np.ndarray | pa.Array, n: int) -> pa.ListArray:
    """Values in a row as lists of ``n``; NaN becomes null."""
    if isinstance(values, np.ndarray):
        values = pa.array(values.ravel(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) // n + 1, dtype=np.int32) * n), values)


def _hashes(sid: str, repeats: int):
    return F.array(*[hash32(F.lit(r), F.col(sid)) for r in range(repeats)])


def _parts(spec: str | Sequence) -> list[tuple[str, Mapping | None]]:
    """(column, entries by key or None for all) of a design."""
    return [(p, None) if isinstance(p, str) else tuple(p) for p in ([spec] if isinstance(spec, str) else spec)]


def ranked_arms(label: np.ndarray, arms: int, repeats: int, decided: Callable[[int, int], np.ndarray], partial: bool,
                seen: Callable[[int, int, np.ndarray], None] | None = None) -> tuple[np.ndarray, list[float | None]]:
    """Mean rank fractions (rows by arms), and the AUC of every arm and repeat; one column of decisions is held at a time."""
    scores, aucs = np.full((len(label), arms), np.nan), []
    for b in range(arms):
        total, n = np.zeros(len(label)), np.zeros(len(label), np.int16)
        for r in range(repeats):
            d = decided(b, r)
            if seen is not None:
                seen(b, r, d)
            known = np.flatnonzero(~np.isnan(d))
            rank = midranks(d[known])
            one = label[known] == 1
            n1, n0 = int(one.sum()), int((label[known] == 0).sum())
            aucs.append(float(rank[one].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else None)
            total[known] += rank / max(1, len(known))
            n[known] += 1
        ok = n >= (1 if partial else repeats)
        scores[ok, b] = total[ok] / n[ok]
    return scores, aucs


def cross_validated(rows: DataFrame, keys: Sequence[str], sid: str, y: str, arms: Mapping[str, str | Sequence],
                    subsets: Sequence[str] = (), k: int = 5, repeats: int = 5, large: bool | None = None, hot: bool | None = None,
                    partial: bool = False, carry: Sequence[str] = (), keep: str | None = "repeats") -> DataFrame:
    """(keys, sid, y, carry, one column an arm): out-of-fold scores, rank-averaged over repeats; with ``keep`` also ``repeats``, for each
    column the decisions of every repeat, or ``aucs``, for each column their AUCs, in one row of a group and null in the others.

    An arm is a design, or a pair (tuple) of them, fitted on the first and scored on the second. A design is an array column or a list of
    them, side by side, so that what designs share is there once; a pair (column, {key: entries}) in the list takes some entries.
    ``subsets`` are boolean columns; each makes columns ``<subset>_<arm>`` from its own rows, refitted, and null elsewhere. A row that a repeat
    leaves without a model has no score, or with ``partial`` the average over the other repeats. ``carry`` are columns that stay with their row.
    """
    keys, carry = list(keys), list(carry)
    pairs = {a: tuple(_parts(e) for e in (v if isinstance(v, tuple) else (v, v))) for a, v in arms.items()}
    names = [f"{s}_{a}" for s in subsets for a in pairs] if subsets else list(pairs)
    columns = sorted({c for v in pairs.values() for design in v for c, _ in design})
    narrow = rows.select(*keys, sid, y, *subsets, *carry, *columns)
    limit = int(rows.sparkSession.conf.get(ml.MODEL_CONF, str(ml.MODEL_DEFAULT)))
    if large is None:
        narrow = stored(narrow, "arms")
        sizes = narrow.groupBy(*keys).count()
        big = stored(sizes.where(F.col("count") > limit).drop("count") if keys else sizes.where(F.col("count") > limit), "large-groups")
        large = not big.isEmpty()
        if large and keys:
            named = F.broadcast(big.withColumnsRenamed({c: f"__k_{c}" for c in keys}))
            on = [narrow[c].eqNullSafe(named[f"__k_{c}"]) for c in keys]
            few = narrow.join(named, on, "left_anti")
            by_passes = _by_passes(narrow.join(named, on, "left_semi"), keys, sid, y, pairs, subsets, k, repeats, hot, partial, carry, keep)
            if few.isEmpty():
                return by_passes
            return cross_validated(few, keys, sid, y, arms, subsets, k, repeats, False, partial=partial, carry=carry, keep=keep).unionByName(by_passes)
    elif large:
        narrow = stored(narrow, "arms")
    if large:
        return _by_passes(narrow, keys, sid, y, pairs, subsets, k, repeats, hot, partial, carry, keep)
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    extra = {None: [], "repeats": ["repeats array<array<double>>"], "aucs": ["aucs array<double>"]}[keep]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in (*keys, sid, y, *carry)], "scores array<double>", *extra])

    def run(table: pa.Table) -> pa.Table:
        # The designs of all arms stay in the Arrow table; one arm at a time is a matrix.
        at = pc.sort_indices(table.select([sid]), sort_keys=[(sid, "ascending")])
        label, h = table[y].take(at).to_numpy().astype(int), ml._matrix(table["__h"].take(at))
        orders = [np.argsort(h[:, r], kind="stable") for r in range(repeats)]
        insides = [table[s].take(at).to_numpy().astype(bool) if s else None for s in (subsets or [None])]
        key = tuple(table[c][0].as_py() for c in keys)

        def matrix(design) -> np.ndarray:
            made = [ml._matrix(table[c], at) if some is None else ml._matrix(table[c], at)[:, some[key]] for c, some in design]
            return made[0] if len(made) == 1 else np.hstack(made)

        score, per = (np.empty((len(label), len(names) * w)) for w in (1, repeats))
        for i, (inside, (a, b)) in enumerate((inside, pair) for inside in insides for pair in pairs.values()):
            fit_x = matrix(a)
            d = held_out(fit_x, label, orders, k, inside, None if a == b else matrix(b))
            per[:, i * repeats:(i + 1) * repeats], score[:, i] = d, mean_rank(d, partial)
        out = [*[table[c].take(at) for c in (*keys, sid, y, *carry)], _lists(score, len(names))]
        if keep == "repeats":
            out.append(_lists(_lists(per, repeats), len(names)))
        elif keep == "aucs":
            out.append(_once(ranked_arms(label, per.shape[1], 1, lambda b, r: per[:, b], partial)[1], len(label)))
        return pa.table(out, [*keys, sid, y, *carry, "scores", *([keep] if keep else [])])

    got = narrow.withColumn("__h", _hashes(sid, repeats)).groupBy(*keys).applyInArrow(run, schema)
    return got.select(*keys, sid, y, *carry, *[F.get("scores", F.lit(i)).alias(n) for i, n in enumerate(names)], *([keep] if keep else []))


def _once(values: list, n: int) -> pa.Array:
    """The list in the first of ``n`` rows, null in the others."""
    return pa.array([values] + [None] * (n - 1), pa.list_(pa.float64()))


def _folds(rows: DataFrame, subsets: Sequence[str], k: int, repeats: int, hot: bool | None) -> DataFrame:
    """(g, sid, f): the folds of a row in every subset and repeat as one array, -1 outside the subset. ``rows`` has g, sid, y and the subsets."""
    inside = F.array(*[F.when(F.col(s), F.lit(i)) for i, s in enumerate(subsets)]) if subsets else F.array(F.lit(0))
    each = rows.select("g", "sid", "y", F.explode(F.filter(inside, lambda v: v.isNotNull())).alias("s"))
    folded = stratified(each, ["g", "s"], "sid", "y", k, repeats, hot)
    at = F.col("s") * repeats + F.col("repeat")
    n = max(1, len(subsets)) * repeats
    return folded.groupBy("g", "sid").agg(F.array(*[F.coalesce(F.max(F.when(at == i, F.col("fold"))), F.lit(-1)) for i in range(n)]).alias("f"))


def ranked_decisions(decided: DataFrame, arms: int, repeats: int, hot: bool | None = None, partial: bool = False) -> DataFrame:
    """(g, sid, label, d, scores): for each arm the rank fraction inside its repeat and group, averaged over repeats; ``d`` lists decisions arm by arm."""
    types = {f.name: f.dataType.simpleString() for f in decided.schema.fields}
    decided = stored(decided, "decisions")
    most = largest_group(decided, ["g"])
    if most > hot_limit(decided.sparkSession):
        one = decided.select("g", "sid", F.posexplode("d").alias("i", "s")).filter("s IS NOT NULL")
        ranked = rank_fraction(one.withColumn("b", F.floor(F.col("i") / repeats)), ["g", "i"], "s", "__f", hot)
        mean = ranked.groupBy("g", "sid", "b").agg(F.avg("__f").alias("m"), F.count("*").alias("n"))
        wide = mean.groupBy("g", "sid").agg(F.array(*[F.max(F.when((F.col("b") == b) & (F.col("n") >= (1 if partial else repeats)), F.col("m"))) for b in range(arms)]).alias("scores"))
        return same_group(decided, wide, ["g", "sid"], "left")
    if arms > 1 and most * arms * repeats > CELLS:
        # A task ranks one arm of a group, as all of them are too wide for one.
        each = F.transform(F.sequence(F.lit(0), F.lit(arms - 1)), lambda b: F.struct(b.alias("b"), F.slice("d", b * repeats + 1, F.lit(repeats)).alias("d")))

        def rank_arm(table: pa.Table) -> pa.Table:
            s = mean_rank(ml._matrix(table["d"]), partial)
            return table.select(["g", "sid", "b"]).append_column("s", pa.array(s, from_pandas=True))

        ranked = decided.select("g", "sid", F.inline(each)).groupBy("g", "b").applyInArrow(rank_arm, f"g int, sid {types['sid']}, b int, s double")
        wide = ranked.groupBy("g", "sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda e: e["s"]).alias("scores"))
        return same_group(decided, wide, ["g", "sid"])

    def rank(table: pa.Table) -> pa.Table:
        d = ml._matrix(table["d"])
        s = np.column_stack([mean_rank(d[:, b * repeats:(b + 1) * repeats], partial) for b in range(arms)])
        return table.append_column("scores", _lists(s, arms))

    return decided.groupBy("g").applyInArrow(rank, ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", scores array<double>")


def _dealt(own: DataFrame, inside: Sequence[str], k: int, repeats: int) -> DataFrame:
    """``own`` (g, sid, y and more) with f, the folds of ``_folds``: the rows of a group meet in one task and are not sorted themselves."""
    # Eight hex digits as a signed number of 4 bytes, in the same order.
    h = F.transform(_hashes("sid", repeats), lambda v: (v - F.lit(2 ** 31)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name not in inside) + ", f array<tinyint>"

    def deal(table: pa.Table) -> pa.Table:
        at, label = pc.sort_indices(table.select(["sid"]), sort_keys=[("sid", "ascending")]).to_numpy(), table["y"].to_numpy()
        h = ml._matrix(table["__h"])
        f = np.full((len(label), max(1, len(inside)) * repeats), -1, np.int8)
        masks = [table[c].to_numpy().astype(bool) for c in inside] or [None]
        for r in range(repeats):
            order = at[np.argsort(h[at, r], kind="stable")]
            for cls in (0, 1):
                own = order[label[order] == cls]
                for i, m in enumerate(masks):
                    some = own if m is None else own[m[own]]
                    f[some, i * repeats + r] = np.arange(len(some)) % k
        return table.drop_columns(["__h", *inside]).append_column("f", _lists(pa.array(f.ravel()), f.shape[1]))

    return own.withColumn("__h", h).groupBy("g").applyInArrow(deal, schema)


def _by_passes(rows, keys, sid, y, pairs, subsets, k, repeats, hot, partial=False, carry=(), keep="repeats") -> DataFrame:
    """The same columns by passes over all (stored) rows, every arm, subset, repeat and fold in each pass.

    Rows go by group twice: to be dealt into folds, and to be decided and ranked, so that decisions are numbers of a task and not rows. A
    group with more than ``TASK_CELLS`` entries is dealt and ranked by ranges instead.
    """
    columns = sorted({c for v in pairs.values() for design in v for c, _ in design})
    groups = ml.numbered_groups(rows, keys) if keys else F.broadcast(rows.sparkSession.range(1).select(F.lit(0).alias("__g")))
    inside, carried = [f"in{i}" for i in range(len(subsets))], [f"c{i}" for i in range(len(carry))]
    own = same_group(rows, groups, keys).select(
        F.col("__g").alias("g"), F.col(sid).alias("sid"), F.col(y).alias("y"), *[F.col(s).alias(n) for s, n in zip((*subsets, *carry), (*inside, *carried))],
        *[F.col(c).alias(f"x{i}") for i, c in enumerate(columns)])
    places: dict = {c: {} for c in columns}
    names = [f"{s}_{a}" for s in subsets for a in pairs] if subsets else list(pairs)
    each = [(i, pair) for i in range(max(1, len(subsets))) for pair in pairs.values()]
    width, cells = len(each) * repeats, 0
    for r in own.groupBy("g").agg(F.count("*").alias("n"), *[F.max(F.size(f"x{i}")).alias(f"w{i}") for i in range(len(columns))]).collect():
        start = 0
        for i, c in enumerate(columns):
            places[c][r["g"]] = range(start, start + r[f"w{i}"])
            start += r[f"w{i}"]
        cells = max(cells, r["n"] * (start + max(1, len(subsets)) * repeats + len(carry) + len(names) + 2 + (width if keep == "repeats" else 0)))
    own = own.select("g", "sid", "y", *inside, *carried, F.concat(*[f"x{i}" for i in range(len(columns))]).alias("x"))
    whole = cells <= TASK_CELLS
    if whole:
        full = _dealt(own, inside, k, repeats)
    else:
        full = same_group(own, _folds(own.select("g", "sid", "y", *inside), inside, k, repeats, hot), ["g", "sid"], "left")
    outside = F.array_repeat(F.lit(-1).cast("tinyint"), max(1, len(subsets)) * repeats)
    f = F.coalesce(F.col("f").cast("array<tinyint>"), outside)
    full = stored(full.select("g", "sid", F.col("y").alias("label"), *carried, "x", F.array(F.col("y").cast("double")).alias("y"), f.alias("f")), "arms")
    key_of = {r["__g"]: tuple(r[c] for c in keys) for r in groups.collect()}

    def entries(design) -> dict[int, list[int]]:
        return {g: [at for c, some in design for at in (places[c][g] if some is None else [places[c][g][e] for e in some[key]])]
                for g, key in key_of.items() if g in places[columns[0]]}

    blocks = [ml.Block(b, entries(fit_x), 0, [(i * repeats + r, f) for r in range(repeats) for f in range(k)]) for b, (i, (fit_x, _)) in enumerate(each)]
    models = {key: (b0, coef) for key, (b0, coef, _, _) in ml.fit_blocks(full, blocks).items()}
    seen = [entries(score_x) for _, (_, score_x) in each]

    def decisions(group: int, b: int, r: int, design: np.ndarray, f: np.ndarray) -> np.ndarray:
        out, (b0, coef) = np.full(len(f), np.nan), models[group, b]
        own = f[:, each[b][0] * repeats + r]
        for fold in range(k):
            at = np.flatnonzero(own == fold)
            out[at] = design[at] @ coef[r * k + fold] + b0[r * k + fold]
        return out

    types = {f.name: f.dataType.simpleString() for f in full.schema.fields}
    kept = "".join(f", {c} {types[c]}" for c in carried)
    extra = {None: "", "repeats": ", d array<double>", "aucs": ", aucs array<double>"}[keep]

    def rank(table: pa.Table) -> pa.Table:
        group = table["g"][0].as_py()
        # The rows stay in the batches they came in.
        parts = [(ml._matrix(p["x"]), ml._matrix(p["f"])) for p in map(pa.Table.from_batches, ([b] for b in table.to_batches()))]
        d = np.empty((table.num_rows, width)) if keep == "repeats" else None

        def decided(b: int, r: int) -> np.ndarray:
            return np.concatenate([decisions(group, b, r, x[:, seen[b][group]], f) for x, f in parts])

        def note(b: int, r: int, v: np.ndarray) -> None:
            d[:, b * repeats + r] = v

        scores, aucs = ranked_arms(table["label"].to_numpy(), len(each), repeats, decided, partial, note if keep == "repeats" else None)
        out = table.select(["g", "sid", "label", *carried]).append_column("scores", _lists(scores, len(each)))
        if keep == "repeats":
            return out.append_column("d", _lists(d, width))
        return out if keep is None else out.append_column("aucs", _once(aucs, table.num_rows))

    def decide(batches):
        for batch in (p for whole in batches for p in ml.pieces(whole, ("x", "f"), width)):
            t = pa.Table.from_batches([batch])
            g = batch["g"].to_numpy()
            out = np.full((batch.num_rows, width), np.nan)
            for group in np.unique(g):
                own = np.flatnonzero(g == group)
                x, f = ml._matrix(t["x"], own), ml._matrix(t["f"], own)
                for b in range(len(each)):
                    design = x[:, seen[b][int(group)]]
                    for r in range(repeats):
                        out[own, b * repeats + r] = decisions(int(group), b, r, design, f)
            yield pa.RecordBatch.from_arrays([batch["g"], batch["sid"], batch["label"], *[batch[c] for c in carried], _lists(out, width)],
                                             ["g", "sid", "label", *carried, "d"])

    own = full.select("g", "sid", "label", *carried, "x", "f")
    head = f"g int, sid {types['sid']}, label {types['label']}{kept}"
    if whole:
        scored = own.groupBy("g").applyInArrow(rank, f"{head}, scores array<double>{extra}")
    else:
        decided = stored(own.mapInArrow(decide, f"{head}, d array<double>"), "decisions")
        scored = ranked_decisions(decided, len(each), repeats, hot, partial)
        if keep == "aucs":
            scored = same_group(scored, _aucs_of_groups(decided, len(each) * repeats, hot), ["g", "sid"], "left")
    scored = scored.withColumnsRenamed({c: f"__{c}" for c in ("g", "sid", "label", *carried, "scores", *{"repeats": ["d"], "aucs": ["aucs"]}.get(keep, []))})
    last = [F.col("__aucs").alias("aucs")] if keep == "aucs" else []
    if keep == "repeats":
        last = [F.array(*[F.slice("__d", 1 + lo, repeats) for lo in range(0, width, repeats)]).alias("repeats")]
    return scored.join(groups, "__g").select(
        *keys, F.col("__sid").alias(sid), F.col("__label").alias(y), *[F.col(f"__{n}").alias(c) for n, c in zip(carried, carry)],
        *[F.get("__scores", F.lit(b)).alias(n) for b, n in enumerate(names)], *last)


def _aucs_of_groups(decided: DataFrame, n: int, hot: bool | None) -> DataFrame:
    """(g, sid, aucs): the AUC of each of the ``n`` decisions of a group, at the lowest sid of the group."""
    from tidemark.operators import rankstats as rs
    a = rs.auc(decided.select("g", "label", F.posexplode("d").alias("i", "s")), ["g", "i"], "label", "s", hot=hot)
    lists = a.groupBy("g").agg(F.array(*[F.max(F.when(F.col("i") == i, F.col("auc"))) for i in range(n)]).alias("aucs"))
    return same_group(decided.groupBy("g").agg(F.min("sid").alias("sid")), lists, ["g"])


def fold_models(rows: DataFrame, keys: Sequence[str], sid: str, y: str, x: str, k: int = 5, repeats: int = 5, large: bool | None = None,
                hot: bool | None = None) -> DataFrame:
    """(keys, repeat, mfold, n_train, intercept, coef, converged): the models behind ``cross_validated``, all of a group in one batch."""
    keys = list(keys)
    limit = int(rows.sparkSession.conf.get(ml.MODEL_CONF, str(ml.MODEL_DEFAULT)))
    if large is None:
        large = largest_group(rows, keys) > limit
    if large:
        folded = stratified(rows.select(*keys, sid, y, x), keys, sid, y, k, repeats, hot)
        return ml.fit(folded, [*keys, "repeat"], y, x, k, large=True)
    narrow = rows.select(*keys, sid, y, x).withColumn("__h", _hashes(sid, repeats))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sid, kind="stable")
        label, h = pdf[y].to_numpy(int), np.stack(pdf["__h"].to_list())
        folds = [stratified_folds(np.argsort(h[:, r], kind="stable"), label, k) for r in range(repeats)]
        masks = np.stack([f != j for f in folds for j in range(k)], axis=1)
        b0, coef, fine = fit_masks(ml._stack(pdf[x]), label, masks)
        out = [(*key, i // k, i % k, int(masks[:, i].sum()), float(b0[i]), coef[i].tolist(), bool(fine[i])) for i in range(len(b0)) if not np.isnan(b0[i])]
        return pd.DataFrame(out, columns=[*keys, "repeat", "mfold", "n_train", "intercept", "coef", "converged"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "repeat int, mfold int, n_train bigint, intercept double, coef array<double>, converged boolean"])
    return narrow.groupBy(*keys).applyInPandas(run, schema)


def arm_aucs(scored: DataFrame, keys: Sequence[str], y: str, arms: Sequence[str], hot: bool | None = None) -> DataFrame:
    """(keys, arm, auc, n_pos, n_neg)."""
    from tidemark.operators import rankstats as rs
    return rs.arm_aucs(scored, keys, y, arms, hot)


def repeat_spread(scored: DataFrame, keys: Sequence[str], y: str, arms: Sequence[str], hot: bool | None = None) -> DataFrame:
    """(keys, arm, auc_sd): how far the AUC moves with the assignment of folds. ``scored`` was made with ``keep``, either way."""
    from tidemark.operators import rankstats as rs
    if "aucs" in scored.columns:
        n = F.size("aucs") / len(arms)
        per = scored.filter("aucs IS NOT NULL").select(*keys, n.cast("int").alias("__n"), F.posexplode("aucs").alias("__i", "auc"))
        return per.groupBy(*keys, F.element_at(F.array(*[F.lit(a) for a in arms]), (F.floor(F.col("__i") / F.col("__n")) + 1).cast("int")).alias("arm")).agg(
            F.stddev_pop("auc").alias("auc_sd"))
    per = scored.select(*keys, y, F.explode(F.arrays_zip(F.array(*[F.lit(a) for a in arms]).alias("arm"), F.col("repeats"))).alias("__e"))
    per = per.select(*keys, y, F.col("__e.arm").alias("arm"), F.posexplode("__e.repeats").alias("repeat", "s"))
    a = rs.auc(per, [*keys, "arm", "repeat"], y, "s", hot=hot)
    return a.groupBy(*keys, "arm").agg(F.stddev_pop("auc").alias("auc_sd"))


# ---- permutations -----------------------------------------------------------------------------
def permuted_aucs(rows: DataFrame, sid: str, y: str, x: str, n: int, seed: str, carried: str | None = None, k: int = 5, repeats: int = 5,
                  chunk: int = 25) -> DataFrame:
    """(perm, auc): the whole cross-validation under permuted labels; -1 is the observed order.

    ``carried`` moves together with the label and joins the design as its last column. Each task takes ``chunk`` permutations
    over all rows, so rows are copied once a chunk. Without ``carried`` the design is one for all, and labels are columns of one batch.
    """
    narrow = rows.select(F.col(sid).alias("id"), F.col(y).cast("int").alias("y"), F.col(x).alias("x"),
                         (F.col(carried) if carried else F.lit(0.0)).cast("double").alias("c"), _hashes(sid, repeats).alias("h"))
    cells = F.explode(F.sequence(F.lit(-1), F.lit(n - 1), F.lit(chunk)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, y0, c0, x0 = pdf["id"].astype(str).to_list(), pdf["y"].to_numpy(int), pdf["c"].to_numpy(float), ml._stack(pdf["x"])
        h = np.stack(pdf["h"].to_list())
        orders = [np.argsort(h[:, r], kind="stable") for r in range(repeats)]
        first = int(pdf["from"].iloc[0])
        perms = range(first, min(first + chunk, n))
        moved = []
        for p in perms:
            draw = np.array([int(hashlib.md5(f"{seed}|{p}|{i}".encode()).hexdigest()[:8], 16) for i in ids]) if p >= 0 else None
            moved.append(np.arange(len(ids)) if draw is None else np.argsort(draw, kind="stable"))
        if carried:
            scores = [held_out(np.column_stack([x0, c0[m]]), y0[m], orders, k) for m in moved]
        else:
            folds = [[stratified_folds(o, y0[m], k) for o in orders] for m in moved]
            masks = np.stack([f != j for fs in folds for f in fs for j in range(k)], axis=1)
            labels = np.repeat(np.stack([y0[m] for m in moved], axis=1), repeats * k, axis=1)
            b0, coef, _ = fit_masks(x0, labels, masks)
            scores = []
            for i, fs in enumerate(folds):
                model = [(i * repeats + r) * k + f for r, f in enumerate(fs)]
                scores.append(np.stack([(x0 * coef[m]).sum(axis=1) + b0[m] for m in model], axis=1))
        aucs = [auc_of(y0[m], fractions(s).mean(axis=1)) for m, s in zip(moved, scores)]
        base = [auc_of(y0[m], c0[m]) for m in moved]
        return pd.DataFrame({"perm": list(perms), "auc": aucs, "auc_carried": base})

    return narrow.withColumn("from", cells).groupBy("from").applyInPandas(run, "perm int, auc double, auc_carried double")


def permutation_aucs(rows: DataFrame, sid: str, y: str, x: str, n: int, seed: str, carried: str | None = None, k: int = 5, repeats: int = 5,
                     large: bool | None = None, hot: bool | None = None) -> DataFrame:
    """``permuted_aucs`` while all rows fit one task that fits models, else by passes that serve all permutations: (perm, auc)."""
    limit = int(rows.sparkSession.conf.get(ml.MODEL_CONF, str(ml.MODEL_DEFAULT)))
    if large is False or (large is None and rows.count() <= limit):
        return permuted_aucs(rows, sid, y, x, n, seed, carried, k, repeats).select("perm", "auc")
    from tidemark.operators import rankstats as rs
    from tidemark.operators.resample import permuted
    own = stored(rows.select(F.col(sid).alias("sid"), F.col(y).cast("int").alias("y"), (F.col(carried) if carried else F.lit(0.0)).cast("double").alias("c"), F.col(x).alias("x")),
                 "permuted")
    moved = permuted(own.select("sid", "y", "c"), [], "sid", ["y", "c"], n, seed, hot).unionByName(own.select("sid", "y", "c", F.lit(-1).alias("perm")))
    lists = moved.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("perm", "y", "c"))).alias("l"))
    lists = stored(lists.select("sid", F.transform("l", lambda e: e["y"].cast("tinyint")).alias("label"), F.transform("l", lambda e: e["c"]).alias("c")), "permuted")
    folds = _permuted_folds(lists.select("sid", "label"), k, repeats)
    full = own.select("sid", "x").join(lists, "sid").join(folds, "sid")
    wide = F.concat("x", "c") if carried else F.col("x")
    full = stored(full.select(F.lit(0).alias("g"), "sid", wide.alias("x"), F.col("label").cast("array<double>").alias("y"), "f"), "permuted")
    width = own.select(F.size("x")).first()
    d = width[0] if width else 0
    columns = [[*range(d), d + p] if carried else list(range(d)) for p in range(n + 1)]
    blocks = [ml.Block(p, {0: columns[p]}, p, [(r * (n + 1) + p, h) for r in range(repeats) for h in range(k)]) for p in range(n + 1)]
    models = {p: (b0, coef) for (_, p), (b0, coef, _, _) in ml.fit_blocks(full, blocks).items()}

    def decide(batches):
        for batch in batches:
            t, rows_in = pa.Table.from_batches([batch]), batch.num_rows
            v, label, f = (ml._matrix(t[c]) for c in ("x", "y", "f"))
            for p, (b0, coef) in models.items():
                out = np.empty((rows_in, repeats))
                for r in range(repeats):
                    m = r * k + f[:, r * (n + 1) + p].astype(int)
                    out[:, r] = (v[:, columns[p]] * coef[m]).sum(axis=1) + b0[m]
                flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
                each = pa.ListArray.from_arrays(pa.array(np.arange(rows_in + 1, dtype=np.int32) * repeats), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows_in, p - 1, np.int32)), batch["sid"], pa.array(label[:, p].astype(np.int32)), each], ["g", "sid", "label", "d"])

    kind = full.schema["sid"].dataType.simpleString()
    decided = full.select("sid", "x", "y", "f").mapInArrow(decide, f"g int, sid {kind}, label int, d array<double>")
    scored = ranked_decisions(decided, 1, repeats, hot).select(F.col("g").alias("perm"), F.col("label").alias("y"), F.get("scores", F.lit(0)).alias("s"))
    return rs.auc(scored, ["perm"], "y", "s", hot=hot).select("perm", "auc")


def _permuted_folds(labels: DataFrame, k: int, repeats: int) -> DataFrame:
    """(sid, f): stratified folds of every repeat and label vector, repeat by repeat. ``labels`` has sid and the labels of a row, one a vector.

    The hash order of a repeat is the same for all label vectors: rows are sorted once a repeat into ranges, and the counts of the classes
    before a row are running sums of vectors, carried in from earlier ranges.
    """
    n = max(1, -(-labels.count() // int(labels.sparkSession.conf.get(ml.MODEL_CONF, str(ml.MODEL_DEFAULT)))))
    each = labels.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("h", hash32(F.col("r"), F.col("sid")))
    cut = stored(each.repartitionByRange(n * repeats, "r", "h", "sid").withColumn("part", F.spark_partition_id()), "ranges")

    def count(table: pa.Table) -> pa.Table:
        own = ml._matrix(table["label"]).astype(np.int64)
        return pa.table({"r": table["r"][:1], "part": table["part"][:1], "rows": pa.array([len(own)], pa.int64()), "ones": pa.array([own.sum(axis=0).tolist()], pa.list_(pa.int64()))})

    before, last = {}, {}
    for row in sorted(cut.groupBy("r", "part").applyInArrow(count, "r int, part int, rows bigint, ones array<bigint>").collect()):
        start = last.get(row["r"], (0, 0))
        before[row["r"], row["part"]] = start
        last[row["r"]] = start[0] + row["rows"], start[1] + np.array(row["ones"])

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("sid", "ascending")])
        own = ml._matrix(table["label"]).astype(np.int64)
        rows, ones = before[table["r"][0].as_py(), table["part"][0].as_py()]
        ahead = np.cumsum(own, axis=0) - own + ones
        fold = np.where(own == 1, ahead, rows + np.arange(len(own))[:, None] - ahead) % k
        ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1])
        return pa.table({"sid": table["sid"], "r": table["r"], "f": pa.ListArray.from_arrays(ends, pa.array(fold.astype(np.int8).ravel()))})

    kind = labels.schema["sid"].dataType.simpleString()
    placed = cut.groupBy("r", "part").applyInArrow(place, f"sid {kind}, r int, f array<tinyint>")
    return placed.groupBy("sid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "f"))), lambda e: e["f"])).alias("f"))
