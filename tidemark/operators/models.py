"""Small linear models as Spark jobs: one fit per key, scores as expressions.

A fit returns a table of coefficients on the raw feature scale with a ``converged`` flag, and scoring is a dot product in
the JVM. Groups that fit a task are handed to it as one Arrow batch. Larger groups are fitted by passes over all
partitions: every task sends one partial sum per model, so what is shuffled and collected is the size of the models,
never of the data, and at most ``MODELS_AT_ONCE`` large models at a time. Both ways solve the same problem with the
same scaling, tolerance and step limit.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.ordered import same_group
from tidemark.session import stored

MODEL_CONF, MODEL_DEFAULT = "spark.tidemark.modelGroupRows", 25_000
#: Fixed value: the penalty grid.
ALPHAS = np.logspace(-2, 3, 20)
MAX_STEPS, TOL, SHORTEST = 50, 1e-10, 1e-6
MODELS_AT_ONCE = 500


# ---- one model, in memory --------------------------------------------------------------------
def scale_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mu = x.mean(axis=0)
    return mu, usable_scale(mu, ((x - mu) ** 2).mean(axis=0))


def usable_scale(mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Standard deviations; 1 where the spread is rounding of the mean."""
    sd = np.sqrt(var)
    return np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mu)), sd, 1.0)


def gradient_limit(n):
    """The largest gradient of a settled fit over n rows: a share of n up to 1e-6, and above it what rounding leaves."""
    return np.maximum(np.minimum(TOL * np.maximum(1.0, n), 1e-6), 1e-15 * np.asarray(n))


def settled(g: np.ndarray, step: np.ndarray, w: np.ndarray, n: float) -> bool:
    """No gradient and nowhere to go; without an optimum the gradient fades but the steps do not."""
    return bool(np.abs(g).max() < gradient_limit(n) and np.abs(step).max() < 1e-6 * (1 + np.abs(w).max()))


def rises(new: float, old: float) -> bool:
    return new > old + 1e-9 * max(1.0, abs(old))


def logistic_terms(z1: np.ndarray, y: np.ndarray, w: np.ndarray, c: float) -> tuple:
    """Loss, gradient and curvature of the data term at w (first coefficient = intercept)."""
    eta = z1 @ w
    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
    loss = c * (np.logaddexp(0.0, eta) - y * eta).sum()
    return loss, c * (z1.T @ (p - y)), c * ((z1 * (p * (1 - p))[:, None]).T @ z1)


def ridge_mask(d: int, penalty: float) -> np.ndarray:
    return np.r_[0.0, np.full(d - 1, penalty)]


def newton_step(w, loss, grad, hess, penalty: float):
    """Penalised loss, gradient and Newton direction; the intercept is not penalised."""
    pen = ridge_mask(len(w), penalty)
    g, h = grad + pen * w, hess + np.diag(pen)
    return loss + 0.5 * (pen * w * w).sum(), g, np.linalg.lstsq(h, g, rcond=None)[0]


def fit_logistic(z: np.ndarray, y: np.ndarray, c: float = 1.0, penalty: float = 1.0) -> tuple[np.ndarray, bool]:
    """argmin ½·penalty·|w|² + c·Σ log-loss by Newton steps, halved while the loss rises; and whether it converged."""
    z1 = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(z1.shape[1])
    for _ in range(MAX_STEPS):
        obj, g, step = newton_step(w, *logistic_terms(z1, y, w, c), penalty)
        if settled(g, step, w, len(y)):
            return w, True
        t = 1.0
        while t > SHORTEST and rises(newton_step(w - t * step, *logistic_terms(z1, y, w - t * step, c), penalty)[0], obj):
            t /= 2
        w = w - t * step
    return w, settled(*newton_step(w, *logistic_terms(z1, y, w, c), penalty)[1:], w, len(y))


def raw_scale(w: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> tuple[float, np.ndarray]:
    coef = w[1:] / sd
    return float(w[0] - coef @ mu), coef


def ridge_path(gram: np.ndarray, zy: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients, inverse) for every penalty of the grid."""
    eye = np.eye(len(zy))
    return [(np.linalg.solve(gram + a * eye, zy), np.linalg.inv(gram + a * eye)) for a in ALPHAS]


def loo_errors(z: np.ndarray, yc: np.ndarray, n: int, path) -> np.ndarray:
    """Sum of squared leave-one-out residuals for every penalty of the path."""
    out = []
    for w, inv in path:
        h = 1.0 / n + np.einsum("ij,jk,ik->i", z, inv, z)
        out.append(float((((yc - z @ w) / (1 - h)) ** 2).sum()))
    return np.array(out)


# ---- grouped fit ------------------------------------------------------------------------------
def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_list()).astype(float) if len(col) else np.empty((0, 0))


def _fit_one(kind: str, x: np.ndarray, y: np.ndarray, c: float, penalty: float):
    mu, sd = scale_of(x)
    z = (x - mu) / sd
    if kind == "logistic":
        if len(np.unique(y)) < 2:
            return None
        w, converged = fit_logistic(z, y, c, penalty)
        return *raw_scale(w, mu, sd), converged
    yc = y - y.mean()
    path = ridge_path(z.T @ z, z.T @ yc)
    w = path[int(np.argmin(loo_errors(z, yc, len(y), path)))][0]
    return *raw_scale(np.r_[y.mean(), w], mu, sd), True


def _params_schema(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    cols = [f"`{k}` {types[k]}" for k in keys]
    return ", ".join([*cols, "mfold int", "intercept double", "coef array<double>", "n_train bigint", "converged boolean"])


def _in_task(kind, rows, keys, y, x, folds, c, penalty) -> DataFrame:
    keys = list(keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = _stack(pdf[x]), pdf[y].to_numpy(float)
        out = []
        for f in (range(folds) if folds else [-1]):
            m = pdf["fold"].to_numpy() != f if folds else np.ones(len(pdf), bool)
            if not m.any():
                continue
            fit = _fit_one(kind, xs[m], ys[m], c, penalty)
            if fit is not None:
                out.append((*key, f, fit[0], fit[1].tolist(), int(m.sum()), fit[2]))
        return pd.DataFrame(out, columns=[*keys, "mfold", "intercept", "coef", "n_train", "converged"])

    cols = [*keys, y, x] + (["fold"] if folds else [])
    return rows.select(*cols).groupBy(*keys).applyInPandas(run, _params_schema(rows, keys))


# ---- many models by passes ----------------------------------------------------------------------
#: Rows that a task reads together, and entries of their features, labels and folds.
ROWS_AT_ONCE, CELLS_AT_ONCE = 32_768, 4_000_000


class Block(NamedTuple):
    """Models over one design: feature columns (by group, or None for all), the label column, and for each model (fold column, fold left out)."""
    name: int
    columns: dict[int, Sequence[int]] | None
    label: int
    models: Sequence[tuple[int, int]]


def _matrix(column: pa.ChunkedArray, rows: np.ndarray | None = None) -> np.ndarray:
    """Lists of one length as a matrix, of the given rows or all."""
    column = column if rows is None else column.take(pa.array(rows))
    n = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def pieces(batch: pa.RecordBatch, columns: Sequence[str], extra: int = 0) -> list[pa.RecordBatch]:
    """A batch cut so that its list ``columns``, and ``extra`` more entries a row, stay within ``CELLS_AT_ONCE``; nothing is copied."""
    if not batch.num_rows:
        return []
    width = extra + sum(len(batch[c].flatten()) for c in columns) // batch.num_rows
    some = max(1, min(ROWS_AT_ONCE, CELLS_AT_ONCE // max(1, width)))
    return [batch.slice(lo, some) for lo in range(0, batch.num_rows, some)]


def _block_sums(rows: DataFrame, blocks: Sequence[Block], transform: Callable | None, stat: Callable) -> dict:
    """{(group, block): vector}: every task adds up ``stat`` over its rows, Spark adds up the tasks; one vector a group and block comes back.

    ``rows`` has g, x, y and f: group number, features, labels and folds (arrays; a negative fold is outside of every model).
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}

        def add(held: list) -> None:
            t = pa.Table.from_batches(held)
            g = t["g"].to_numpy()
            for group in np.unique(g):
                x, y, f = (_matrix(t[c], np.flatnonzero(g == group)) for c in ("x", "y", "f"))
                for b in blocks:
                    design = x if b.columns is None else x[:, b.columns[int(group)]]
                    if transform is not None:
                        design = transform(int(group), b.name, design)
                    fold = f[:, [c for c, _ in b.models]]
                    v = stat((int(group), b.name), design, y[:, b.label], (fold >= 0) & (fold != np.array([h for _, h in b.models])))
                    if v is not None:
                        key = int(group), b.name
                        acc[key] = acc[key] + v if key in acc else v

        held, n, cells = [], 0, 0
        for batch in batches:
            for part in pieces(batch, ("x", "y", "f")):
                size = sum(len(part[c].flatten()) for c in ("x", "y", "f"))
                if held and (n + part.num_rows > ROWS_AT_ONCE or cells + size > CELLS_AT_ONCE):
                    add(held)
                    held, n, cells = [], 0, 0
                held, n, cells = [*held, part], n + part.num_rows, cells + size
        if held:
            add(held)
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in acc], pa.int32()), pa.array([k[1] for k in acc], pa.int32()),
                                              pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["g", "b", "v"])

    def total(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(e.as_py()) for e in table["v"])
        return pa.table({"g": table["g"][:1], "b": table["b"][:1], "v": pa.array([v.tobytes()], pa.binary())})

    schema = "g int, b int, v binary"
    summed = rows.select("g", "x", "y", "f").mapInArrow(task, schema).groupBy("g", "b").applyInArrow(total, schema)
    return {(r["g"], r["b"]): np.frombuffer(r["v"]) for r in summed.collect()}


def fit_blocks(rows: DataFrame, blocks: Sequence[Block], c: float = 1.0, penalty: float = 1.0, transform: Callable | None = None) -> dict:
    """{(group, block): (intercepts, coefficients, rows, converged)} of all models of all groups, by passes over ``rows``.

    One pass serves every model; a model that has settled is left out of the next. What comes back to the driver has the size of the models.
    Each model is standardised by its own rows, which is a penalty of its own on the block's common scale.
    Folds start at the model of all their rows. ``transform(group, block, x)`` changes the features of a block.
    """
    whole = [b._replace(models=[(b.models[0][0], -1)]) for b in blocks if len(b.models) > 1]
    begin = fit_blocks(rows, whole, c, penalty, transform) if whole else {}
    size = {b.name: len(b.models) for b in blocks}

    def first(key, x, y, m):
        m = m.astype(float)
        return np.concatenate([m.sum(0), y @ m, (m.T @ x).ravel()])

    state = {}
    for key, v in _block_sums(rows, blocks, transform, first).items():
        n_models = size[key[1]]
        n, ones, sums = v[:n_models], v[n_models:2 * n_models], v[2 * n_models:].reshape(n_models, -1)
        state[key] = {"n": n, "ones": ones, "mean": sums / np.maximum(n, 1)[:, None], "mu": sums.sum(0) / max(1.0, n.sum())}
    means = {k: s["mean"] for k, s in state.items()}

    def second(key, x, y, m):
        return np.stack([(m * (x[:, [j]] - means[key][:, j]) ** 2).sum(0) for j in range(x.shape[1])], axis=1).ravel() if x.shape[1] else None

    squares = _block_sums(rows, blocks, transform, second)
    for key, s in state.items():
        n, mean, mu = s["n"], s["mean"], s["mu"]
        sq = squares.get(key, np.zeros(0)).reshape(mean.shape)
        scale = usable_scale(mu, (sq + n[:, None] * (mean - mu) ** 2).sum(0) / max(1.0, n.sum()))
        var = sq / np.maximum(n, 1)[:, None]
        usable = np.sqrt(var) > 1e-12 * np.maximum(1.0, np.abs(mean))
        d, count = len(mu), len(n)
        s.update(scale=scale, pen=np.column_stack([np.zeros(count), penalty * np.where(usable, var, 1.0) / scale ** 2]),
                 w=np.zeros((count, d + 1)), step=np.zeros((count, d + 1)), size=np.ones(count), best=np.full(count, np.inf), taken=np.zeros(count, int),
                 live=(s["ones"] > 0) & (s["ones"] < n), fits=(s["ones"] > 0) & (s["ones"] < n), fine=np.zeros(count, bool))
        if key in begin and not np.isnan(begin[key][0][0]):
            b0, coef = begin[key][0][0], begin[key][1][0]
            s["w"][:] = np.r_[b0 + coef @ mu, coef * scale]
    while any(s["live"].any() for s in state.values()):
        at = {k: (s["mu"], s["scale"], np.flatnonzero(s["live"]), (s["w"] - s["size"][:, None] * s["step"])[s["live"]].T)
              for k, s in state.items() if s["live"].any()}

        def terms(key, x, y, m, at=at):
            if key not in at:
                return None
            mu, scale, live, w = at[key]
            z1 = np.column_stack([np.ones(len(x)), (x - mu) / scale])
            m, eta = m[:, live].astype(float), z1 @ w
            small = np.exp(-np.abs(eta))
            p = np.where(eta >= 0, 1.0, small) / (1.0 + small)
            outer = np.einsum("ni,nj->nij", z1, z1).reshape(len(z1), -1)
            loss = (m * (np.maximum(eta, 0.0) + np.log1p(small) - y[:, None] * eta)).sum(0)
            return c * np.concatenate([loss, (z1.T @ (m * (p - y[:, None]))).ravel(), (outer.T @ (m * p * (1 - p))).ravel()])

        live_blocks = [b for b in blocks if any(k[1] == b.name for k in at)]
        for key, v in _block_sums(rows, live_blocks, transform, terms).items():
            s, (_, _, live, w) = state[key], at[key]
            d, count = w.shape
            pen, w = s["pen"][live], w.T
            loss = v[:count] + 0.5 * (pen * w * w).sum(1)
            g = v[count:count * (1 + d)].reshape(d, count).T + pen * w
            h = v[count * (1 + d):].reshape(d, d, count).transpose(2, 0, 1) + np.einsum("mi,ij->mij", pen, np.eye(d))
            rose = (s["size"][live] > SHORTEST) & (loss > s["best"][live] + 1e-9 * np.maximum(1.0, np.abs(s["best"][live])))
            s["size"][live[rose]] /= 2
            for i in np.flatnonzero(~rose):
                j, step = live[i], np.linalg.lstsq(h[i], g[i], rcond=None)[0]
                s["w"][j], s["step"][j], s["best"][j], s["size"][j] = w[i], step, loss[i], 1.0
                s["taken"][j] += 1
                s["fine"][j] = settled(g[i], step, w[i], s["n"][j])
                s["live"][j] = not s["fine"][j] and s["taken"][j] <= MAX_STEPS
    out = {}
    for key, s in state.items():
        raw = s["w"][:, 1:] / s["scale"]
        b0 = np.where(s["fits"], s["w"][:, 0] - raw @ s["mu"], np.nan)
        out[key] = b0, np.where(s["fits"][:, None], raw, np.nan), s["n"].astype(int), s["fine"]
    return out


# ---- distributed fit --------------------------------------------------------------------------
def _partial_sums(rows: DataFrame, keys: list[str], y: str, x: str, folds: int | None,
                  stat: Callable) -> dict:
    """{(key, fold): summed vector}: each task adds up ``stat`` over its rows, tasks are summed.

    ``stat(key, fold, X, y)`` returns a vector of model size.
    """
    cols = [*keys, y, x] + (["fold"] if folds else [])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(v) else v for v in key)
                xs, ys = _stack(g[x]), g[y].to_numpy(float)
                for f in (range(folds) if folds else [-1]):
                    m = g["fold"].to_numpy() != f if folds else slice(None)
                    v = stat(key, f, xs[m], ys[m])
                    if v is not None:
                        acc[key, f] = acc[key, f] + v if (key, f) in acc else v
        if acc:
            yield pd.DataFrame([(*k, f, i, s) for (k, f), v in acc.items() for i, s in enumerate(v)],
                               columns=[*keys, "mfold", "i", "s"])

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "mfold int", "i int", "s double"])
    summed = (rows.select(*cols).mapInPandas(task, schema)
              .groupBy(*keys, "mfold", "i").agg(F.sum("s").alias("s")))
    out: dict = {}
    for r in summed.toLocalIterator():
        out.setdefault((tuple(r[k] for k in keys), r["mfold"]), {})[r["i"]] = r["s"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _distributed(kind, rows, keys, y, x, folds, c, penalty) -> list[tuple]:
    keys = list(keys)
    if kind == "logistic":
        groups = numbered_groups(rows, keys)
        fold = F.col("fold").cast("int") if folds else F.lit(0)
        own = same_group(rows, groups, keys).select(F.col("__g").alias("g"), F.col(x).alias("x"), F.array(F.col(y).cast("double")).alias("y"), F.array(fold).alias("f"))
        own = stored(own, "fit")
        names = {r["__g"]: tuple(r[k] for k in keys) for r in groups.collect()}
        fits = fit_blocks(own, [Block(0, None, 0, [(0, f) for f in (range(folds) if folds else [-1])])], c, penalty)
        return [(*names[g], f if folds else -1, float(b0[f]), coef[f].tolist(), int(n[f]), bool(fine[f]))
                for (g, _), (b0, coef, n, fine) in fits.items() for f in range(len(b0)) if not np.isnan(b0[f])]
    rows = stored(rows.select(*keys, y, x, *(["fold"] if folds else [])), "fit")

    def sums(key, f, xs, ys):
        return np.r_[len(xs), ys.sum(), xs.sum(0)] if len(xs) else None

    means = {k: (v[0], v[1] / v[0], v[2:] / v[0]) for k, v in _partial_sums(rows, keys, y, x, folds, sums).items()}

    def squares(key, f, xs, ys):
        return ((xs - means[key, f][2]) ** 2).sum(0) if len(xs) else None

    base = {}
    for k, v in _partial_sums(rows, keys, y, x, folds, squares).items():
        n, share, mu = means[k]
        base[k] = [mu, usable_scale(mu, v / n), n, share]

    def scaled(key, f, xs):
        mu, sd = base[key, f][:2]
        return (xs - mu) / sd

    final: dict = {}
    done: set = set()

    def gram(key, f, xs, ys):
        if not len(xs):
            return None
        z = scaled(key, f, xs)
        return np.r_[z.T @ (ys - base[key, f][3]), (z.T @ z).ravel()]

    paths = {}
    for k, v in _partial_sums(rows, keys, y, x, folds, gram).items():
        d = len(base[k][0])
        paths[k] = ridge_path(v[d:].reshape(d, d), v[:d])

    def errors(key, f, xs, ys):
        if not len(xs):
            return None
        return loo_errors(scaled(key, f, xs), ys - base[key, f][3], int(base[key, f][2]), paths[key, f])

    for k, v in _partial_sums(rows, keys, y, x, folds, errors).items():
        final[k] = np.r_[base[k][3], paths[k][int(np.argmin(v))][0]]
        done.add(k)
    out = []
    for (key, f), w in final.items():
        b0, coef = raw_scale(w, base[key, f][0], base[key, f][1])
        out.append((*key, f, b0, coef.tolist(), int(base[key, f][2]), (key, f) in done))
    return out


def numbered_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __g): the groups that take passes, numbered; each has more rows than a task holds, so they are few."""
    schema = StructType([*rows.select(*keys).schema.fields, StructField("__g", IntegerType())])
    found = rows.select(*keys).distinct().collect()
    return F.broadcast(rows.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(found)], schema))


def fit(rows: DataFrame, keys: Sequence[str], y: str, x: str, folds: int | None = None,
        kind: str = "logistic", c: float = 1.0, penalty: float = 1.0,
        large: bool | None = None) -> DataFrame:
    """Coefficients per key, and per held-out fold when ``folds`` is given (column ``mfold``).

    ``x`` is an array column without nulls. Standardisation (population sd) is part of the fit.
    Keys with more rows than one task should hold are fitted by distributed passes.
    """
    keys = list(keys)
    spark = rows.sparkSession
    limit = int(spark.conf.get(MODEL_CONF, str(MODEL_DEFAULT)))
    if large is False:
        return _in_task(kind, rows, keys, y, x, folds, c, penalty)
    if not keys:
        return fit(rows.withColumn("__all", F.lit(0)), ["__all"], y, x, folds, kind, c, penalty, large).drop("__all")
    sizes = stored(rows.groupBy(*keys).count(), "sizes")
    big = sizes if large else sizes.filter(F.col("count") > limit)
    n_big = big.count()
    if not n_big:
        return _in_task(kind, rows, keys, y, x, folds, c, penalty)
    rows = stored(rows, "fit-rows")
    named = big.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [rows[k].eqNullSafe(named[f"__k_{k}"]) for k in keys]
    out = None if large else _in_task(kind, rows.join(named, on, "left_anti"), keys, y, x, folds, c, penalty)
    turns = -(-n_big // MODELS_AT_ONCE)
    for i in range(turns):
        some = rows.join(named, on, "left_semi")
        some = some if turns == 1 else some.filter(F.pmod(F.xxhash64(*keys), F.lit(turns)) == i)
        part = spark.createDataFrame(_distributed(kind, some, keys, y, x, folds, c, penalty), _params_schema(rows, keys))
        out = part if out is None else out.unionByName(part)
    return out


# ---- scoring ----------------------------------------------------------------------------------
def decision(x: Column, coef: Column, intercept: Column) -> Column:
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), intercept, lambda s, v: s + v)


def sigmoid(d: Column) -> Column:
    return 1 / (1 + F.exp(-d))


def scored(rows: DataFrame, params: DataFrame, keys: Sequence[str], x: str, name: str = "s",
           own_fold: bool = False) -> DataFrame:
    """Decision scores; with ``own_fold`` each row is scored by the model that did not see it."""
    p = params.select(*keys, *(["mfold"] if own_fold else []), "coef", "intercept")
    if own_fold:
        p = p.withColumnRenamed("mfold", "fold")
    on = [*keys, *(["fold"] if own_fold else [])]
    j = same_group(rows, p, on) if on else rows.crossJoin(F.broadcast(p))
    return j.withColumn(name, decision(F.col(x), F.col("coef"), F.col("intercept"))).drop("coef", "intercept")


def optimum(rows: DataFrame, params: DataFrame, keys: Sequence[str], y: str, x: str, d: str, penalty: float = 1.0) -> DataFrame:
    """(keys, n, at_optimum): whether the gradient of the penalised likelihood, taken from the training rows, vanishes.

    ``rows`` hold decisions ``d`` of the models in ``params``. On the standardised scale the gradient is sum e*(x - mean)/sd + penalty*coef*sd.
    """
    keys = list(keys)
    e = sigmoid(F.col(d)) - F.col(y)
    at = rows.select(*keys, e.alias("__e"), F.posexplode(x).alias("__i", "__x"))
    g = at.groupBy(*keys, "__i").agg(F.count("*").alias("n"), F.sum("__e").alias("__b"), F.sum(F.col("__e") * F.col("__x")).alias("__g"),
                                     F.avg("__x").alias("__m"), F.stddev_pop("__x").alias("__sd"))
    g = same_group(g, params.select(*keys, "coef"), keys).withColumn("__w", F.get("coef", F.col("__i")))
    sd = F.when(F.col("__sd") > 1e-12 * F.greatest(F.lit(1.0), F.abs("__m")), F.col("__sd")).otherwise(1.0)
    slope = (F.col("__g") - F.col("__b") * F.col("__m")) / sd + penalty * F.col("__w") * sd
    return g.groupBy(*keys).agg(F.max("n").alias("n"), F.bool_and((F.abs("__b") < 1e-5) & (F.abs(slope) < 1e-5)).alias("at_optimum"))


def feature_array(long: DataFrame, keys: Sequence[str], name: str = "x") -> DataFrame:
    """(keys, x): values in feature order; the group is one subject's feature list."""
    arr = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return long.groupBy(*keys).agg(F.transform(arr, lambda s: s["value"]).alias(name))


def out_of_fold(rows: DataFrame, keys: Sequence[str], sid: str, y: str, x: str, k: int = 5,
                repeats: int = 5, kind: str = "logistic", score_x: str | None = None,
                hot: bool | None = None, large: bool | None = None) -> DataFrame:
    """(keys, repeat, fold, id, y, s): cross-validated decisions, every repeat kept.

    ``score_x`` scores another variant of the features than the one the model was fitted on.
    """
    from tidemark.operators.folds import stratified
    keys = list(keys)
    folded = stratified(rows, keys, sid, y, k, repeats, hot)
    params = fit(folded, [*keys, "repeat"], y, x, k, kind, large=large)
    out = scored(folded, params, [*keys, "repeat"], score_x or x, own_fold=True)
    return out.drop(x, *([score_x] if score_x else []))


def rank_mean(oof: DataFrame, keys: Sequence[str], sid: str, y: str, hot: bool | None = None) -> DataFrame:
    """Rank fraction inside each repeat, then the mean over repeats."""
    from tidemark.operators.operating import rank_fraction
    f = rank_fraction(oof, [*keys, "repeat"], "s", "__f", hot)
    return f.groupBy(*keys, sid, y).agg(F.avg("__f").alias("s"))


# ---- Platt calibration ------------------------------------------------------------------------
def calibrated(oof: DataFrame, keys: Sequence[str], y: str, s: str, large: bool | None = None) -> DataFrame:
    """(keys, slope, offset) of the sigmoid on out-of-fold decisions, with smoothed targets."""
    keys = list(keys)
    n = oof.groupBy(*keys).agg(F.sum(F.col(y).cast("double")).alias("__n1"), F.count("*").alias("__n"))
    t = F.when(F.col(y) == 1, (F.col("__n1") + 1) / (F.col("__n1") + 2)).otherwise(
        1 / (F.col("__n") - F.col("__n1") + 2))
    rows = same_group(oof, n, keys).select(
        *keys, t.alias("__t"), F.array(F.col(s)).alias("__x"))
    p = fit(rows, keys, "__t", "__x", None, "logistic", 1.0, 0.0, large)
    return p.select(*keys, F.element_at("coef", 1).alias("slope"), F.col("intercept").alias("offset"))
