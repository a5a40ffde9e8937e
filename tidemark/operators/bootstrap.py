"""Bootstrap statistics as mergeable vectors over replicates.

Each row draws its count in a replicate by hash (a Poisson count of mean 1 from the md5 of seed, block and id; one digest
serves four replicates). Counts are never rows: a task folds its rows, in blocks, into vectors with one entry a replicate, and only
those are shuffled, cut into chunks of replicates.

For an AUC the rows are range-sorted by group and score. A range keeps P and Q (weight of cases and of controls) and U (their ordered
pairs); neighbours compose as U = U1 + U2 + P2*Q1. The first and the last tie of a range stay apart until its neighbours are known,
so ranges may cut a tie anywhere. Moments of regressions just add.

Several scores of one row share its draws. While the wide rows of a group fit a task, a task takes a group and some replicates, draws
once and reads all scores with these counts.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import poisson_bounds
from tidemark.functions.scalars import ratio
from tidemark.operators.ordered import largest_group, same_group
from tidemark.session import stored

try:  # Python's own digest starts twice as fast on a few bytes as the one of OpenSSL.
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Replicates of one shuffled vector, rows folded at once, digests a range is cut for, and rows from which ranges grow no further in number.
CHUNK, BLOCK, DIGESTS, RANGE_ROWS = 256, 64, 500_000, 50_000
ROWS_AT_ONCE = 4096
#: Scores of a group that one task holds, and counts (one byte each) that it draws.
TASK_CELLS, TASK_COUNTS = 40_000_000, 64_000_000
_BOUNDS = np.array([int(b, 16) for b in poisson_bounds()], np.uint32)
#: Sums behind a weighted mean absolute error and correlation.
MOMENTS = ["w", "e", "y", "p", "yy", "pp", "yp"]


def counts(seed: str, ids: Sequence[str | None], n: int, first: int = 0, dtype=np.float64) -> np.ndarray:
    """Counts of each id (rows) in each of ``n`` replicates (columns) from ``first`` on, a multiple of four."""
    blocks = -(-n // 4)
    heads = [f"{seed}|{b}".encode() for b in range(first // 4, first // 4 + blocks)]
    tails = [b"" if i is None else b"|" + i.encode() for i in ids]
    raw = b"".join([md5(h + t).digest() for t in tails for h in heads])
    # The first eight hex digits of a digest are its first four bytes, and so on.
    draws = np.frombuffer(raw, ">u4").astype(np.uint32).reshape(len(ids), blocks * 4)[:, :n]
    return np.searchsorted(_BOUNDS, draws, "right").astype(dtype)


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of rows in a row with one key, null equal to null."""
    rows = list(zip(*[batch.column(i).to_pylist() for i in range(keys)])) if keys else [()] * batch.num_rows
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[at]:
            yield rows[at], at, i
            at = i


class Range:
    """Rows of one group in score order within one range: first tie, closed ties, last tie."""

    def __init__(self, n: int):
        self.head = self.last = None
        self.p, self.q, self.u = np.zeros(n), np.zeros(n), np.zeros(n)
        self.any = False

    def add(self, s: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        new = np.r_[True, ~((s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1])))]
        first = np.flatnonzero(new)
        values, p, q = s[first], np.add.reduceat(p, first, axis=0), np.add.reduceat(q, first, axis=0)
        if self.last is not None:
            if self.last[0] == values[0] or (np.isnan(self.last[0]) and np.isnan(values[0])):
                p[0] += self.last[1]
                q[0] += self.last[2]
            else:
                values, p, q = np.r_[self.last[0], values], np.vstack([self.last[1], p]), np.vstack([self.last[2], q])
        closed = slice(0, len(values) - 1)
        if self.head is None and len(values) > 1:
            self.head = (values[0], p[0], q[0])
            closed = slice(1, len(values) - 1)
        if closed.stop > closed.start:
            pc, qc = p[closed], q[closed]
            self.u += (pc * (np.cumsum(qc, axis=0) - qc / 2 + self.q)).sum(axis=0)
            self.p += pc.sum(axis=0)
            self.q += qc.sum(axis=0)
            self.any = True
        self.last = (values[-1], p[-1], q[-1])

    def parts(self) -> Iterator[tuple[int, float | None, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, score of a tie, P, Q, U) in order."""
        if self.head is not None:
            yield 0, self.head[0], self.head[1], self.head[2], self.head[1] * self.head[2] / 2
        if self.any:
            yield 1, None, self.p, self.q, self.u
        if self.last is not None:
            yield 2, self.last[0], self.last[1], self.last[2], self.last[1] * self.last[2] / 2


def chained(parts: Sequence[tuple[float | None, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, Q and U of parts in order; a tie cut by a border is closed first."""
    p, q, u = np.zeros_like(parts[0][1]), np.zeros_like(parts[0][1]), np.zeros_like(parts[0][1])
    i = 0
    while i < len(parts):
        s, pi, qi, ui = parts[i]
        i += 1
        if s is not None:
            while i < len(parts) and parts[i][0] is not None and (parts[i][0] == s or (np.isnan(s) and np.isnan(parts[i][0]))):
                pi, qi = pi + parts[i][1], qi + parts[i][2]
                i += 1
            ui = pi * qi / 2
        u += ui + pi * q
        p += pi
        q += qi
    return p, q, u


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    return ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [rest])


def _ranges_for(rows: int, n: int, parallelism: int) -> int:
    return int(max(1, min(-(-rows * (n // 4 + 1) // DIGESTS), max(4 * parallelism, rows // RANGE_ROWS))))


def weighted_aucs(s: np.ndarray, one: np.ndarray, zero: np.ndarray, w: np.ndarray) -> np.ndarray:
    """AUC of a score in every replicate; ``one`` and ``zero`` list cases and controls, ``w`` has the counts (rows by replicates)."""
    zero = zero[np.argsort(s[zero], kind="stable")]
    before = np.zeros((len(zero) + 1, w.shape[1]), np.int32)
    np.cumsum(w[zero], axis=0, dtype=np.int32, out=before[1:])
    lo, hi = (np.searchsorted(s[zero], s[one], side) for side in ("left", "right"))
    p, twice = np.zeros(w.shape[1], np.int64), np.zeros(w.shape[1], np.int64)
    for i in range(0, len(one), ROWS_AT_ONCE):
        at, a, b = one[i:i + ROWS_AT_ONCE], lo[i:i + ROWS_AT_ONCE], hi[i:i + ROWS_AT_ONCE]
        own, tied = w[at], np.flatnonzero(a != b)
        p += own.sum(axis=0, dtype=np.int64)
        twice += 2 * (own * before[a]).sum(axis=0, dtype=np.int64)
        twice += (own[tied] * (before[b[tied]] - before[a[tied]])).sum(axis=0, dtype=np.int64)
    u, pq = twice / 2, p.astype(float) * before[-1]
    return np.divide(u, pq, out=np.full(len(p), np.nan), where=pq > 0)


def _wide_aucs(wide: DataFrame, keys: Sequence[str], scores: Sequence[str], n: int, seed: str, most: int) -> DataFrame:
    """``aucs`` of rows (keys, __id, __y, __s0, __s1, ...) whose groups fit a task. Rows are copied by some hundred replicates, not by score."""
    some = int(max(4, min(CHUNK, TASK_COUNTS // max(1, most)) // 4 * 4))
    types = {f.name: f.dataType.simpleString() for f in wide.schema.fields}

    def read(table: pa.Table) -> pa.Table:
        first, ids, label = table["__c"][0].as_py(), table["__id"], np.asarray(table["__y"].fill_null(-1))
        w = np.empty((len(label), min(some, n - first)), np.uint8)
        for i in range(0, len(label), ROWS_AT_ONCE):
            w[i:i + ROWS_AT_ONCE] = counts(seed, ids.slice(i, ROWS_AT_ONCE).to_pylist(), w.shape[1], first, np.uint8)
        arms, got = [], []
        for i, arm in enumerate(scores):
            known = table[f"__s{i}"].is_valid().to_numpy()
            if known.any():
                arms.append(arm)
                got.append(weighted_aucs(table[f"__s{i}"].to_numpy(), np.flatnonzero(known & (label == 1)), np.flatnonzero(known & (label == 0)), w))
        size = w.shape[1] * len(arms)
        return pa.table([*[pa.array([table[c][0].as_py()] * size, table.schema.field(c).type) for c in keys], pa.array(np.repeat(np.array(arms, object), w.shape[1]), pa.string()),
                         pa.array(np.tile(np.arange(first, first + w.shape[1]), len(arms)), pa.int32()),
                         pa.array(np.concatenate(got) if got else np.empty(0), pa.float64(), from_pandas=True)], [*keys, "arm", "replicate", "auc"])

    each = wide.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(some))))
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "arm string, replicate int, auc double"])
    return each.groupBy(*keys, "__c").applyInArrow(read, schema)


def aucs(df: DataFrame, keys: Sequence[str], sid: str, y: str, scores: Sequence[str], n: int, seed: str) -> DataFrame:
    """(keys, replicate, arm, auc): every score read with the same weights; null where a replicate has one class only."""
    spark = df.sparkSession
    if len(scores) > 1:
        df = stored(df.select(*keys, F.col(sid).cast("string").alias("__id"), F.col(y).cast("double").alias("__y"),
                              *[F.col(c).cast("double").alias(f"__s{i}") for i, c in enumerate(scores)]), "boot")
        most = largest_group(df, keys)
        if most * (len(scores) + 2) <= TASK_CELLS:
            return _wide_aucs(df, keys, scores, n, seed, most)
        df, sid, y = df.withColumnsRenamed({f"__s{i}": c for i, c in enumerate(scores)}), "__id", "__y"
    arms = F.explode(F.array(*[F.struct(F.lit(s).alias("arm"), F.col(s).cast("double").alias("s")) for s in scores]))
    rows = df.select(*[F.col(k) for k in keys], F.col(sid).cast("string").alias("__id"), F.col(y).cast("double").alias("__y"), arms.alias("__a"))
    rows = stored(rows.select(*keys, F.col("__a.arm").alias("arm"), F.col("__a.s").alias("__s"), "__y", "__id").where("__s is not null"), "boot")
    keys = [*keys, "arm"]
    order = [*keys, "__s", "__h"]
    cut = rows.withColumn("__h", F.xxhash64("__id")).repartitionByRange(_ranges_for(rows.count(), n, spark.sparkContext.defaultParallelism), *order)
    cut = cut.sortWithinPartitions(*order).select(*keys, F.spark_partition_id().alias("__range"), "__s", "__y", "__id")
    k = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, at, types = None, None, None, None

        def sent():
            for place, s, p, q, u in own.parts():
                for c in range(0, n, CHUNK):
                    data = np.stack([v[c:c + CHUNK] for v in (p, q, u)]).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([v], t) for v, t in zip(key, types)], pa.array([at], pa.int32()), pa.array([place], pa.int32()),
                         pa.array([s], pa.float64()), pa.array([c], pa.int32()), pa.array([data], pa.binary())],
                        [*keys, "range", "place", "s", "chunk", "data"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(k)]
            if batch.num_rows:
                at = batch.column(k)[0].as_py()
            s, label = np.asarray(batch.column(k + 1), float), np.asarray(batch.column(k + 2).fill_null(-1), float)
            ids = batch.column(k + 3).to_pylist()
            for run, lo, hi in _runs(batch, k):
                if own is None or run != key:
                    if own is not None:
                        yield from sent()
                    own, key = Range(n), run
                for i in range(lo, hi, BLOCK):
                    part = slice(i, min(hi, i + BLOCK))
                    w = counts(seed, ids[part], n)
                    own.add(s[part], w * (label[part] == 1)[:, None], w * (label[part] == 0)[:, None])
        if own is not None:
            yield from sent()

    parts = cut.mapInArrow(fold, _schema(rows, keys, "range int, place int, s double, chunk int, data binary"))

    def chain(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table[c].to_pylist() for c in ("range", "place", "s", "data")]), key=lambda r: r[:2])
        p, q, u = chained([(s, *np.frombuffer(d, float).reshape(3, -1)) for _, _, s, d in rows])
        auc = np.divide(u, p * q, out=np.full(len(p), np.nan), where=p * q > 0)
        first = table["chunk"][0].as_py()
        return pa.table([*[pa.array([table[c][0].as_py()] * len(p), table.schema.field(c).type) for c in keys],
                         pa.array(np.arange(first, first + len(p)), pa.int32()), pa.array(auc, from_pandas=True)], [*keys, "replicate", "auc"])

    return parts.groupBy(*keys, "chunk").applyInArrow(chain, _schema(rows, keys, "replicate int, auc double"))


def regressions(df: DataFrame, keys: Sequence[str], sid: str, y: str, preds: Sequence[str], n: int, seed: str) -> DataFrame:
    """(keys, replicate, arm, mae, pcc): weighted mean absolute error and Pearson correlation of every prediction with the same weights."""
    spark = df.sparkSession
    keys = list(keys)
    arms = F.explode(F.array(*[F.struct(F.lit(s).alias("arm"), F.col(s).cast("double").alias("p")) for s in preds]))
    rows = df.select(*keys, F.col(sid).cast("string").alias("__id"), F.col(y).cast("double").alias("__y"), arms.alias("__a"))
    rows = rows.select(*keys, F.col("__a.arm").alias("arm"), "__id", "__y", F.col("__a.p").alias("__p")).where("__y is not null and __p is not null")
    keys = [*keys, "arm"]
    rows = stored(rows, "boot")
    # Moments are taken about the plain means, so that they do not cancel.
    means = rows.groupBy(*keys).agg(F.avg("__y").alias("__my"), F.avg("__p").alias("__mp"))
    centred = same_group(rows, means, keys).select(
        *keys, (F.col("__y") - F.col("__my")).alias("__y"), (F.col("__p") - F.col("__mp")).alias("__p"), F.abs(F.col("__p") - F.col("__y")).alias("__e"), "__id")
    ranges = _ranges_for(rows.count(), n, spark.sparkContext.defaultParallelism)
    cut = centred.withColumn("__h", F.xxhash64("__id")).repartitionByRange(ranges, *keys, "__h").sortWithinPartitions(*keys, "__h").drop("__h")
    k = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | None = None
        key, types = None, None

        def sent():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v] * n, t) for v, t in zip(key, types)], pa.array(np.arange(n), pa.int32()), *[pa.array(c) for c in sums]],
                [*keys, "replicate", *MOMENTS])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(k)]
            yv, pv, ev = (np.asarray(batch.column(k + i), float) for i in range(3))
            ids = batch.column(k + 3).to_pylist()
            for run, lo, hi in _runs(batch, k):
                if sums is None or run != key:
                    if sums is not None:
                        yield from sent()
                    sums, key = np.zeros((len(MOMENTS), n)), run
                for i in range(lo, hi, BLOCK):
                    c = slice(i, min(hi, i + BLOCK))
                    y0, p0 = yv[c], pv[c]
                    sums += np.stack([np.ones_like(y0), ev[c], y0, p0, y0 * y0, p0 * p0, y0 * p0]) @ counts(seed, ids[c], n)
        if sums is not None:
            yield from sent()

    part = cut.mapInArrow(fold, _schema(rows, keys, "replicate int, " + ", ".join(f"{m} double" for m in MOMENTS)))
    s = part.groupBy(*keys, "replicate").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    w, var = F.col("w"), lambda a, b: F.col(a + b) - F.col(a) * F.col(b) / F.col("w")
    # A spread that is rounding of the moments it comes from counts as none.
    flat = (var("y", "y") <= 1e-12 * F.col("yy")) | (var("p", "p") <= 1e-12 * F.col("pp"))
    pcc = F.when(~flat, var("y", "p") / F.sqrt(var("y", "y") * var("p", "p")))
    return s.where(w > 0).select(*keys, "replicate", ratio(F.col("e"), w).alias("mae"), pcc.alias("pcc"))


def regression_intervals(df: DataFrame, keys: Sequence[str], sid: str, y: str, pred: str, n: int, seed: str) -> DataFrame:
    """95 % bootstrap intervals of MAE and Pearson correlation per group."""
    ends = [F.percentile(c, F.lit(q)).alias(f"{c}_{e}") for c in ("mae", "pcc") for e, q in (("lo", 0.025), ("hi", 0.975))]
    return regressions(df, keys, sid, y, [pred], n, seed).groupBy(*keys).agg(*ends)
