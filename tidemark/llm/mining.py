"""Hard negatives by Fagin's threshold algorithm.

A component x becomes the integer floor(256 x), a score is an integer inner product. In each block of candidates every dimension
has a list of the candidates sorted by component. For an anchor the lists are read in step, from the top where its component is positive
and from the bottom where it is negative, so that in each list the terms of the inner product only fall. Candidates met in any list are
scored by random access; the sum of the terms last read bounds all candidates not met yet. Reading stops when this
threshold is strictly below the k-th score of every window still wanted (strictly, as a tie may have a smaller id), or
below the window's lower end where it holds fewer than k.

The positives of an anchor are the best ``positives`` other rows of its label; a window of a positive with score p are the rows
of other labels with 80 p <= 100 s <= 100 p, of which the best ``negatives`` are returned.

Anchors and candidates meet in cells, a block of candidates by a batch of anchors, both of bounded size and dealt by the hash of a row
number, so neither labels nor ids of any frequency matter. Each cell returns at most k rows for an anchor or a window; the
best of all cells are found by rank within the anchor or the window.

Defined results: rows with a null label, a null or empty vector, or a null or non-finite component take no part; null ids are never
anchors and come last among ties; repeated rows are candidates each, an anchor leaves out only its own row; shorter vectors are
continued with zeros; an anchor without positives, or a window without rows, gives nothing. Scores that leave 64 bits stop the job in
Spark's own cast, never wrap.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.session import stored

ANCHOR_STEP, SHIFT_STEP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: Least and most candidates of a block, and anchors of a batch.
LEAST_BLOCK, MOST_BLOCK, BATCH = 2_048, 32_768, 1_024
FIRST_DEPTH = 16


def prepared(rows: DataFrame) -> DataFrame:
    """``uid, vec_id, label, data``: usable rows, labels shifted, components scaled and rounded down."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("label").isNotNull() & F.coalesce(finite & (F.size("embedding") > 0), F.lit(False)))
    label = F.when(F.col("vec_id") % SHIFT_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return usable.select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double") * 256).alias("data"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), lengths), np.concatenate([np.arange(n) for n in lengths]).astype(int)] = np.floor(np.asarray(lists.flatten()))
    return out


def exact(x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices of integers in the narrowest type whose inner products are exact."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0)) * max(1, x.shape[1])
    if bound < 2 ** 24:
        return x.astype(np.float32), a.astype(np.float32)
    if bound < 2 ** 53:
        return x, a
    return tuple(np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (x, a))


class Lists:
    """Candidates of a block with one sorted list a dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").T
        self.values = np.take_along_axis(x, self.order.T, axis=0).T

    def walk(self, a: np.ndarray):
        """Yields (rows met for the first time, their scores, threshold of the rest), deeper each time."""
        n = len(self.x)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        met = np.zeros(n, bool)
        done, depth = 0, FIRST_DEPTH
        while done < n:
            depth = min(depth, n)
            now = np.zeros(n, bool)
            now[self.order[up, n - depth:n - done].ravel()] = True
            now[self.order[down, done:depth].ravel()] = True
            if depth == n:
                now[:] = True
            new = np.flatnonzero(now & ~met)
            met[new] = True
            threshold = a[up] @ self.values[up, n - depth] + a[down] @ self.values[down, depth - 1]
            yield new, self.x[new] @ a, threshold
            done, depth = depth, depth * 2


def best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """The first k by falling score, then id, then row number."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((uids[some], ids[some], -scores[some]))][:k]


def top_of(lists: Lists, a: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores among which the k best are, without row ``skip``; the walk stops below the k-th score."""
    rows, scores = [], []
    for new, values, threshold in lists.walk(a):
        own = new != skip if skip is not None else np.ones(len(new), bool)
        rows.append(new[own])
        scores.append(values[own])
        have = np.concatenate(scores)
        if len(have) >= k and threshold < np.partition(have, len(have) - k)[len(have) - k]:
            break
    return np.concatenate(rows) if rows else np.empty(0, int), np.concatenate(scores) if scores else np.empty(0)


def windows_of(lists: Lists, a: np.ndarray, spans: list[tuple[int, int]], k: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores that hold the k best of every span (lowest and highest score); ``other`` marks the rows asked for."""
    rows, scores = [], []
    low, high = min(lo for lo, _ in spans), max(hi for _, hi in spans)
    for new, values, threshold in lists.walk(a):
        own = other[new] & (values >= low) & (values <= high)
        rows.append(new[own])
        scores.append(values[own])
        # While the threshold is at or above every lower end and no span can be full, no bar needs to be worked out.
        have = np.concatenate(scores)
        bars = []
        for lo, hi in spans:
            inside = have[(have >= lo) & (have <= hi)]
            bars.append(np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else lo)
        if threshold < min(bars):
            break
    return (np.concatenate(rows), np.concatenate(scores)) if rows else (np.empty(0, int), np.empty(0))


_LAST = np.iinfo(np.int64).max


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.fill_null(_LAST).combine_chunks(), np.int64)


def _longs(values: list) -> pa.Array:
    return pa.array([int(v) for v in values], pa.int64())


def _positives(k: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if candidates.num_rows and anchors.num_rows:
            width = max(int(np.asarray(t["data"].combine_chunks().value_lengths()).max()) for t in (candidates, anchors))
            x, a = exact(_matrix(candidates["data"], width), _matrix(anchors["data"], width))
            ids, uids, labels = _ids(candidates["vec_id"]), _ids(candidates["uid"]), _ids(candidates["label"])
            a_uids, a_labels = _ids(anchors["uid"]), _ids(anchors["label"])
            by_label = np.argsort(labels, kind="stable")
            for label in np.unique(a_labels):
                own = by_label[np.searchsorted(labels[by_label], label):np.searchsorted(labels[by_label], label, "right")]
                if not len(own):
                    continue
                lists = Lists(x[own])
                for i in np.flatnonzero(a_labels == label):
                    at = np.flatnonzero(uids[own] == a_uids[i])
                    rows, scores = top_of(lists, a[i], k, int(at[0]) if len(at) else None)
                    first = best(scores, ids[own[rows]], uids[own[rows]], k)
                    chosen = own[rows[first]]
                    for column, values in zip(out, ([a_uids[i]] * len(first), ids[chosen], uids[chosen], scores[first])):
                        column.extend(values)
        return pa.table([_longs(c) for c in out], ["anchor", "vec_id", "uid", "score"])

    return run


def _negatives(k: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if candidates.num_rows and anchors.num_rows:
            width = max(int(np.asarray(t["data"].combine_chunks().value_lengths()).max()) for t in (candidates, anchors))
            x, a = exact(_matrix(candidates["data"], width), _matrix(anchors["data"], width))
            ids, uids, labels = _ids(candidates["vec_id"]), _ids(candidates["uid"]), _ids(candidates["label"])
            a_uids, a_labels, tops = _ids(anchors["uid"]), _ids(anchors["label"]), anchors["tops"].to_pylist()
            lists = Lists(x)
            for i in range(len(a_uids)):
                # Equal scores of positives make equal windows: each is answered once.
                wanted = {p: [] for p in tops[i] if p >= 0}
                if not wanted:
                    continue
                spans = {p: (-(-80 * p // 100), p) for p in wanted}
                rows, scores = windows_of(lists, a[i], list(spans.values()), k, labels != a_labels[i])
                for p, (lo, hi) in spans.items():
                    inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                    first = inside[best(scores[inside], ids[rows[inside]], uids[rows[inside]], k)]
                    chosen = rows[first]
                    for column, values in zip(out, ([a_uids[i]] * len(first), [p] * len(first), ids[chosen], uids[chosen], scores[first])):
                        column.extend(values)
        return pa.table([_longs(c) for c in out], ["anchor", "top", "vec_id", "uid", "score"])

    return run


def _dealt(df: DataFrame, own: str, own_cells: int, other: str, other_cells: int) -> DataFrame:
    """Each row in its cell of ``own``, once for each cell of ``other``."""
    return (df.withColumn(own, F.pmod(F.xxhash64("uid"), F.lit(own_cells)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_cells - 1)))))


def mined(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, batch: int = BATCH,
          least_block: int = LEAST_BLOCK, most_block: int = MOST_BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and positive."""
    spark = rows.sparkSession
    own = stored(prepared(rows), "vectors")
    anchors = stored(own.where(F.col("vec_id") % ANCHOR_STEP == 0), "anchors")
    n, n_anchors = own.count(), anchors.count()
    size = min(most_block, max(least_block, n // (4 * spark.sparkContext.defaultParallelism)))
    blocks, batches = max(1, math.ceil(n / size)), max(1, math.ceil(n_anchors / batch))
    candidates = _dealt(own, "block", blocks, "batch", batches).groupBy("block", "batch")

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        return candidates.cogroup(_dealt(asked, "batch", batches, "block", blocks).groupBy("block", "batch")).applyInArrow(run, schema)

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "uid")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = stored(first(met(anchors, _positives(positives), "anchor bigint, vec_id bigint, uid bigint, score bigint"), ["anchor"], positives),
                  "positives")
    tops = near.groupBy("anchor").agg(F.collect_set("score").alias("tops")).withColumnRenamed("anchor", "uid")
    asked = stored(anchors.join(tops, "uid"), "windows")
    hard = first(met(asked, _negatives(negatives), "anchor bigint, top bigint, vec_id bigint, uid bigint, score bigint"), ["anchor", "top"], negatives)
    given = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = given.join(names, "anchor").join(
        hard.select("anchor", F.col("top").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")),
        ["anchor", "positive_score"])
    known = lambda c: F.when(F.col(c) != F.lit(_LAST), F.col(c)).alias(c)
    return pairs.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {SHIFT_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT * FROM s WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= {NEGATIVES}
"""
