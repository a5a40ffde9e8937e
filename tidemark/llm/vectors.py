"""Near-duplicate vectors by product quantisation.

Vectors are unit-scaled and assigned to coarse inverted lists; their residuals are coded in ``subspaces`` codebooks. Every vector
is a query against the ``probes`` lists nearest to it. In a list, distances between the query and the codes come from lookup tables
(asymmetric: the query is not coded). As each vector keeps the length of its own coding error, the triangle inequality turns the
lookup distance into a sure bound: no pair of the list above the threshold is passed over. What remains is ranked by the
exact cosine in double precision. So recall depends on the probes only; the tests measure it against brute force.

The index is fitted on at most ``sample`` vectors (the documented bound: those of lowest hash); every vector is indexed and queried.
Equal vectors are one entry with a count, so copies are never paired. A list with more than ``chunk`` members or queries is cut into
blocks of members by queries. A block returns, for each of its vectors, a count of links and one spanning edge: pairs are not
written. If only one side of a pair probes the other's list, its block counts for both sides.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component; vectors of
different lengths do not link; repeated rows count as vectors of their own.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.simhash import roots
from tidemark.session import stored

THRESHOLD, SAMPLE, PROBES, SUBSPACES, CODES, CHUNK, MOST_LISTS = 0.9, 32_768, 8, 8, 64, 2_048, 4_096


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out = []
    for at in range(0, len(x), 4_096):
        d = (centres * centres).sum(axis=1) - 2 * (x[at:at + 4_096] @ centres.T)
        if n >= len(centres):
            out.append(np.argsort(d, axis=1, kind="stable"))
            continue
        some = np.argpartition(d, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    draw = np.random.default_rng(29)
    centres = x[np.sort(draw.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse centres, and the codebooks of residuals: subspace, code, component."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows by subspace, padded with zeros."""
        parts, _, size = self.books.shape
        wide = np.zeros((len(x), parts * size))
        wide[:, :x.shape[1]] = x
        return wide.reshape(len(x), parts, size)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists to probe (own list first), codes, and lengths of the coding errors."""
        lists = _nearest(x, self.centres, min(self.probes, len(self.centres)))
        rest = self.split(x - self.centres[lists[:, 0]])
        codes = np.stack([_nearest(rest[:, m], self.books[m])[:, 0] for m in range(len(self.books))], axis=1)
        coded = self.books[np.arange(len(self.books)), codes]
        return lists, codes.astype(np.uint8), np.sqrt(((rest - coded) ** 2).sum(axis=(1, 2)))


def fit(x: np.ndarray, lists: int, probes: int = PROBES, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
    centres = k_means(x, lists)
    parts = min(subspaces, x.shape[1])
    index = Index(centres, np.zeros((parts, 1, math.ceil(x.shape[1] / parts))), probes)
    rest = index.split(x - centres[_nearest(x, centres)[:, 0]])
    books = [k_means(rest[:, m], codes, 6) for m in range(parts)]
    return Index(centres, np.stack(books), probes)


def _units(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _flat(column: pa.Array) -> list[bytes]:
    return [np.asarray(v.values, dtype="<f8").tobytes() for v in column]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``a, b, vector, copies, uid`` of every distinct vector, numbered."""
    groups = rows.groupBy("a", "b").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    return stored(groups.withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors")


def _sample(distinct: DataFrame, size: int, sample: int) -> np.ndarray:
    own = distinct.where(F.size("vector") == size).orderBy("a", "b").limit(sample).select("vector").toArrow()
    return _units(_flat(own.column("vector").combine_chunks()))


def indexed(distinct: DataFrame, index: Index, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data = _flat(batch.column(1))
            lists, codes, errors = index.encode(_units(data))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(data, pa.binary()), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32())),
                pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], ["uid", "copies", "data", "lists", "codes", "error"])

    own = distinct.where(F.size("vector") == size).select("uid", "vector", "copies")
    return stored(own.mapInArrow(run, "uid long, copies long, data binary, lists array<int>, codes binary, error double"), "indexed")


def blocks(vectors: DataFrame, chunk: int) -> DataFrame:
    """Members and queries of every list, in blocks of bounded size."""
    member = vectors.select(F.element_at("lists", 1).alias("list"), F.lit(True).alias("member"), *vectors.columns)
    asking = vectors.select(F.explode("lists").alias("list"), F.lit(False).alias("member"), *vectors.columns)
    rows = member.unionByName(asking)
    sizes = rows.groupBy("list").agg(*[
        F.greatest(F.ceil(F.sum(F.when(F.col("member") == m, 1).otherwise(0)) / chunk), F.lit(1)).cast("int").alias(name)
        for m, name in ((True, "members"), (False, "queries"))])
    # At most MOST_LISTS rows of three numbers.
    cut = rows.join(F.broadcast(sizes), "list")
    own = F.when(F.col("member"), F.pmod(F.xxhash64("uid"), "members")).otherwise(F.pmod(F.xxhash64("uid"), "queries")).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("queries")).otherwise(F.col("members")) - 1))
    cut = cut.withColumn("own", own).withColumn("across", across)
    return cut.select("list", F.when(F.col("member"), F.col("own")).otherwise(F.col("across")).alias("m"),
                      F.when(F.col("member"), F.col("across")).otherwise(F.col("own")).alias("q"), "member", *vectors.columns)


def links(block: pa.Table, index: Index, threshold: float) -> pa.Table:
    """Count of links and a spanning edge for every linked vector of one block."""
    out = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    flag = block.column("member").combine_chunks()
    members, asking = block.filter(flag), block.filter(pa.compute.invert(flag))
    if not members.num_rows or not asking.num_rows:
        return out.empty_table()
    here = block.column("list")[0].as_py()
    x, q = (_units(t.column("data").to_pylist()) for t in (members, asking))
    mu, qu = (t.column("uid").to_numpy() for t in (members, asking))
    mc, qc = (t.column("copies").to_numpy() for t in (members, asking))
    codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
    reach = math.sqrt(2 - 2 * threshold) + members.column("error").to_numpy() + 1e-9
    probed = members.column("lists").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
    home = asking.column("lists").combine_chunks().flatten().to_numpy().reshape(len(q), -1)[:, 0]
    lefts, rights = [], []
    step = max(1, 2_000_000 // len(x))
    for at in range(0, len(q), step):
        rest = index.split(q[at:at + step] - index.centres[here])
        distance = np.zeros((len(rest), len(x)))
        for m in range(len(index.books)):
            table = ((rest[:, m, None, :] - index.books[m][None]) ** 2).sum(axis=2)
            distance += table[:, codes[:, m]]
        a, b = np.nonzero(distance <= (reach * reach)[None])
        for s in range(0, len(a), 200_000):
            i, j = a[s:s + 200_000] + at, b[s:s + 200_000]
            near = ((q[i] * x[j]).sum(axis=1) >= threshold) & (qu[i] != mu[j])
            lefts.append(i[near])
            rights.append(j[near])
    if not lefts or not sum(map(len, lefts)):
        return out.empty_table()
    i, j = np.concatenate(lefts), np.concatenate(rights)
    # The other side counts the link itself if it probes this side's list.
    answered = (home[i] == here) | (probed[j] == home[i][:, None]).any(axis=1)
    uids, place = np.unique(np.concatenate([qu, mu]), return_inverse=True)
    a, b = place[:len(qu)][i], place[len(qu):][j]
    counts = np.bincount(a, mc[j], len(uids)) + np.bincount(b[~answered], qc[i][~answered], len(uids))
    root = roots(len(uids), a, b)
    some = np.unique(np.concatenate([a, b]))
    return pa.table([pa.array(uids[some]), pa.array(counts[some].astype(np.int64)), pa.array(uids[root[some]])], schema=out)


def linked(distinct: DataFrame, size: int, threshold: float, sample: int, probes: int, chunk: int) -> DataFrame:
    """``uid, links, root`` of the linked vectors of one length, from every block."""
    x = _sample(distinct, size, sample)
    total = distinct.where(F.size("vector") == size).count()
    index = fit(x, max(1, min(MOST_LISTS, len(x) // 8, int(4 * math.sqrt(total)))), probes)
    rows = blocks(indexed(distinct, index, size), chunk)
    return rows.groupBy("list", "m", "q").applyInArrow(lambda block: links(block, index, threshold), "uid long, links long, root long")


def grouped(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, probes: int = PROBES, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id`` of every row of ``vec_id, embedding``."""
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    own = own.select("*", _usable(F.col("vector")).alias("usable"), F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))
    distinct = distinct_vectors(own.where("usable"))
    # Lengths of vectors are a property of the model that made them: one, as a rule.
    found = None
    for row in distinct.groupBy(F.size("vector").alias("size")).count().orderBy("size").toLocalIterator():
        part = linked(distinct, row["size"], threshold, sample, probes, chunk)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = stored(found, "links")
    root = components(found.select("uid", "root"))
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    named = (distinct.select("a", "b", "uid", "copies", "least").join(counts, "uid", "left")
             .join(root, F.col("uid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "uid")))
    named = stored(named.select("a", "b", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("a", "b", "links", "component_id")
    single = own.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.where("usable").join(named, ["a", "b"]).select("vec_id", F.col("links").alias("n_links"), "component_id").unionByName(single)
