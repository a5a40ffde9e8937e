"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: 64 bits over 4-word shingles. Two fingerprints link if at most ``budget`` bits differ.

The join walks pairs of trie nodes together, adds up differing bits and drops a pair once the budget is exceeded. To spread it, the
64 bits are cut into budget + 1 segments: a linked pair agrees on at least one of them, so the walk starts at the nodes of five
tries, one for each segment, whose top levels are free of errors. A start node with more than ``limit`` fingerprints is cut
again in the same way on its remaining bits; since equal fingerprints are merged first, this ends. No link is lost.
Links leave a task as spanning edges, so a group of copies gives no more edges than it has members.

Defined results: texts without words have fingerprint zero and link like any other; a null id is left out of the choice of the least
id; repeated rows fall into the same component.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.llm.components import components
from tidemark.session import stored

SHINGLE, BITS, BUDGET = 4, 64, 4
#: Fingerprints of one start node; and pairs of one vectorised walk.
LIMIT, WALK = 2_000, 4_000_000


def _hashes(data: bytes, shingle: int) -> list[int]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = data.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [digest(joined, 42)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[s:e], 42) for s, e in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes; a run of none gives zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[full]
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        over = (votes * 2 > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``body`` (hash of the text) and ``fp`` (the 64 bits as a long) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, hashes, counts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                own = _hashes(text.as_py() or b"", shingle)
                hashes += own
                counts.append(len(own))
                if len(hashes) > 100_000:
                    fps.append(_majority(np.array(hashes, np.uint64), np.array(counts)))
                    hashes, counts = [], []
            fps.append(_majority(np.array(hashes, np.uint64), np.array(counts, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(fps).view(np.int64))], ["doc_id", "body", "fp"])

    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("body"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, body long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _cuts(mask: int, parts: int) -> list[int]:
    """The bits that are not in ``mask`` in ``parts`` runs, each added to it."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    runs = [free[len(free) * i // parts:len(free) * (i + 1) // parts] for i in range(parts)]
    return [mask | sum(1 << b for b in run) for run in runs]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def start_nodes(fps: DataFrame, budget: int = BUDGET, limit: int = LIMIT) -> DataFrame:
    """``mask, head, fp``: each fingerprint once for every start node it lies in."""
    masks = _cuts(0, budget + 1)
    level = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    nodes = None
    while True:
        level = level.withColumn("head", F.col("fp").bitwiseAND(F.col("mask")))
        large = stored(level.groupBy("mask", "head").count().where(F.col("count") > limit).select("mask", "head"), "large-nodes")
        if large.isEmpty():
            return level if nodes is None else nodes.unionByName(level)
        small = level.join(large, ["mask", "head"], "left_anti").select("fp", "mask", "head")
        nodes = small if nodes is None else nodes.unionByName(small)
        deeper = F.create_map(*[F.lit(x) for m in masks for x in (
            _signed(m), F.array(*[F.lit(_signed(c)) for c in _cuts(m, budget + 1)]))])
        level = stored(level.join(large, ["mask", "head"], "left_semi").select("fp", F.explode(deeper[F.col("mask")]).alias("mask")), "deeper")
        masks = [c for m in masks for c in _cuts(m, budget + 1)]


def linked(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs inside runs of sorted, distinct fingerprints: the walk over pairs of trie nodes."""
    one = (np.empty(0, np.int64),) * 2
    own_lo, own_hi = starts[ends - starts > 1], ends[ends - starts > 1]
    cross = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.int8),)
    found = [one]
    for bit in range(BITS - 1, -1, -1):
        if not len(own_lo) and not len(cross[0]):
            break
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a, b, c, d, e = cross
        am, bm = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        mid = own_hi - (ones[own_hi] - ones[own_lo])
        nodes = [np.concatenate(x) for x in zip(
            (a, am, c, bm, e), (am, b, bm, d, e), (a, am, bm, d, e + 1), (am, b, c, bm, e + 1),
            (own_lo, mid, mid, own_hi, np.ones(len(mid), np.int8)))]
        live = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= budget)
        nodes = [x[live] for x in nodes]
        # Two single fingerprints need no further walk.
        single = (nodes[1] - nodes[0] == 1) & (nodes[3] - nodes[2] == 1)
        left, right = nodes[0][single], nodes[2][single]
        near = np.bitwise_count(fp[left] ^ fp[right]) <= budget
        found.append((left[near], right[near]))
        cross = tuple(x[~single] for x in nodes)
        lo, hi = np.concatenate([own_lo, mid]), np.concatenate([mid, own_hi])
        own_lo, own_hi = lo[hi - lo > 1], hi[hi - lo > 1]
    return tuple(np.concatenate(x) for x in zip(*found))


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position that each of ``n`` positions reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (root[left], root[right], left, right):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _edges(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the nodes in a partition sorted by node and fingerprint."""
    def flush(mask, head, fp):
        if not len(fp):
            return None
        new = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (head[1:] != head[:-1])]))
        ends = np.append(new[1:], len(fp))
        work = np.cumsum((ends - new) ** 2)
        lefts, rights = [], []
        for k in range(int(work[-1] // WALK) + 1):
            some = (work // WALK) == k
            if some.any():
                lo, hi = new[some][0], ends[some][-1]
                a, b = linked(fp[lo:hi], new[some] - lo, ends[some] - lo, budget)
                r = roots(hi - lo, a, b)
                far = np.flatnonzero(r != np.arange(hi - lo))
                lefts.append(fp[lo + far])
                rights.append(fp[lo + r[far]])
        if not lefts:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (lefts, rights)], ["u", "v"])

    kept = [np.empty(0, np.int64)] * 3
    for batch in batches:
        rows = [np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns)]
        if not len(rows[0]):
            continue
        open_node = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = int(np.flatnonzero(~open_node)[-1]) + 1 if not open_node.all() else 0
        if (out := flush(rows[0][:cut], rows[1][:cut], _sorted(rows, cut))) is not None:
            yield out
        kept = [r[cut:] for r in rows]
    if (out := flush(kept[0], kept[1], _sorted(kept, len(kept[0])))) is not None:
        yield out


def _sorted(rows: list[np.ndarray], cut: int) -> np.ndarray:
    """Fingerprints of whole nodes in unsigned order inside each node."""
    fp = rows[2][:cut].view(np.uint64)
    node = np.cumsum(np.concatenate([[0], (rows[0][1:cut] != rows[0][:cut - 1]) | (rows[1][1:cut] != rows[1][:cut - 1])])) if cut else fp
    return fp[np.lexsort((fp, node))] if cut else fp


def fingerprint_links(fps: DataFrame, budget: int = BUDGET, limit: int = LIMIT) -> DataFrame:
    """Spanning links ``u, v`` between distinct fingerprints."""
    nodes = start_nodes(fps, budget, limit).select("mask", "head", "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.repartition(parts, "mask", "head").sortWithinPartitions("mask", "head")
    return ordered.mapInArrow(lambda batches: _edges(batches, budget), "u long, v long")


def grouped(docs: DataFrame, budget: int = BUDGET, limit: int = LIMIT) -> DataFrame:
    """``doc_id, fp, body, root, component_id`` of every document: hash of its text, least fingerprint and least id of its component."""
    own = stored(fingerprints(docs), "fingerprints")
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(fingerprint_links(fps, budget, limit))
    placed = fps.join(root, fps["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select(F.col("fp").alias("key"), "root", "component_id")
    return own.join(named, own["fp"] == named["key"]).select("doc_id", "fp", "body", "root", "component_id")


def representatives(docs: DataFrame, budget: int = BUDGET, limit: int = LIMIT) -> DataFrame:
    """One document of each group, columns unchanged: the one of least id (null last), then of least hash of the text."""
    own = stored(grouped(docs, budget, limit).select("doc_id", "body", "root"), "groups")
    # Ids may repeat over unlike texts, so groups are told apart by root; a text lies in one group only.
    least = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("least"))
    least = stored(least.select(F.col("least.doc_id").alias("own_id"), F.col("least.body").alias("own_body")), "least")
    body = F.xxhash64(docs["text"])
    found = docs.join(least, docs["doc_id"].eqNullSafe(least["own_id"]) & (body == least["own_body"]))
    return found.select(whole(docs), least["own_id"], least["own_body"]).dropDuplicates(["own_id", "own_body"]).select("row.*")
