import random
import re

import numpy as np
import xxhash
from conftest import make_docs, prose
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_pairs(fps, budget=4):
    a = np.array(fps, np.uint64)
    return np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None]) <= budget, 1)).tolist()


def test_edges(edge_docs, edge_rows, no_docs):
    got = simhash.grouped(edge_docs).select("doc_id", simhash.hex_of(F.col("fp")).alias("fp"), "component_id").collect()
    fps = [fingerprint(t) for _, t, _ in edge_rows]
    assert sorted((r.doc_id or -1, r.fp) for r in got) == sorted((i or -1, f"{f:016x}") for (i, _, _), f in zip(edge_rows, fps))
    root = groups(len(fps), near_pairs(fps))
    least = {}
    for (i, _, _), r in zip(edge_rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((i or -1, least.get(r) or -1) for (i, _, _), r in zip(edge_rows, root))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == want
    kept = simhash.representatives(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == len(set(root))
    assert simhash.grouped(no_docs).collect() == [] and simhash.representatives(no_docs).collect() == []


def test_links_with_large_nodes(spark):
    """A ball of near fingerprints, unrelated ones, and a limit that cuts the start nodes again and again."""
    draw = random.Random(3)
    centre = draw.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        fps.add(draw.choice(sorted(fps)[:50]) ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 8))))
    while len(fps) < 700:
        fps.add(draw.getrandbits(64))
    fps = sorted(fps)
    want = groups(len(fps), near_pairs(fps))
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    for limit in (10, 2_000):
        edges = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long"), limit=limit)
        place = {r[0]: k for k, r in enumerate(rows)}
        pairs = [(place[r.u], place[r.v]) for r in edges.collect()]
        assert groups(len(fps), pairs) == want


def test_components(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(400, 480)] + [(500, k) for k in range(501, 600)]
    want = groups(600, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in enumerate(want) if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(spark):
    text = prose(7, 300)
    docs = make_docs(spark, [(k, text if k % 3 else text + f" end{k}", "s") for k in range(40)] + [(50, prose(8, 300), "s")])
    kept = simhash.representatives(docs).select("doc_id").toPandas()["doc_id"].tolist()
    assert sorted(kept) == [0, 50]


def test_groups_that_share_a_least_id_each_keep_one(spark):
    """An id repeated over unlike texts, once and as a hot key: every group keeps one document."""
    x, y = prose(11, 300), prose(12, 300)
    rows = [(3, x, "s"), (7, x + " end", "s"), (7, y, "s"), (7, y, "s")] + [(9, prose(100 + k, 80), "s") for k in range(60)]
    kept = simhash.representatives(make_docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == sorted({(3, x), (7, y), *((i, t) for i, t, _ in rows if i == 9)})
