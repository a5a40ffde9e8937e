import numpy as np
import pytest

from tidemark.llm import vectors

ROW = "vec_id long, embedding array<float>, label int, uid long, links string, root string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "", "") for i, v in rows], ROW)


def brute(rows):
    usable = {k: np.asarray(v, float) for k, (_, v) in enumerate(rows)
              if v and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))}
    root, count, links = list(range(len(rows))), [0] * len(rows), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in usable:
        for b in usable:
            if a < b and len(usable[a]) == len(usable[b]):
                if usable[a] @ usable[b] / np.sqrt((usable[a] @ usable[a]) * (usable[b] @ usable[b])) >= 0.9:
                    links.append((a, b))
                    count[a] += 1
                    count[b] += 1
                    root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return count, [least.get(find(k)) for k in range(len(rows))], len(links)


@pytest.mark.parametrize("chunk", [vectors.CHUNK, 40])
def test_groups_of_near_vectors(spark, chunk):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(250, 16))
    near = [b + draw.normal(size=16) * 0.15 for b in base[:5] for _ in range(30)]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate([*base, *near, *base[:20], *base[:1].repeat(60, axis=0)])]
    count, root, _ = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.grouped(frame(spark, rows), chunk=chunk).collect()}
    assert got == {i: (count[k], root[k]) for k, (i, _) in enumerate(rows)}


def test_recall_close_to_the_threshold(spark):
    draw = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(draw.normal(size=(3_000, 64)))
    turn = draw.normal(size=base.shape)
    turn = unit(turn - (turn * base).sum(axis=1, keepdims=True) * base)
    c = draw.uniform(0.901, 0.93, size=(len(base), 1))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([base, c * base + np.sqrt(1 - c * c) * turn]))]
    got = vectors.grouped(frame(spark, rows)).toPandas()
    x = np.array([v for _, v in rows], np.float32).astype(float)
    want = int(((x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9).sum() - len(x)) // 2
    assert got["n_links"].sum() // 2 >= 0.9 * want, (got["n_links"].sum() // 2, want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (None, [1.0, 0.01]), (None, None), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.05]), (12, [-1.0, -0.0])]
    count, root, _ = brute(rows)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in vectors.grouped(frame(spark, rows)).collect())
    assert got == sorted((i or -1, count[k], (root[k] if root[k] is not None else i) or -1) for k, (i, _) in enumerate(rows))
    assert vectors.grouped(frame(spark, [])).collect() == []
