from hashlib import md5

import numpy as np
import pytest

from tidemark.operators import priority as pr


def brute(data, caliper):
    """The sequential loop: (group, id, y, value) rows; pairs of values by case id."""
    h = lambda i: int(md5(f"match|{i}".encode()).hexdigest()[:8], 16)
    out = {}
    for g in {r[0] for r in data}:
        free = sorted(((x, h(i), i) for k, i, y, x in data if k == g and y == 0 and x is not None and np.isfinite(x)))
        for _, i, x in sorted((h(i), i, x) for k, i, y, x in data if k == g and y == 1 and x is not None and np.isfinite(x)):
            near = min(free, key=lambda c: (abs(c[0] - x), c), default=None)
            if near and abs(near[0] - x) <= caliper:
                free.remove(near)
                out[g, i] = (x, near[2], near[0])
    return out


def make(seed, n, spread, share=0.5, digits=0):
    rng = np.random.default_rng(seed)
    values = np.round(rng.gamma(2.0, spread, n), digits)
    return [("a" if i % 3 else None, i, int(rng.random() < share), float(values[i])) for i in range(n)]


SCHEMA = "g string, id bigint, y int, age double"


def same(spark, data, caliper, **kw):
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = pr.priority_match(df, ["g"], "id", "y", "age", caliper, **kw).collect()
    assert len(got) == len({(r.g, r.case_id) for r in got}) == len({(r.g, r.control_id) for r in got})
    # Controls of one value are interchangeable to the loop: the values are what it fixes, and each control stands at its own.
    assert {(r.g, r.case_id): (r.case_value, r.control_value) for r in got} == {k: (x, w) for k, (x, _, w) in brute(data, caliper).items()}
    at = {i: x for _, i, _, x in data}
    assert all(at[r.control_id] == r.control_value and at[r.case_id] == r.case_value for r in got)
    return sorted((str(r.g), r.case_id, r.control_id) for r in got)


@pytest.mark.parametrize("seed", range(30))
def test_loop_in_one_block(seed):
    rng = np.random.default_rng(seed)
    cases = np.round(rng.gamma(2.0, 8.0, 80), seed % 3).tolist()
    w, n = np.unique(np.round(rng.gamma(2.0, 8.0, 70), seed % 3), return_counts=True)
    free, want = dict(zip(w.tolist(), n.tolist())), []
    for v in cases:
        near = min((x for x in free if free[x]), key=lambda x: (abs(x - v), x), default=None)
        ok = near is not None and abs(near - v) <= 2.0
        want.append(near if ok else None)
        if ok:
            free[near] -= 1
    got = pr.nearest_in_order(cases, w.tolist(), n.tolist(), 2.0)
    assert [w[j] if j >= 0 else None for j in got] == want


@pytest.mark.parametrize("block,seed,spread,share,digits", [(25, 1, 4.0, 0.5, 0), (25, 2, 30.0, 0.7, 1), (1000, 3, 1.0, 0.3, 3)])
def test_equals_the_loop(spark, block, seed, spread, share, digits):
    spark.conf.set(pr.CASES_CONF, str(block))
    try:
        same(spark, make(seed, 150, spread, share, digits), 1.5)
    finally:
        spark.conf.unset(pr.CASES_CONF)


def test_large_groups(spark, small_limits):
    """Ordered helpers in ranges and blocks of a third of the cases give what one block gives."""
    data = make(5, 60, 6.0)
    plain = same(spark, data, 2.0, hot=False)
    spark.conf.set(pr.CASES_CONF, "16")
    try:
        assert same(spark, data, 2.0) == plain
    finally:
        spark.conf.unset(pr.CASES_CONF)


@pytest.mark.parametrize("seed", range(2))
def test_a_block_meets_two_controls_a_case_at_most(spark, seed):
    """Trimmed controls are few and the block takes the same ones from them as from all."""
    rng = np.random.default_rng(seed)
    cases = np.round(rng.normal(0, 1, 25), 2)
    w = np.unique(np.round(rng.normal(0, 3, 600), 2))
    block = spark.createDataFrame([(0, float(v)) for v in cases], "__island int, v double")
    free = spark.createDataFrame([(0, float(v), 1) for v in w] + [(1, 0.0, 5)], "__island int, v double, n bigint")
    kept = sorted(r.v for r in pr.reachable(block, free, ["__island"]).collect())
    assert len(kept) <= 2 * len(cases) < len(w)
    one, all_ = (pr.nearest_in_order(cases.tolist(), list(c), [1] * len(c), 50.0) for c in (kept, w))
    assert [kept[j] for j in one] == [w[j] for j in all_]


def test_edges(spark):
    data = [("a", 1, 1, 10.0), ("a", 2, 0, 20.0), ("a", 3, 0, None), ("a", 4, 1, float("nan")), ("a", 5, 0, float("inf")),
            (None, 6, 1, 0.0), (None, 7, 0, -0.0), (None, 8, None, 0.0), ("b", 9, 1, 5.0), ("b", 10, 1, 5.0)]
    assert same(spark, data, 3.0) == [("None", 6, 7)]
    assert same(spark, data, 0.0) == [("None", 6, 7)]
    empty = spark.createDataFrame([], SCHEMA)
    assert pr.priority_match(empty, ["g"], "id", "y", "age", 1.0).collect() == []
    twice = [("a", 1, 1, 1.0)] * 2 + [("a", 2, 0, 1.0)] * 3
    assert pr.priority_match(spark.createDataFrame(twice, SCHEMA), ["g"], "id", "y", "age", 1.0).count() == 2
