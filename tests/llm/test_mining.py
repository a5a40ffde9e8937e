import math
import random

import numpy as np
import pytest

from tidemark.llm import mining

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, data string, block string, anchor string, score string"
EXTRA = ("u", "d", "b", "a", "s")


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def expected(rows):
    own = []
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        own.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for at, (i, label, v) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, k) for k, (j, _, w) in enumerate(own) if k != at)
        for p, _, pid, k in [s for s in scored if own[s[3]][1] == label][:5]:
            window = [s for s in scored if own[s[3]][1] != label and -80 * p <= -100 * s[0] <= -100 * p][:5]
            out += [(i, own[k][0], r + 1, own[s[3]][0], -p, -s[0]) for r, s in enumerate(window)]
    return out


def check(spark, rows, **options):
    got = [tuple(r) for r in mining.mined(table(spark, rows), **options).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


@pytest.mark.parametrize("options", [{}, {"batch": 2, "least_block": 40, "most_block": 40}])
def test_against_brute_force(spark, options):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(4, 12))
    x = (centres[draw.integers(0, 4, 700)] + draw.normal(size=(700, 12)) * 0.8) / 4
    check(spark, [(k, [float(v) for v in x[k]], int(draw.integers(0, 3))) for k in range(700)], **options)


def test_edges(spark):
    draw = random.Random(5)
    vec = lambda: [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]
    rows = [(k, vec(), k % 2) for k in range(90, 310)]
    rows += [(100, rows[10][1], 1), (None, [0.5] * 4, 1), (None, [0.5] * 4, 0), (400, None, 1), (500, [0.1, None, 0.1, 0.1], 1), (600, [float("nan")] * 4, 1),
             (700, [1.0, float("inf"), 0.0, 0.0], 0), (800, [0.5] * 4, None), (900, [], 1), (1000, [0.5, 0.5], 0), (1100, [0.0] * 4, 0),
             (1200, [-1.0] * 4, 9), (1300, [0.5] * 6, 0)]
    check(spark, rows)
    check(spark, rows, batch=1, least_block=16, most_block=16)
    assert mining.mined(table(spark, [])).collect() == []
    assert mining.mined(table(spark, rows).where("vec_id % 100 <> 0")).collect() == []


def test_large_components(spark):
    draw = random.Random(6)
    check(spark, [(k, [draw.uniform(-1, 1) * 10.0 ** draw.randrange(7) for _ in range(5)], k % 2) for k in range(250)])


def test_walk_stops_early():
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(20_000, 2)) * 256)
    lists = mining.Lists(x)
    for a in (np.array([256.0, 0.0]), np.array([100.0, -200.0]), np.array([-30.0, 1.0])):
        rows, scores = mining.top_of(lists, a, 5, None)
        assert len(rows) < 2_000 and sorted(scores)[-5:] == sorted(x @ a)[-5:]
        p = float(np.sort(x @ a)[-40])
        lo = -(-80 * p // 100)
        rows, scores = mining.windows_of(lists, a, [(lo, p)], 5, np.ones(len(x), bool))
        want = np.sort((x @ a)[(x @ a <= p)])[-5:]
        assert sorted(scores[(scores <= p)])[-5:] == want.tolist() and len(rows) < 4_000
