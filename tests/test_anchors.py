import numpy as np
import pandas as pd

from tidemark.operators import covariate as cv
from tidemark.operators import folds as fd


def test_prefixes_and_counts_brute_force(spark):
    draw = np.random.default_rng(4)
    z = draw.normal(size=(60, 3))
    y = (np.arange(60) < 25).astype(int)
    coef, intercept, slope, offset, thr = [0.5, -1.0, 2.0], 0.1, 1.3, -0.2, 0.45
    p_direct, p_norm = draw.random(60), draw.random(60)
    rows = [("g", "c" if i % 2 else None, i, int(y[i]), z[i].tolist(), coef, intercept, slope, offset, thr, float(p_direct[i]), 0.5, float(p_norm[i])) for i in range(60)]
    targets = spark.createDataFrame(rows, "m string, c string, sid long, y int, z array<double>, coef array<double>, intercept double, slope double, offset double,"
                                          " threshold double, p_direct double, t_direct double, p_normative double")
    orders = [draw.permutation(np.flatnonzero(y == 0))[:7] for _ in range(9)]
    picked = spark.createDataFrame([("g", d, r, int(i), z[i].tolist()) for d, o in enumerate(orders) for r, i in enumerate(o, 1)],
                                   "m string, draw int, rn int, sid long, z array<double>")
    anchors = cv.anchor_prefixes(picked, ["m", "draw"], "rn", "sid", "z", [3, 6])
    for cells in (1, 4):
        got = {(r.c, r.draw, r.arm, r.k): (r.case_hit, r.n_case, r.held_hit, r.n_held) for r in
               cv.anchored_counts(targets, anchors, ["m"], ["m", "c"], "sid", cells).collect()}
        want = {}
        for d, o in enumerate(orders):
            for k in (3, 6):
                shift = np.median(z[o[:k]], axis=0)
                scale = 1.4826 * np.median(np.abs(z[o[:k]] - shift), axis=0)
                p = 1 / (1 + np.exp(-(slope * (((z - shift) / scale) @ coef + intercept) + offset)))
                arms = {"anchored": p > thr} | ({"direct": p_direct > 0.5, "normative": p_norm > thr} if k == 6 else {})
                for c in ("c", None):
                    own = np.array([(i % 2 == 1) == (c == "c") for i in range(60)])
                    held = own & (y == 0) & ~np.isin(np.arange(60), o[:k])
                    for arm, f in arms.items():
                        want[c, d, arm, k] = (int((f & own & (y == 1)).sum()), int((own & (y == 1)).sum()), int((~f & held).sum()), int(held.sum()))
        assert got == want


def test_fold_counts_like_one_group_at_a_time():
    draw = np.random.default_rng(2)
    for _ in range(60):
        kinds = pd.DataFrame({"p": draw.integers(0, 6, 8), "q": draw.integers(0, 9, 8)}).drop_duplicates()
        kinds = kinds[kinds.p + kinds.q > 0]
        p, q, m, k = kinds.p.to_numpy(), kinds.q.to_numpy(), draw.integers(1, 40, len(kinds)), int(draw.integers(2, 6))
        got = fd.fold_counts(p, q, m, k)
        tp, tq = max(1, int((p * m).sum())), max(1, int((q * m).sum()))
        load = p * tq + q * tp
        held, want = [0] * k, np.zeros_like(got)
        for i in sorted(range(len(p)), key=lambda i: (-load[i], -p[i])):
            for _ in range(m[i]):
                f = held.index(min(held))
                held[f] += int(load[i])
                want[i, f] += 1
        assert (got == want).all()
        assert max(held) - min(held) <= load.max()


def test_one_huge_kind():
    got = fd.fold_counts(np.array([3, 1]), np.array([0, 1]), np.array([1, 10**12]), 5)
    assert got.sum() == 10**12 + 1 and got[1].max() - got[1].min() <= 10**12


def test_split_ranks_only_the_anchors(spark):
    """Ranks are limited inside the tasks before the shuffle."""
    from tidemark.plans import inference
    got = inference.mt05_split(spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
