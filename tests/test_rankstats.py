import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_two_sided, text_p, wilson
from tidemark.operators import operating as op
from tidemark.operators import rankstats as rs


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos]))


def components(y, s):
    pos, neg = s[y == 1], s[y == 0]
    v01 = np.array([np.mean((p > neg) + 0.5 * (p == neg)) for p in pos])
    v10 = np.array([np.mean((pos > n) + 0.5 * (pos == n)) for n in neg])
    return v01, v10


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 120
    y = (rng.random(n) < 0.4).astype(int)
    a = np.round(rng.normal(y * 0.7, 1), 1)
    b = np.round(rng.normal(y * 0.2, 1), 1)
    g = np.where(np.arange(n) < 90, "big", "small")
    y[g == "small"] = 0  # one class is empty
    data = [(str(k), int(i), float(p), float(q)) for k, i, p, q in zip(g, y, a, b)]
    return spark.createDataFrame(data, "g string, y int, a double, b double"), g, y, a, b


def test_auc_brute_force_and_properties(frame):
    df, g, y, a, _ = frame
    out = {r["g"]: r["auc"] for r in rs.auc(df, ["g"], "y", "a", hot=False).collect()}
    assert out["small"] is None
    big = g == "big"
    want = brute_auc(y[big], a[big])
    assert abs(out["big"] - want) < 1e-12
    flipped = rs.auc(df.withColumn("m", -F.col("a")), ["g"], "y", "m", hot=False).filter("g = 'big'").first()["auc"]
    monotone = rs.auc(df.withColumn("m", F.exp("a")), ["g"], "y", "m", hot=False).filter("g = 'big'").first()["auc"]
    assert abs(flipped - (1 - want)) < 1e-12 and abs(monotone - want) < 1e-12


@pytest.mark.parametrize("hot", [False, True])
def test_delong_matches_numpy(frame, hot):
    df, g, y, a, b = frame
    r = rs.delong(df.filter("g = 'big'"), ["g"], "y", "a", "b", hot=hot).first()
    m = g == "big"
    (pa, na), (pb, nb) = components(y[m], a[m]), components(y[m], b[m])
    var = np.var(pa - pb, ddof=1) / len(pa) + np.var(na - nb, ddof=1) / len(na)
    assert abs(r["diff"] - (pa.mean() - pb.mean())) < 1e-12
    assert abs(r["se"] - math.sqrt(var)) < 1e-12
    assert abs(r["p"] - math.erfc(abs(r["z"]) / math.sqrt(2))) < 1e-12
    assert r["n"] == m.sum()


def test_delong_degenerate_and_one_class(frame):
    df = frame[0]
    out = {r["g"]: r for r in rs.delong(df, ["g"], "y", "a", "a", hot=False).collect()}
    assert (out["big"]["se"], out["big"]["z"], out["big"]["p"], out["big"]["ci_lo"]) == (0, 0, 1, 0)
    assert out["small"]["diff"] is None and out["small"]["n"] == 30


def test_delong_of_one_swapped_pair_in_many(spark):
    """A tiny variance is not zero: z is about -0.71, p about 0.48."""
    n = 10_000
    base = spark.range(2 * n).select((F.col("id") < n).cast("int").alias("y"), (-F.col("id")).cast("double").alias("a"))
    swapped = F.when(F.col("a") == -(n - 1), -float(n)).when(F.col("a") == -n, -float(n - 1)).otherwise(F.col("a"))
    r = rs.delong(base.withColumn("b", swapped).withColumn("g", F.lit("g")), ["g"], "y", "b", "a", hot=False).first()
    assert abs(r["z"] + 0.7071) < 1e-3 and abs(r["p"] - 0.4795) < 1e-3
    assert r["diff"] < 0 and r["ci_lo"] < 0 < r["ci_hi"]


@pytest.mark.parametrize("hot", [False, True])
def test_holm(spark, small_limits, hot):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.9, 0.04, None]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p double")
    out = {r["i"]: r["p_holm"] for r in rs.holm(df, ["f"], "p", ["i"], hot=hot).collect()}
    known = [(x, i) for i, x in enumerate(p) if x is not None]
    run = 0.0
    for rank, (x, i) in enumerate(sorted(known)):
        run = max(run, (len(known) - rank) * x)
        assert abs(out[i] - min(1, run)) < 1e-12 and out[i] >= x
    assert out[7] is None


def test_pool_and_leave_one_out(spark):
    rows = [("a", 0.1, 0.05), ("b", 0.2, 0.1), ("c", -0.05, 0.02), ("d", 0.3, 0.0), ("e", None, 0.1)]
    df = spark.createDataFrame(rows, "u string, diff double, se double")
    out = {r["left_out"]: r for r in rs.pool_leave_one_out(df, [], "u", "diff", "se").collect()}

    def want(skip):
        d = np.array([x for u, x, s in rows if x is not None and s > 0 and u != skip])
        w = 1 / np.array([s for u, x, s in rows if x is not None and s > 0 and u != skip]) ** 2
        return (w * d).sum() / w.sum(), math.sqrt(1 / w.sum())
    for u in ("none", "a", "b", "c", "d", "e"):
        assert np.allclose((out[u]["diff"], out[u]["se"]), want(u))
    assert out["none"]["k"] == 3 and out["a"]["k"] == 2


def test_net_benefit_brute_force(frame, spark):
    df, g, y, a, _ = frame
    p = 1 / (1 + np.exp(-a))
    d = df.filter("g = 'big'").withColumn("p", 1 / (1 + F.exp(-F.col("a"))))
    out = rs.net_benefit(d, ["g"], "y", "p", op.threshold_table(spark), 0.1).collect()
    m = g == "big"
    yy, pp = y[m], p[m]
    obs = yy.mean()
    w1, w0 = 0.1 / obs, 0.9 / (1 - obs)
    assert len(out) == 46
    for r in out:
        flag = pp >= r["threshold"]
        odds = r["threshold"] / (1 - r["threshold"])
        want = (w1 * (flag & (yy == 1)).sum() - w0 * (flag & (yy == 0)).sum() * odds) / len(yy)
        assert abs(r["net_benefit"] - want) < 1e-12


def test_average_precision_brute_force(frame):
    df, g, y, a, _ = frame
    m = g == "big"
    yy, aa = y[m], a[m]
    ap, last = 0.0, 0.0
    for t in sorted(set(aa), reverse=True):
        f = aa >= t
        rec = (f & (yy == 1)).sum() / yy.sum()
        ap += (rec - last) * (f & (yy == 1)).sum() / f.sum()
        last = rec
    r = rs.average_precision(df.filter("g = 'big'"), ["g"], "y", "a", hot=False).first()
    assert abs(r["average_precision"] - ap) < 1e-12


def test_normal_tail(spark):
    zs = [0.0, 1e-9, 0.5, 1.0, 1.96, 2.999, 3.0, 3.5, 6.0, 12.0, 30.0, -2.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided(F.col("z")).alias("p"))
    for r in df.collect():
        want = math.erfc(abs(r["z"]) / math.sqrt(2))
        assert abs(r["p"] - want) <= 1e-10 * want + 1e-14


def test_wilson_and_p_text(spark):
    df = spark.createDataFrame([(3, 10), (0, 0), (0, 5)], "k int, n int")
    lo, hi = wilson(F.col("k"), F.col("n"))
    out = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert out[1]["lo"] is None and 0 < out[0]["lo"] < 0.3 < out[0]["hi"] < 1 and abs(out[2]["lo"]) < 1e-12
    p = spark.createDataFrame([(0.0,), (0.0005,), (0.02,), (None,)], "p double").select(text_p(F.col("p")).alias("t"))
    assert [r["t"] for r in p.collect()] == ["P<0.0001", "P=0.0005", "P=0.020", "MISSING"]


@pytest.mark.parametrize("cells", [80_000_000, 1])
def test_pairs_of_a_wide_row_like_copies_of_it(spark, monkeypatch, cells):
    """Nulls, NaN, ties, one class, one case, few rows, equal scores and null keys; in a task and by copies of the rows."""
    draw = np.random.default_rng(11)
    rows = []
    for i in range(260):
        g = ["a", "b", None, "one", "few", "case"][i % 6] if i < 240 else "a"
        a, b, c = (float(v) for v in draw.integers(0, 12, 3))
        y = 1 if g == "one" else int(i == 5) if g == "case" else None if i == 19 else i // 6 % 2
        rows.append((g, y, None if i % 17 == 0 else a, float("nan") if i % 23 == 0 else b, c if g != "b" else None))
    rows = [r for i, r in enumerate(rows) if r[0] != "few" or i < 30]
    wide = spark.createDataFrame(rows, "g string, y int, a double, b double, c double")
    monkeypatch.setattr(rs, "TASK_CELLS", cells)
    pairs = [("ab", "a", "b"), ("aa", "a", "a"), ("bc", "b", "c")]
    got = rs.delong_pairs(wide, ["g"], "y", pairs)
    assert ("Generate" in got._jdf.queryExecution().executedPlan().toString()) == (cells == 1)
    got = {(r.g, r.margin): r for r in got.collect()}
    want = {(r.g, m): r for m, a, b in pairs for r in rs.delong(wide.withColumns({"sa": F.col(a), "sb": F.col(b)}), ["g"], "y", "sa", "sb").collect()}
    assert got.keys() == want.keys() and len(want) == 17
    for k, w in want.items():
        for c in ("n", "auc_a", "auc_b", "diff", "se", "z", "p", "ci_lo", "ci_hi"):
            assert (got[k][c] is None) == (w[c] is None) and (w[c] is None or abs(got[k][c] - w[c]) < 1e-9), (k, c, got[k][c], w[c])
    read = {(r.g, r.arm): tuple(r[2:]) for r in rs.arm_aucs(wide, ["g"], "y", ["a", "b", "c"]).collect()}
    long = {(r.g, r.arm): tuple(r[2:]) for r in rs.auc(rs.long_scores(wide, ["g"], "y", ["a", "b", "c"]), ["g", "arm"], "y", "s").collect()}
    assert read.keys() == long.keys()
    for k, w in long.items():
        assert read[k][1:] == w[1:] and (read[k][0] == w[0] or abs(read[k][0] - w[0]) < 1e-12)
