import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import covariate as cv
from tidemark.operators import folds as fd
from tidemark.operators import models as ml


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 90
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 10, 2]
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    data = [("big" if i < 70 else "small", i, int(y[i]), x[i].tolist(), float(x[i] @ [1, 0.5, 3] + rng.normal()))
            for i in range(n)]
    return spark.createDataFrame(data, "g string, id int, y int, x array<double>, t double"), x, y


def params(df):
    return {(r["g"], r["mfold"]): np.r_[r["intercept"], r["coef"]] for r in df.collect()}


def test_gradient_is_zero_at_the_optimum(rows):
    df, x, y = rows
    w = params(ml.fit(df, ["g"], "y", "x", large=False))["big", -1]
    xb, yb = x[:70], y[:70]
    mu, sd = ml.scale_of(xb)
    z = (xb - mu) / sd
    wz = w[1:] * sd
    p = 1 / (1 + np.exp(-(w[0] + xb @ w[1:])))
    assert np.abs(z.T @ (p - yb) + wz).max() < 1e-6 and abs((p - yb).sum()) < 1e-6


def test_agrees_with_spark_ml(spark, rows):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    df, x, y = rows
    mu, sd = ml.scale_of(x[:70])
    z = (x[:70] - mu) / sd
    data = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(z, y[:70])], ["label", "features"])
    m = LogisticRegression(regParam=1 / 70, standardization=False, tol=1e-12, maxIter=500).fit(data)
    w = params(ml.fit(df, ["g"], "y", "x", large=False))["big", -1]
    assert np.allclose(w[1:] * sd, m.coefficients.toArray(), atol=1e-4)


@pytest.mark.parametrize("kind,target", [("logistic", "y"), ("ridge", "t")])
def test_distributed_equals_in_task(rows, kind, target):
    folded = fd.stratified(rows[0], ["g"], "id", "y", 5, 1, hot=False)
    a = params(ml.fit(folded, ["g"], target, "x", 5, kind, large=False))
    b = params(ml.fit(folded, ["g"], target, "x", 5, kind, large=True))
    assert a.keys() == b.keys() and len(a) == 10
    assert all(np.allclose(a[k], b[k], atol=1e-5) for k in a)


@pytest.mark.parametrize("kind,target", [("logistic", "y"), ("ridge", "t")])
def test_large_mean_small_spread_and_constants(rows, kind, target):
    """A feature of mean 1e8 and sd 1, and a constant one, are scaled alike both ways."""
    df = rows[0].withColumn("x", F.concat("x", F.array(F.element_at("x", 1) + 1e8, F.lit(0.1), F.lit(3e7))))
    a, b = (ml.fit(df, ["g"], target, "x", None, kind, large=large).collect() for large in (False, True))
    for p, q in zip(sorted(a, key=lambda r: r["g"]), sorted(b, key=lambda r: r["g"])):
        assert p["converged"] and q["converged"] and np.allclose(p["coef"], q["coef"], atol=1e-5)
        assert abs(p["intercept"] - q["intercept"]) < 1e-5 * max(1, abs(p["intercept"]))


def test_a_fit_without_optimum_says_so(spark):
    df = spark.createDataFrame([("g", int(i > 20), [float(i)]) for i in range(40)], "g string, y int, x array<double>")
    for large in (False, True):
        assert ml.fit(df, ["g"], "y", "x", penalty=0.0, large=large).first()["converged"] is False
        assert ml.fit(df, ["g"], "y", "x", large=large).first()["converged"] is True
        assert ml.fit(df, [], "y", "x", large=large).first()["n_train"] == 40


def test_null_keys_are_a_group(spark, small_limits):
    rows = [(None if i % 2 else "g", i % 3 % 2, [float(i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, y int, x array<double>")
    assert sorted(r["n_train"] for r in ml.fit(df, ["g"], "y", "x").collect()) == [30, 30]


def test_mixed_sizes_take_both_ways(rows, small_limits):
    a = params(ml.fit(rows[0], ["g"], "y", "x"))
    b = params(ml.fit(rows[0], ["g"], "y", "x", large=False))
    assert all(np.allclose(a[k], b[k], atol=1e-5) for k in b)


def test_ridge_loo_is_exact():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(20, 2))
    z = (z - z.mean(0)) / z.std(0)
    y = z @ [1.0, -2.0] + rng.normal(size=20)
    path = ml.ridge_path(z.T @ z, z.T @ (y - y.mean()))
    got = ml.loo_errors(z, y - y.mean(), 20, path)
    for alpha, err in list(zip(ml.ALPHAS, got))[::6]:
        want = 0.0
        for i in range(20):
            keep = np.arange(20) != i
            x1 = np.column_stack([np.ones(19), z[keep]])
            w = np.linalg.solve(x1.T @ x1 + np.diag([0, alpha, alpha]), x1.T @ y[keep])
            want += (y[i] - w[0] - z[i] @ w[1:]) ** 2
        assert abs(err - want) < 1e-8


def test_scores_come_from_the_model_that_did_not_see_the_row(rows):
    folded = fd.stratified(rows[0], ["g"], "id", "y", 5, 1, hot=False)
    p = ml.fit(folded, ["g", "repeat"], "y", "x", 5, large=False)
    w = {(r["g"], r["mfold"]): r for r in p.collect()}
    for r in ml.scored(folded, p, ["g", "repeat"], "x", own_fold=True).collect():
        m = w[r["g"], r["fold"]]
        assert abs(r["s"] - (m["intercept"] + np.dot(r["x"], m["coef"]))) < 1e-9


def test_folds_are_balanced_and_stable(rows):
    df = rows[0]
    a = fd.stratified(df, ["g"], "id", "y", 5, 2, hot=False)
    b = fd.stratified(df.repartition(11), ["g"], "id", "y", 5, 2, hot=False)
    key = lambda d: sorted((r["g"], r["id"], r["repeat"], r["fold"]) for r in d.collect())
    assert key(a) == key(b)
    c = a.groupBy("g", "repeat", "y", "fold").count().groupBy("g", "repeat", "y").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in c)


def test_group_folds_keep_groups_and_refuse_too_few(spark, rows):
    df = rows[0].withColumn("who", F.col("id") % 12)
    f = fd.group_stratified(df, ["g"], "who", "y", 4, 2, hot=False)
    n = f.groupBy("g", "repeat", "who").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0]
    assert n == 1
    with pytest.raises(Exception, match="need at least"):
        fd.group_stratified(df.withColumn("who", F.lit(1)), ["g"], "who", "y", 4, 1, hot=False).collect()


def test_quadratic_fit_and_normative_scale(spark):
    rng = np.random.default_rng(1)
    age = rng.uniform(25, 95, 400)
    x = 3 + 0.1 * age - 0.001 * age ** 2 + rng.normal(size=400) * 0.5
    df = spark.createDataFrame([("f", float(a), float(v)) for a, v in zip(age, x)], "feature string, age double, value double")
    fit = cv.quadratic_fit(df, ["feature"], "age", "value").first()
    t = (age - cv.CENTRE) / cv.SPREAD
    want = np.linalg.lstsq(np.column_stack([np.ones(400), t, t * t]), x, rcond=None)[0]
    assert np.allclose([fit["b0"], fit["b1"], fit["b2"]], want)
    model = cv.normative_fit(df, ["feature"], "age", "value")
    z = [r["z"] for r in cv.deviations(df, model, ["feature"], "age", "value").collect()]
    assert abs(np.mean(z)) < 0.05 and 0.8 < np.std(z) < 1.25
    few = cv.normative_fit(df.limit(20), ["feature"], "age", "value").first()
    assert few["usable"] is False


def test_crossfit_sums_leave_the_fold_out(spark):
    df = spark.createDataFrame([("f", i % 3, float(20 + i), float(i * i % 17)) for i in range(60)],
                               "feature string, fold int, age double, value double")
    got = cv.solved(cv.crossfit_sums(df, ["feature"], "fold", "age", "value", 3), ["feature", "mfold"], 5)
    for r in got.collect():
        want = cv.quadratic_fit(df.filter(F.col("fold") != r["mfold"]), ["feature"], "age", "value").first()
        assert np.allclose([r["b0"], r["b1"], r["b2"]], [want["b0"], want["b1"], want["b2"]])


def test_anchor_centres_the_site(spark):
    df = spark.createDataFrame([("s", float(v)) for v in [1, 2, 3, 4, 100]] + [("flat", 2.0)] * 3, "site string, z double")
    a = {r["site"]: r for r in cv.site_anchor(df, ["site"], hot=False).collect()}
    assert a["s"]["shift"] == 3 and abs(a["s"]["scale"] - 1.4826) < 1e-12 and a["flat"]["scale"] == 1.0


def test_platt_slope_is_positive_for_a_good_score(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 200)
    df = spark.createDataFrame([("g", int(a), float(a + rng.normal())) for a in y], "g string, y int, s double")
    r = ml.calibrated(df, ["g"], "y", "s").first()
    p = 1 / (1 + np.exp(-(r["slope"] * np.array([q["s"] for q in df.collect()]) + r["offset"])))
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (200 - n1 + 2))
    assert r["slope"] > 0 and abs((p - t).sum()) < 1e-5


def test_crossfit_query_returns_every_residual(spark):
    """One row a subject of each contrast, condition and feature, not a summary of a fold."""
    from tidemark.plans import modelling
    got = modelling.ml09_resid(spark, "/root/testdata/sf0.001")
    g = ["contrast", "cond", "feature"]
    assert {*g, "fold", "subject", "resid"} == set(got.columns)
    assert got.count() == got.select(*g, "subject").distinct().count() > got.select(*g, "fold").distinct().count()


def test_large_fits_reach_the_optimum(spark):
    """The gradient of a fit over many rows vanishes to 1e-5 and not to a share of the row count."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(400_000, 2)) * [1, 30] + [0, 100]
    y = (draw.random(400_000) < 1 / (1 + np.exp(-x[:, 0] + 1))).astype(float)
    mu, sd = ml.scale_of(x)
    z1 = np.column_stack([np.ones(len(x)), (x - mu) / sd])
    limit = ml.gradient_limit(len(x))
    assert limit <= 1e-6 and ml.gradient_limit(100) == 1e-8
    w, fine = ml.fit_logistic(z1[:, 1:], y)
    p = 1 / (1 + np.exp(-z1 @ w))
    assert fine and np.abs(z1.T @ (p - y) + np.r_[0, w[1:]]).max() < 1e-5


def test_blocks_like_single_fits(spark):
    """Folds and label columns of two groups in the same passes."""
    draw = np.random.default_rng(9)
    x, f = draw.normal(size=(300, 3)) * [1, 20, 0.1], draw.integers(-1, 3, 300)
    y = (draw.random((300, 2)) < 1 / (1 + np.exp(-x[:, [0]]))).astype(float)
    rows = spark.createDataFrame([(i % 2, x[i].tolist(), y[i].tolist(), [int(f[i])]) for i in range(300)], "g int, x array<double>, y array<double>, f array<int>")
    blocks = [ml.Block(j, {0: [0, 1], 1: [0, 2]}, j, [(0, h) for h in range(3)]) for j in range(2)]
    got = ml.fit_blocks(rows, blocks)
    for (g, j), (b0, coef, n, fine) in got.items():
        for h in range(3):
            m = (np.arange(300) % 2 == g) & (f >= 0) & (f != h)
            want = ml._fit_one("logistic", x[m][:, blocks[j].columns[g]], y[m, j], 1.0, 1.0)
            assert fine[h] and n[h] == m.sum() and abs(b0[h] - want[0]) < 1e-7 * (1 + abs(want[0])) and np.allclose(coef[h], want[1], rtol=1e-6, atol=1e-8)
    assert len(got) == 4


@pytest.mark.parametrize("how", ["residual", "normative"])
def test_crossfit_scores_like_single_fits(spark, how):
    """Transforms inside the passes give the scores of transformed copies of every row."""
    from tidemark.operators import covariate as cv
    draw = np.random.default_rng(12)
    age, y, fold = draw.uniform(20, 90, 240), draw.integers(0, 2, 240), draw.integers(0, 3, 240)
    v = draw.normal(size=(240, 2)) * (1 + age[:, None] / 50) + age[:, None] * [0.1, -0.02] + y[:, None] * [1.0, 0.2]
    rows = spark.createDataFrame([("a", i, int(y[i]), float(age[i]), v[i].tolist(), [int(fold[i])]) for i in range(240)],
                                 "c string, id long, y int, age double, x array<double>, f array<int>")
    got = {r.id: r.s for r in cv.crossfit_scores(rows, ["c"], "id", "y", "age", "x", "f", 3, 1, how).collect()}
    long = rows.select("c", "id", "y", "age", F.lit(0).alias("repeat"), F.get("f", F.lit(0)).alias("fold"), F.posexplode("x").alias("feature", "value"))
    cross = cv.crossfitted(long, ["c"], "id", "y", "age", "value", 3, how).withColumnRenamed("mfold", "model")
    g = ["c", "repeat", "model"]
    s = ml.scored(cross.filter("fold = model"), ml.fit(cross.filter("fold <> model"), g, "y", "x", large=False), g, "x")
    want = {r.id: r.s for r in ml.rank_mean(s, ["c"], "id", "y").collect()}
    assert len(got) == 240 and got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-9
