"""Cross-validated models, covariate models and transfer over the adapters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import rounded
from tidemark.operators import batched as bt
from tidemark.operators import covariate as cv
from tidemark.operators import folds as fd
from tidemark.operators import labels as lb
from tidemark.operators import models as ml
from tidemark.operators import rankstats as rs
from tidemark.plans.registry import Tables, query
from tidemark.plans.sql import auc_cte, h, r, u
from tidemark.session import stored
from tidemark.tables import (CONTRAST, CUBE, NAMES, SCORE, SUBJECT, contrast_rows, cube, features_wide, score, with_views)

K, REPEATS, RIDGE_REPEATS = 5, 5, 10


def doc_rows(t: Tables):
    """(cohort, source, id, y, quality, b, x): document features for the label models."""
    return score(t).select("cohort", "source", "id", "y", "quality", "a", "b", "c", F.array(
        F.col("a") / 1000, F.col("b") / 5000, F.col("c") / 50).alias("x"))


def usable_long(t: Tables):
    c = cube(t)
    return c.join(lb.usable_features(c, ["cond", "feature"]), ["cond", "feature"], "left_semi")


def usable_arrays(t: Tables):
    """(cond, subject, x): the features that every subject has under the condition, in name order, without a row for each of them."""
    wide = stored(features_wide(t), "features")
    names = sorted(NAMES)
    usable = wide.groupBy("cond").agg(F.array_compact(F.array(*[F.when(F.count_if(F.col(n).isNull()) == 0, F.lit(i)) for i, n in enumerate(names)])).alias("known"))
    x = F.transform("known", lambda i: F.get(F.array(*names), i))
    return wide.join(F.broadcast(usable.filter(F.size("known") > 0)), "cond").select("cond", "subject", x.alias("x"))


def design(t: Tables):
    """(cond, contrast, subject, cohort, y, age, x, both) on the features every subject has."""
    x = usable_arrays(t)
    return contrast_rows(t).join(x, "subject").withColumn(
        "both", F.concat("x", F.array(F.col("age") / 25))).select(
        "cond", "contrast", "subject", "cohort", "y", "age", "x", "both")


def oof_scores(rows, keys, sid, k=K, repeats=REPEATS, x="x", hot=None, large=None):
    """(keys, sid, y, s): out-of-fold scores of one feature set, rank-averaged over the repeats that have one; rows are not copied by repeat."""
    keys = list(keys)
    out = bt.cross_validated(rows, keys, sid, "y", {"s": x}, (), k, repeats, large, hot, partial=True, keep=None)
    return out.select(*keys, sid, "y", "s").filter("s IS NOT NULL")


@query("ml01_stratified_folds", with_views(SCORE) + f"""
SELECT id, repeat, CAST((row_number() OVER (PARTITION BY repeat, y ORDER BY {h('repeat', 'id')}, id) - 1) % {K} AS INT) AS fold
FROM score CROSS JOIN (SELECT CAST(unnest(range(0, {REPEATS})) AS INT) AS repeat)""")
def ml01(spark, sf):
    t = Tables(spark, sf)
    return fd.stratified(score(t), [], "id", "y", K, REPEATS, t.hot("documents")).select("id", "repeat", "fold")


@query("ml02_group_folds", with_views(SCORE).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, g AS (SELECT source, CAST(count(*) FILTER (y = 1) AS HUGEINT) AS p, CAST(count(*) FILTER (y <> 1) AS HUGEINT) AS q FROM score GROUP BY 1),
w AS (SELECT source, p, q, p * greatest(1, sum(q) OVER ()) + q * greatest(1, sum(p) OVER ()) AS load FROM g),
o AS (SELECT *, row_number() OVER (ORDER BY load DESC, p DESC) AS i FROM w),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST([{', '.join('0' * K)}] AS HUGEINT[]) AS held, CAST(0 AS BIGINT) AS f
  UNION ALL SELECT o.i, [held[j] + CASE WHEN j = list_position(held, list_min(held)) THEN load ELSE 0 END for j in range(1, {K + 1})],
    CAST(list_position(held, list_min(held)) AS BIGINT) FROM st JOIN o ON o.i = st.i + 1),
n AS (SELECT p, q, f - 1 AS fold, count(*) AS c FROM st JOIN o USING (i) GROUP BY 1, 2, 3),
e AS (SELECT *, sum(c) OVER (PARTITION BY p, q ORDER BY fold) AS hi FROM n),
rk AS (SELECT source, p, q, repeat, row_number() OVER (PARTITION BY repeat, p, q ORDER BY {h('repeat', 'source')}, source) AS rn
  FROM g CROSS JOIN (SELECT CAST(unnest(range(0, {REPEATS})) AS INT) AS repeat))
SELECT id, source, repeat, CAST(fold AS INT) AS fold FROM score JOIN rk USING (source) JOIN e ON e.p = rk.p AND e.q = rk.q AND rn > e.hi - e.c AND rn <= e.hi""")
def ml02(spark, sf):
    t = Tables(spark, sf)
    return fd.group_stratified(score(t), [], "source", "y", K, REPEATS, t.hot("documents")).select("id", "source", "repeat", "fold")


@query("ml03_logistic_fit")
def ml03(spark, sf):
    t = Tables(spark, sf)
    rows = doc_rows(t)
    p = ml.fit(rows, ["cohort"], "y", "x", large=t.large("documents"))
    s = ml.scored(rows, p, ["cohort"], "x")
    return s.select("cohort", "id", "y", rounded(F.col("s")).alias("decision"), rounded(ml.sigmoid(F.col("s"))).alias("probability"))


@query("ml03_optimality", with_views(SCORE) + """
SELECT cohort, count(*) AS n, true AS at_optimum FROM score GROUP BY cohort HAVING count(DISTINCT y) = 2""")
def ml03_optimality(spark, sf):
    """The gradient of the penalised likelihood, recomputed from the data, vanishes at the fit."""
    t = Tables(spark, sf)
    rows = doc_rows(t)
    params = ml.fit(rows, ["cohort"], "y", "x", large=t.large("documents"))
    s = ml.scored(rows, params, ["cohort"], "x", "d")
    e = ml.sigmoid(F.col("d")) - F.col("y")
    # On the standardised scale d/dw_i = Σ e·(x_i − μ_i)/σ_i + coef_i·σ_i, and Σ e = 0 removes μ.
    coef = params.select("cohort", "coef")
    g = s.groupBy("cohort").agg(F.count("*").alias("n"), F.sum(e).alias("intercept"), *[
        f.alias(f"{n}{i}") for i in (1, 2, 3) for n, f in (
            ("slope", F.sum(e * F.element_at("x", i))), ("sd", F.stddev_pop(F.element_at("x", i))))])
    ok = F.abs("intercept") < 1e-5
    for i in (1, 2, 3):
        sd = F.col(f"sd{i}")
        ok = ok & (F.abs(F.col(f"slope{i}") / sd + F.element_at("coef", i) * sd) < 1e-4)
    return g.join(coef, "cohort").select("cohort", "n", ok.alias("at_optimum"))


@query("ml04_oof_scores")
def ml04(spark, sf):
    t = Tables(spark, sf)
    return oof_scores(design(t), ["cond", "contrast"], "subject", hot=t.hot("customer"), large=t.large("customer")).withColumn("s", rounded(F.col("s")))


@query("ml05_oof_repeats")
def ml05(spark, sf):
    t = Tables(spark, sf)
    out = ml.out_of_fold(doc_rows(t), [], "id", "y", "x", K, REPEATS, hot=t.hot("documents"), large=t.large("documents"))
    return out.select("id", "y", "repeat", "fold", rounded(F.col("s")).alias("s"))


@query("ml05_coverage", with_views(SCORE) + f"""
SELECT repeat, fold, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM (SELECT id, repeat,
  CAST((row_number() OVER (PARTITION BY repeat, y ORDER BY {h('repeat', 'id')}, id) - 1) % {K} AS INT) AS fold
  FROM score CROSS JOIN (SELECT CAST(unnest(range(0, {REPEATS})) AS INT) AS repeat)) GROUP BY 1, 2""")
def ml05_coverage(spark, sf):
    """Every row is scored exactly once per repeat, by the model of its own fold."""
    t = Tables(spark, sf)
    out = ml.out_of_fold(doc_rows(t), [], "id", "y", "x", K, REPEATS, hot=t.hot("documents"), large=t.large("documents"))
    return out.filter("s IS NOT NULL").groupBy("repeat", "fold").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query("ml06_oof_probabilities")
def ml06(spark, sf):
    t = Tables(spark, sf)
    out = ml.out_of_fold(doc_rows(t), [], "id", "y", "x", K, REPEATS, hot=t.hot("documents"), large=t.large("documents"))
    return out.groupBy("id", "y").agg(rounded(F.avg(ml.sigmoid(F.col("s")))).alias("p"))


@query("ml07_shifted_scores")
def ml07(spark, sf):
    t = Tables(spark, sf)
    rows = doc_rows(t).withColumn("noisy", F.transform("x", lambda v: F.rint(v * 4) / 4))
    oof = ml.out_of_fold(rows, [], "id", "y", "x", K, REPEATS, score_x="noisy", hot=t.hot("documents"), large=t.large("documents"))
    return ml.rank_mean(oof, [], "id", "y", t.hot("documents")).withColumn("s", rounded(F.col("s")))


LONG_AGE = """la AS (SELECT c.cond, c.feature, s.subject, s.cohort, s.label, s.age, c.value FROM cube c JOIN subject s USING (subject)
  WHERE s.age IS NOT NULL)"""
_T = "((age - 50) / 25)"


def _mom(where: str = "value IS NOT NULL") -> str:
    return ", ".join(f"sum({e}) FILTER ({where}) AS {n}" for n, e in zip(cv.SUMS, [
        "1.0e0", _T, f"pow({_T}, 2)", f"pow({_T}, 3)", f"pow({_T}, 4)", "value", f"{_T} * value", f"pow({_T}, 2) * value"]))


def _solve(src: str, keys: str, min_n: int = 10) -> str:
    det = "(n * (t2 * t4 - t3 * t3) - t1 * (t1 * t4 - t3 * t2) + t2 * (t1 * t3 - t2 * t2))"
    ok = f"CASE WHEN n >= {min_n} AND abs({det}) > 1e-12 THEN"
    return f"""SELECT {keys}, CAST(coalesce(n, 0) AS BIGINT) AS n,
 {ok} (x0 * (t2 * t4 - t3 * t3) - t1 * (x1 * t4 - t3 * x2) + t2 * (x1 * t3 - t2 * x2)) / {det} END AS b0,
 {ok} (n * (x1 * t4 - t3 * x2) - x0 * (t1 * t4 - t3 * t2) + t2 * (t1 * x2 - x1 * t2)) / {det} END AS b1,
 {ok} (n * (t2 * x2 - x1 * t3) - t1 * (t1 * x2 - x1 * t2) + x0 * (t1 * t3 - t2 * t2)) / {det} END AS b2 FROM {src}"""


_TR = f"(b0 + b1 * {_T} + b2 * {_T} * {_T})"
OLS = f"""mo AS (SELECT cond, feature, {_mom()} FROM la GROUP BY 1, 2), ols AS ({_solve('mo', 'cond, feature')})"""
NORM = f"""mc AS (SELECT cond, feature, {_mom()} FROM la WHERE label = 'CN' GROUP BY 1, 2), nm AS ({_solve('mc', 'cond, feature', 30)}),
sp AS (SELECT la.cond, la.feature, regr_slope(ln(abs(value - {_TR}) + 1e-9), age) AS g1, regr_intercept(ln(abs(value - {_TR}) + 1e-9), age) AS g0,
  min(age) AS age_lo, max(age) AS age_hi FROM la JOIN nm USING (cond, feature) WHERE label = 'CN' GROUP BY 1, 2),
norm AS (SELECT *, b0 IS NOT NULL AND g0 IS NOT NULL AS usable FROM nm JOIN sp USING (cond, feature)),
zt AS (SELECT la.*, CASE WHEN usable THEN (value - {_TR}) / greatest(exp(g0 + g1 * age + {cv.LOG_ABS_TO_SD!r}), 1e-9) END AS z FROM la JOIN norm USING (cond, feature))"""


def long_age(t: Tables):
    from tidemark.tables import subject
    return cube(t).join(subject(t).filter("age IS NOT NULL").select("subject", "cohort", "label", "age"), "subject")


@query("ml08_quadratic_fit", with_views(SUBJECT, CUBE, LONG_AGE, OLS) + f"""
SELECT cond, feature, n, {r('b0')} AS b0, {r('b1')} AS b1, {r('b2')} AS b2 FROM ols""")
def ml08(spark, sf):
    f = cv.quadratic_fit(long_age(Tables(spark, sf)), ["cond", "feature"], "age", "value")
    return f.select("cond", "feature", "n", *[rounded(F.col(c)).alias(c) for c in ("b0", "b1", "b2")])


@query("ml08_residuals", with_views(SUBJECT, CUBE, LONG_AGE, OLS) + f"""
SELECT cond, feature, subject, {r(f'coalesce(value - {_TR}, value)')} AS resid FROM la JOIN ols USING (cond, feature)""")
def ml08_resid(spark, sf):
    la = long_age(Tables(spark, sf))
    fit = cv.quadratic_fit(la, ["cond", "feature"], "age", "value")
    return cv.residuals(la, fit, ["cond", "feature"], "age", "value").select("cond", "feature", "subject", rounded(F.col("resid")).alias("resid"))


CROSS = f"""fo AS (SELECT contrast, cond, feature, age, value, y, subject, fold FROM (SELECT k.contrast, k.subject, k.y, k.age,
    CAST((row_number() OVER (PARTITION BY contrast, y ORDER BY {h('0', 'subject')}, subject) - 1) % {K} AS INT) AS fold FROM contr k) JOIN cube USING (subject)),
 mf AS (SELECT contrast, cond, feature, mfold, {_mom('value IS NOT NULL AND y = 0')} FROM fo CROSS JOIN (SELECT unnest(range(0, {K})) AS mfold) WHERE fold <> mfold GROUP BY 1, 2, 3, 4),
 cf AS ({_solve('mf', 'contrast, cond, feature, mfold', 5)}),
 cr AS (SELECT fo.contrast, fo.cond, fo.feature, fo.fold, fo.subject, value - {_TR} AS resid FROM fo JOIN cf ON cf.contrast = fo.contrast AND cf.cond = fo.cond
   AND cf.feature = fo.feature AND cf.mfold = fo.fold WHERE value IS NOT NULL)"""


@query("ml09_crossfit_residuals", with_views(SUBJECT, CONTRAST, CUBE, CROSS) + f"""
SELECT contrast, cond, feature, fold, subject, {r('resid')} AS resid FROM cr""")
def ml09_resid(spark, sf):
    t = Tables(spark, sf)
    g = ["contrast", "cond", "feature"]
    rows = fd.stratified(contrast_rows(t), ["contrast"], "subject", "y", K, 1, t.hot("customer"))
    long = cube(t).join(rows.select("contrast", "subject", "y", "age", "fold"), "subject")
    sums = cv.crossfit_sums(long, g, "fold", "age", "value", K, F.col("y") == 0)
    fit = cv.solved(sums, [*g, "mfold"], 5).withColumnRenamed("mfold", "fold").drop("n")
    j = long.filter("value IS NOT NULL").join(fit, [*g, "fold"]).withColumn("resid", F.col("value") - cv.trend("age"))
    return j.select(*g, "fold", "subject", rounded(F.col("resid")).alias("resid"))


@query("ml09_residualised_scores")
def ml09(spark, sf):
    return _crossfit_scores(Tables(spark, sf), "residual")


@query("ml14_normative_scores")
def ml14(spark, sf):
    return _crossfit_scores(Tables(spark, sf), "normative")


def _crossfit_scores(t: Tables, how: str):
    """AUC of the cross-fitted scores: transform and model both come from the training folds."""
    keys = ["cond", "contrast"]
    hot = t.hot("customer")
    folds = fd.stratified(contrast_rows(t).select("contrast", "subject", "y"), ["contrast"], "subject", "y", K, REPEATS, hot)
    folds = folds.groupBy("contrast", "subject").agg(F.array(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))) for r in range(REPEATS)]).alias("folds"))
    rows = design(t).select(*keys, "subject", "y", "age", "x").join(folds, ["contrast", "subject"])
    scores = cv.crossfit_scores(stored(rows, "crossfit-rows"), keys, "subject", "y", "age", "x", "folds", K, REPEATS, how, hot)
    return rs.auc(scores, keys, "y", "s", hot=hot).withColumn("auc", rounded(F.col("auc")))


@query("ml10_normative_fit", with_views(SUBJECT, CUBE, LONG_AGE, NORM) + f"""
SELECT cond, feature, n, {r('b0')} AS b0, {r('b1')} AS b1, {r('b2')} AS b2, {r('g0', 5)} AS g0, {r('g1')} AS g1, usable,
  {r('age_lo')} AS age_lo, {r('age_hi')} AS age_hi FROM norm""")
def ml10(spark, sf):
    la = long_age(Tables(spark, sf)).filter("label = 'CN'")
    m = cv.normative_fit(la, ["cond", "feature"], "age", "value")
    return m.select("cond", "feature", "n", "usable", rounded(F.col("g0"), 5).alias("g0"),
                    *[rounded(F.col(c)).alias(c) for c in ("b0", "b1", "b2", "g1", "age_lo", "age_hi")])


def z_rows(t: Tables):
    la = long_age(t)
    m = cv.normative_fit(la.filter("label = 'CN'"), ["cond", "feature"], "age", "value")
    return cv.deviations(la, m, ["cond", "feature"], "age", "value")


@query("ml11_deviation", with_views(SUBJECT, CUBE, LONG_AGE, NORM) + f"SELECT cond, feature, subject, {r('z', 5)} AS z FROM zt")
def ml11(spark, sf):
    return z_rows(Tables(spark, sf)).select("cond", "feature", "subject", rounded(F.col("z"), 5).alias("z"))


@query("ml12_site_anchor", with_views(SUBJECT, CUBE, LONG_AGE, NORM) + f"""
, m AS (SELECT cohort, cond, feature, quantile_cont(z, 0.5) AS shift FROM zt WHERE label = 'CN' AND z IS NOT NULL GROUP BY 1, 2, 3),
 d AS (SELECT cohort, cond, feature, any_value(shift) AS shift, 1.4826e0 * quantile_cont(abs(z - shift), 0.5) AS s FROM zt JOIN m USING (cohort, cond, feature)
   WHERE label = 'CN' AND z IS NOT NULL GROUP BY 1, 2, 3)
SELECT cohort, cond, feature, {r('shift', 5)} AS shift, {r('CASE WHEN s > 1e-9 THEN s ELSE 1 END', 5)} AS scale FROM d""")
def ml12(spark, sf):
    t = Tables(spark, sf)
    a = cv.site_anchor(z_rows(t).filter("label = 'CN'"), ["cohort", "cond", "feature"], hot=t.hot("customer"))
    return a.select("cohort", "cond", "feature", rounded(F.col("shift"), 5).alias("shift"), rounded(F.col("scale"), 5).alias("scale"))


@query("ml13_abnormality", with_views(SUBJECT, CUBE, LONG_AGE, NORM) + f"""
SELECT cond, subject, {r('sqrt(avg(z * z))', 5)} AS abnormality FROM zt GROUP BY 1, 2""")
def ml13(spark, sf):
    return cv.abnormality(z_rows(Tables(spark, sf)), ["cond", "subject"]).withColumn("abnormality", rounded(F.col("abnormality"), 5))


@query("a05_deviation_auc", with_views(
    SUBJECT, CUBE, LONG_AGE, NORM, "zy AS (SELECT cond, feature, value, abs(z) AS dev, CASE WHEN label <> 'CN' THEN 1 ELSE 0 END AS y FROM zt)",
    auc_cte("ra", "zy", "cond, feature", "y", "value"), auc_cte("da", "zy", "cond, feature", "y", "dev")) + f"""
SELECT cond, feature, {r('ra.auc')} AS auc_raw, {r('da.auc')} AS auc_deviation FROM ra JOIN da USING (cond, feature)""")
def a05_dev(spark, sf):
    t = Tables(spark, sf)
    z = z_rows(t).withColumns({"y": (F.col("label") != "CN").cast("int"), "dev": F.abs("z")})
    raw = rs.auc(z, ["cond", "feature"], "y", "value", name="auc_raw", hot=t.hot("customer"))
    dev = rs.auc(z, ["cond", "feature"], "y", "dev", name="auc_deviation", hot=t.hot("customer"))
    return raw.select("cond", "feature", rounded(F.col("auc_raw")).alias("auc_raw")).join(
        dev.select("cond", "feature", rounded(F.col("auc_deviation")).alias("auc_deviation")), ["cond", "feature"])


@query("a11_calibration_slope")
def a11_slope(spark, sf):
    from tidemark.operators.operating import logit
    from tidemark.plans.operating import probs
    rows = probs(Tables(spark, sf)).select("cohort", "y", F.array(logit(F.col("pa"))).alias("x"))
    p = ml.fit(rows, ["cohort"], "y", "x", penalty=0.0)
    return p.select("cohort", rounded(F.element_at("coef", 1)).alias("calibration_slope"), "n_train")


@query("ml15_ridge_scores")
def ml15(spark, sf):
    t = Tables(spark, sf)
    rows = score(t).select("id", F.col("b").alias("target"), F.col("quality").alias("strat"),
                           F.array(F.col("a") / 100, F.col("c") / 10).alias("x"))
    folded = fd.stratified(rows, [], "id", "strat", 10, RIDGE_REPEATS, t.hot("documents"))
    p = ml.fit(folded, ["repeat"], "target", "x", 10, "ridge", large=t.large("documents"))
    s = ml.scored(folded, p, ["repeat"], "x", own_fold=True)
    return s.groupBy("id").agg(rounded(F.avg("s"), 3).alias("pred"), rounded(F.max("target"), 3).alias("target"))


@query("ml16_mean_only", with_views(SCORE) + f"""
, f AS (SELECT id, b, repeat, (row_number() OVER (PARTITION BY repeat, y ORDER BY {h('repeat', 'id')}, id) - 1) % {K} AS fold
   FROM score CROSS JOIN (SELECT unnest(range(0, {REPEATS})) AS repeat)),
 p AS (SELECT repeat, fold, sum(b) AS s, count(*) AS n FROM f GROUP BY 1, 2),
 m AS (SELECT p.repeat, p.fold, (sum(p.s) OVER (PARTITION BY p.repeat) - p.s) / (sum(p.n) OVER (PARTITION BY p.repeat) - p.n) AS pred FROM p)
SELECT id, {r('avg(pred)', 4)} AS pred FROM f JOIN m USING (repeat, fold) GROUP BY id""")
def ml16(spark, sf):
    t = Tables(spark, sf)
    f = fd.stratified(score(t), [], "id", "y", K, REPEATS, t.hot("documents"))
    per = f.groupBy("repeat", "fold").agg(F.sum("b").alias("s"), F.count("*").alias("n"))
    tot = per.groupBy("repeat").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    m = per.join(tot, "repeat").select("repeat", "fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("pred"))
    return f.join(m, ["repeat", "fold"]).groupBy("id").agg(rounded(F.avg("pred"), 4).alias("pred"))


@query("ml17_transfer_scores")
def ml17(spark, sf):
    rows = doc_rows(Tables(spark, sf))
    s = ml.scored(rows.filter("cohort <> 'en'"), source_fit(rows), [], "x")
    return s.select("cohort", "id", "y", rounded(F.col("s")).alias("s"))


def source_fit(rows):
    """One model of the source cohort, by distributed passes once it outgrows a task."""
    return ml.fit(rows.filter("cohort = 'en'"), ["cohort"], "y", "x").select("intercept", "coef")


@query("ml17_optimality", with_views(SCORE) + "SELECT cohort, count(*) AS n, true AS at_optimum FROM score WHERE cohort = 'en' GROUP BY 1")
def ml17_optimality(spark, sf):
    rows = doc_rows(Tables(spark, sf))
    params = stored(source_fit(rows).withColumn("cohort", F.lit("en")), "source")
    return ml.optimum(ml.scored(rows.filter("cohort = 'en'"), params, ["cohort"], "x", "d"), params, ["cohort"], "y", "x", "d")


def calibrated_transfer(t: Tables, rows, keys, x, hot):
    """Calibrated target probabilities and the source threshold, per key.

    ``rows`` has a boolean ``is_source``; target labels are carried along but never fitted on.
    """
    src, tgt = rows.filter("is_source"), rows.filter("NOT is_source")
    large = t.large("documents")
    oof = stored(ml.out_of_fold(src, keys, "id", "y", x, K, 1, hot=hot, large=large), "oof")
    cal = stored(ml.calibrated(oof, keys, "y", "s", large), "calibration")
    prob = ml.sigmoid(F.col("slope") * F.col("s") + F.col("offset"))
    thr = rs.control_threshold(oof.join(cal, keys).withColumn("p", prob), keys, "y", "p", hot=hot)
    s = ml.scored(tgt, ml.fit(src, keys, "y", x, large=large), keys, x)
    return s.join(cal, keys).withColumn("p", prob).join(thr, keys)


@query("ml18_calibrated_transfer")
def ml18(spark, sf):
    t = Tables(spark, sf)
    rows = doc_rows(t).withColumns({"g": F.lit("toxic"), "is_source": F.col("cohort") == "en"})
    out = calibrated_transfer(t, rows, ["g"], "x", t.hot("documents"))
    return out.select("cohort", "id", "y", rounded(F.col("p")).alias("p"), rounded(F.col("threshold")).alias("threshold"))


@query("ml19_holdout_fit")
def ml19(spark, sf):
    from tidemark.functions.draws import uniform
    t = Tables(spark, sf)
    rows = doc_rows(t).withColumn("held", uniform("split", F.col("id")) < 0.4)
    s = ml.scored(rows.filter("held"), ml.fit(rows.filter("NOT held"), [], "y", "x"), [], "x")
    a = rs.auc(s, [], "y", "s", hot=t.hot("documents"))
    return a.select(rounded(F.col("auc")).alias("auc"), "n_pos", "n_neg")


@query("ml19_optimality", with_views(SCORE) + f"""
SELECT count(*) AS n, true AS at_optimum FROM score WHERE NOT {u("'split'", 'id')} < 0.4e0""")
def ml19_optimality(spark, sf):
    from tidemark.functions.draws import uniform
    rows = doc_rows(Tables(spark, sf)).filter(~(uniform("split", F.col("id")) < 0.4))
    params = stored(ml.fit(rows, [], "y", "x"), "holdout")
    return ml.optimum(ml.scored(rows, params, [], "x", "d"), params, [], "y", "x", "d")


@query("a11_slope_optimality", with_views(SCORE) + "SELECT cohort, count(*) AS n, true AS at_optimum FROM score GROUP BY 1 HAVING count(DISTINCT y) = 2")
def a11_slope_optimality(spark, sf):
    """The unpenalised gradient of the calibration slope vanishes."""
    from tidemark.operators.operating import logit
    from tidemark.plans.operating import probs
    rows = probs(Tables(spark, sf)).select("cohort", "y", F.array(logit(F.col("pa"))).alias("x"))
    params = stored(ml.fit(rows, ["cohort"], "y", "x", penalty=0.0), "slopes")
    return ml.optimum(ml.scored(rows, params, ["cohort"], "x", "d"), params, ["cohort"], "y", "x", "d", 0.0)


@query("ml04_optimality", with_views(SUBJECT, CONTRAST, CUBE) + f"""
, fld AS (SELECT contrast, subject, y, repeat, (row_number() OVER (PARTITION BY contrast, repeat, y ORDER BY {h('repeat', 'subject')}, subject) - 1) % {K} AS fold
  FROM contr CROSS JOIN (SELECT CAST(unnest(range(0, {REPEATS})) AS INT) AS repeat))
SELECT cond, contrast, repeat, CAST(mfold AS INT) AS mfold, count(*) AS n, true AS at_optimum FROM fld CROSS JOIN (SELECT DISTINCT cond FROM fwide)
CROSS JOIN (SELECT unnest(range(0, {K})) AS mfold) WHERE fold <> mfold GROUP BY 1, 2, 3, 4""")
def ml04_optimality(spark, sf):
    """Every fold's model of the out-of-fold scores is at its optimum over its own training rows."""
    t = Tables(spark, sf)
    g = ["cond", "contrast"]
    rows = fd.stratified(design(t).select(*g, "subject", "y", "x"), g, "subject", "y", K, REPEATS, t.hot("customer", fanout=5 * REPEATS))
    rows = stored(rows, "folded")
    params = stored(ml.fit(rows, [*g, "repeat"], "y", "x", K, large=t.large("customer")), "models")
    m = [*g, "repeat", "mfold"]
    train = ml.scored(rows.join(params.select(*m), [*g, "repeat"]).filter("fold <> mfold"), params, m, "x", "d")
    return ml.optimum(train, params, m, "y", "x", "d")
