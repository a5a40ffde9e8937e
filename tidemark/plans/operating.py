"""Operating points, decision curves, descriptive tables and orderings over the adapters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import scalars as sc
from tidemark.functions.draws import uniform
from tidemark.functions.scalars import rounded
from tidemark.operators import labels as lb
from tidemark.operators import operating as op
from tidemark.operators import rankstats as rs
from tidemark.operators import bootstrap as bs
from tidemark.plans.ranks import LONG
from tidemark.plans.registry import Tables, query
from tidemark.plans.sql import auc_cte, boot, midrank, r, u
from tidemark.tables import (CONTRAST, CUBE, SCORE, SIGNAL, SUBJECT, contrast_rows, cube, score, signal,
                             with_views)

THR = """thr AS (SELECT cohort, quantile_cont(a, 0.8) AS threshold FROM score WHERE y = 0 GROUP BY cohort)"""
READ = f"""pts AS (SELECT cohort, any_value(threshold) AS threshold, avg(CASE WHEN a > threshold THEN 1.0e0 ELSE 0.0e0 END) FILTER (y = 1) AS sens,
  avg(CASE WHEN a <= threshold THEN 1.0e0 ELSE 0.0e0 END) FILTER (y = 0) AS spec, count(*) FILTER (y = 0) AS n0 FROM score JOIN thr USING (cohort) GROUP BY cohort)"""


def points(t: Tables):
    s = score(t)
    thr = rs.control_threshold(s, ["cohort"], "y", "a", hot=t.hot("documents"))
    return rs.read_at(rs.with_group(s, thr, ["cohort"]), ["cohort"], "y", "a")


@query("a06_sensitivity_at", with_views(SCORE, THR, READ) + f"SELECT cohort, {r('sens')} AS sensitivity, {r('threshold')} AS threshold FROM pts")
def a06(spark, sf):
    return points(Tables(spark, sf)).select("cohort", rounded(F.col("sensitivity")).alias("sensitivity"), rounded(F.col("threshold")).alias("threshold"))


@query("a07_read_at_target", with_views(SCORE) + f"""
, thr AS (SELECT quantile_cont(a, 0.8) AS threshold FROM score WHERE y = 0 AND cohort = 'en'),
pts AS (SELECT cohort, avg(CASE WHEN a > threshold THEN 1.0e0 ELSE 0.0e0 END) FILTER (y = 1) AS sens,
  avg(CASE WHEN a <= threshold THEN 1.0e0 ELSE 0.0e0 END) FILTER (y = 0) AS spec, count(*) FILTER (y = 0) AS n0
  FROM score CROSS JOIN thr WHERE cohort <> 'en' GROUP BY cohort)
SELECT cohort, {r('sens')} AS sensitivity, {r('spec')} AS specificity, {r('sens + spec - 1')} AS youden_j, n0 AS n_controls,
  {r('1.0e0 / n0')} AS granularity, {r('0.8e0 - spec')} AS shortfall FROM pts""")
def a07(spark, sf):
    t = Tables(spark, sf)
    s = score(t)
    thr = rs.control_threshold(s.filter("cohort = 'en'"), [], "y", "a", hot=t.hot("documents"))
    out = rs.read_at(s.filter("cohort <> 'en'").crossJoin(F.broadcast(thr)), ["cohort"], "y", "a")
    return out.select("cohort", "n_controls", *[rounded(F.col(c)).alias(c) for c in (
        "sensitivity", "specificity", "youden_j", "granularity", "shortfall")])


PANEL = ["balanced_accuracy", "lr_positive", "lr_negative", "ppv", "npv", "f1", "nns", "flagged_per_1000", "true_per_1000"]


@query("a08_operating_panel", with_views(SCORE, THR, READ) + f"""
SELECT cohort, prevalence, {r('(sens + spec) / 2')} AS balanced_accuracy, {r('CASE WHEN spec < 1 THEN sens / (1 - spec) END')} AS lr_positive,
  {r('CASE WHEN spec > 0 THEN (1 - sens) / spec END')} AS lr_negative, {r('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END')} AS ppv,
  {r('CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END')} AS npv,
  {r('CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * sens / (tp / (tp + fp) + sens) ELSE 0 END')} AS f1,
  {r('CASE WHEN tp > 0 THEN 1 / tp END')} AS nns, {r('1000 * (tp + fp)')} AS flagged_per_1000, {r('1000 * tp')} AS true_per_1000
FROM (SELECT *, sens * prevalence AS tp, (1 - spec) * (1 - prevalence) AS fp, spec * (1 - prevalence) AS tn, (1 - sens) * prevalence AS fn
  FROM pts CROSS JOIN {dims.values_sql([(p,) for p in dims.PREVALENCES])} v(prevalence))""")
def a08(spark, sf):
    out = op.panel(points(Tables(spark, sf)), op.prevalence_table(spark))
    return out.select("cohort", F.col("prevalence").cast("double").alias("prevalence"), *[rounded(F.col(c)).alias(c) for c in PANEL])


@query("a09_average_precision", with_views(SCORE) + f"""
SELECT cohort, {r('CASE WHEN sum(dp) > 0 THEN sum(dp * cp / cn) / sum(dp) END')} AS average_precision FROM (SELECT cohort, a, sum(p) AS dp, sum(sum(p)) OVER w AS cp,
  sum(count(*)) OVER w AS cn FROM (SELECT cohort, a, CAST(y AS DOUBLE) AS p FROM score) GROUP BY cohort, a
  WINDOW w AS (PARTITION BY cohort ORDER BY a DESC)) GROUP BY cohort""")
def a09(spark, sf):
    t = Tables(spark, sf)
    return rs.average_precision(score(t), ["cohort"], "y", "a", hot=t.hot("documents")).withColumn(
        "average_precision", rounded(F.col("average_precision")))


PROB = """prob AS (SELECT cohort, id, y, (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) AS pa,
  (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) AS pc FROM score WINDOW w AS (PARTITION BY cohort))"""


def probs(t: Tables):
    s = lb.min_max_scaled(score(t), ["cohort"], "a", "pa")
    return lb.min_max_scaled(s, ["cohort"], "c", "pc")


@query("a10_brier", with_views(SCORE, PROB) + f"""
SELECT cohort, {r('avg(pow(least(greatest(pa, 1e-6), 1 - 1e-6) - y, 2))')} AS brier FROM prob GROUP BY cohort""")
def a10(spark, sf):
    return op.brier(probs(Tables(spark, sf)), ["cohort"], "y", "pa").withColumn("brier", rounded(F.col("brier")))


@query("a11_calibration_intercept", with_views(SCORE, PROB) + f"""
SELECT cohort, {r('CASE WHEN avg(y) > 0 AND avg(y) < 1 THEN ln(avg(y) / (1 - avg(y))) - avg(ln(q / (1 - q))) END')} AS calibration_intercept
FROM (SELECT cohort, y, least(greatest(pa, 1e-6), 1 - 1e-6) AS q FROM prob) GROUP BY cohort""")
def a11(spark, sf):
    return op.calibration_intercept(probs(Tables(spark, sf)), ["cohort"], "y", "pa").withColumn(
        "calibration_intercept", rounded(F.col("calibration_intercept")))


GRID = f"{dims.values_sql([(t,) for t in dims.net_benefit_grid()])} g(threshold)"
NB = f"""parm AS (SELECT cohort, 'pa' AS arm, y, pa AS p FROM prob UNION ALL SELECT cohort, 'pc', y, pc FROM prob),
nbc AS (SELECT cohort, arm, threshold, count(*) AS n, avg(y) AS prev, count(*) FILTER (y = 1 AND p >= threshold) AS tp,
   count(*) FILTER (y = 0 AND p >= threshold) AS fp FROM parm CROSS JOIN {GRID} WHERE p IS NOT NULL GROUP BY 1, 2, 3),
nb AS (SELECT *, CASE WHEN prev > 0 THEN 0.2e0 / prev ELSE 0 END AS w1, CASE WHEN prev < 1 THEN 0.8e0 / (1 - prev) ELSE 0 END AS w0 FROM nbc),
nbe AS (SELECT *, w1 * n * prev + w0 * n * (1 - prev) AS n_eff FROM nb),
nbv AS (SELECT cohort, arm, threshold, n, (w1 * tp - w0 * fp * threshold / (1 - threshold)) / n_eff AS net_benefit,
   0.2e0 - 0.8e0 * threshold / (1 - threshold) AS treat_all, (w1 * tp + w0 * fp) / n_eff AS flagged FROM nbe)"""


def curves(t: Tables):
    arms = rs.long_scores(probs(t), ["cohort"], "y", ["pa", "pc"], value="p")
    return rs.net_benefit(arms, ["cohort", "arm"], "y", "p", op.threshold_table(t.spark), 0.2)


@query("a12_net_benefit", with_views(SCORE, PROB, NB) + f"""
SELECT cohort, arm, {r('threshold')} AS threshold, n, {r('net_benefit')} AS net_benefit, {r('treat_all')} AS treat_all, {r('flagged')} AS flagged_fraction FROM nbv""")
def a12(spark, sf):
    return curves(Tables(spark, sf)).select("cohort", "arm", "n", *[rounded(F.col(c)).alias(c) for c in (
        "threshold", "net_benefit", "treat_all", "flagged_fraction")])


@query("a13_curve_summary", with_views(SCORE, PROB, NB) + f"""
, j AS (SELECT a.cohort, a.threshold, c.net_benefit - a.net_benefit AS d, c.net_benefit AS nb, a.treat_all FROM nbv a JOIN nbv c
   ON a.cohort = c.cohort AND a.threshold = c.threshold AND a.arm = 'pa' AND c.arm = 'pc'),
 uf AS (SELECT *, d > 0 AND nb > treat_all AND nb > 0 AS ok FROM j)
SELECT cohort, {r('min(threshold) FILTER (ok)')} AS from_threshold, {r('max(threshold) FILTER (ok)')} AS to_threshold,
  {r('coalesce(max(1000 * d) FILTER (ok), 0)')} AS max_gain_per_1000, {r('arg_max(threshold, (d, -threshold)) FILTER (ok)')} AS threshold_at_max FROM uf GROUP BY cohort""")
def a13(spark, sf):
    out = op.curve_summary(curves(Tables(spark, sf)), ["cohort"], "arm", "pa", "pc")
    return out.select("cohort", *[rounded(F.col(c)).alias(c) for c in ("from_threshold", "to_threshold", "max_gain_per_1000", "threshold_at_max")])


@query("a14_substitution_ratio", with_views(SCORE, LONG, auc_cte("res", "slong", "cohort, arm", "y", "s")) + f"""
SELECT a.cohort, {r('CASE WHEN a.auc - 0.5e0 > 1e-9 THEN (a.auc - c.auc) / (a.auc - 0.5e0) END')} AS rho FROM res a JOIN res c
ON a.cohort = c.cohort AND a.arm = 'a' AND c.arm = 'c'""")
def a14(spark, sf):
    t = Tables(spark, sf)
    x = rs.auc(rs.long_scores(score(t), ["cohort"], "y", ["a", "c"]), ["cohort", "arm"], "y", "s", hot=t.hot("documents"))
    p = x.groupBy("cohort").agg(F.max(F.when(F.col("arm") == "a", F.col("auc"))).alias("x"), F.max(F.when(F.col("arm") == "c", F.col("auc"))).alias("m"))
    return p.select("cohort", rounded(sc.substitution_ratio(F.col("x"), F.col("m"))).alias("rho"))


def _wilson_sql(k: str, n: str, sign: str) -> str:
    return (f"({k} / {n}::DOUBLE + 3.8416e0 / (2 * {n}) {sign} 1.96e0 * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n}"
            f" + 3.8416e0 / (4.0e0 * {n} * {n}))) / (1 + 3.8416e0 / {n})")


@query("a15_wilson", f"""
SELECT o_orderpriority AS grp, n, k, {r(_wilson_sql('k', 'n', '-'))} AS ci_lo, {r(_wilson_sql('k', 'n', '+'))} AS ci_hi FROM (
  SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1)""")
def a15(spark, sf):
    g = Tables(spark, sf).orders.groupBy(F.col("o_orderpriority").alias("grp")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    lo, hi = sc.wilson(F.col("k"), F.col("n"))
    return g.select("grp", "n", "k", rounded(lo).alias("ci_lo"), rounded(hi).alias("ci_hi"))


@query("a16_subgroup_flags", with_views(SCORE) + f"""
, thr AS (SELECT quantile_cont(a, 0.8) AS threshold FROM score WHERE y = 0),
g AS (SELECT tag, CASE WHEN y = 1 THEN 'sensitivity' ELSE 'false_referral' END AS kind, count(*) AS n, count(*) FILTER (a > threshold) AS k
  FROM (SELECT *, unnest([cohort, source]) AS tag FROM score) CROSS JOIN thr GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT tag, kind, n, k AS flagged, {r('k / n::DOUBLE')} AS rate, {r(_wilson_sql('k', 'n', '-'))} AS ci_lo, {r(_wilson_sql('k', 'n', '+'))} AS ci_hi FROM g""")
def a16(spark, sf):
    t = Tables(spark, sf)
    s = score(t)
    thr = rs.control_threshold(s, [], "y", "a", hot=t.hot("documents"))
    tagged = s.select("*", F.explode(F.array("cohort", "source")).alias("tag")).crossJoin(F.broadcast(thr))
    kind = F.when(F.col("y") == 1, "sensitivity").otherwise("false_referral")
    out = op.flag_rates(tagged.withColumn("kind", kind), ["tag", "kind"], F.col("a") > F.col("threshold"))
    return out.select("tag", "kind", "n", "flagged", *[rounded(F.col(c)).alias(c) for c in ("rate", "ci_lo", "ci_hi")])


@query("a17_regression_metrics", with_views(SCORE) + f"""
SELECT cohort, count(*) AS n, {r('avg(abs(6 * a - b))', 4)} AS mae, {r('sqrt(avg(pow(6 * a - b, 2)))', 4)} AS rmse, {r('corr(6 * a, b)')} AS pcc FROM score GROUP BY cohort""")
def a17(spark, sf):
    s = score(Tables(spark, sf)).withColumn("pred", 6 * F.col("a"))
    m = op.regression_metrics(s, ["cohort"], "b", "pred")
    return m.select("cohort", "n", rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("rmse"), 4).alias("rmse"), rounded(F.col("pcc")).alias("pcc"))


@query("a17_regression_intervals", with_views(SCORE, "pr AS (SELECT cohort, id, b AS y, 6 * a AS p FROM score)",
       boot("regci", "pr", "id", "cohort, y, p", 2000, "ws"), "xs AS (SELECT cohort, b, y, p, unnest(range(0, w)) FROM ws)",
       "mt AS (SELECT cohort, b, avg(abs(p - y)) AS mae, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(y) > 0 THEN corr(p, y) END AS pcc FROM xs GROUP BY 1, 2)") + f"""
SELECT cohort, {r('quantile_cont(mae, 0.025)', 4)} AS mae_lo, {r('quantile_cont(mae, 0.975)', 4)} AS mae_hi,
  {r('quantile_cont(pcc, 0.025)', 5)} AS pcc_lo, {r('quantile_cont(pcc, 0.975)', 5)} AS pcc_hi FROM mt GROUP BY cohort""")
def a17_intervals(spark, sf):
    s = score(Tables(spark, sf)).select("cohort", "id", F.col("b").alias("y"), (6 * F.col("a")).alias("p"))
    m = bs.regression_intervals(s, ["cohort"], "id", "y", "p", 2000, "regci")
    return m.select("cohort", *[rounded(F.col(c), 4).alias(c) for c in ("mae_lo", "mae_hi")],
                    *[rounded(F.col(c), 5).alias(c) for c in ("pcc_lo", "pcc_hi")])


@query("a18_span_ratio", with_views(SCORE, LONG, auc_cte("res", "slong", "cohort, arm", "y", "s"),
       "sp AS (SELECT arm, max(auc) - min(auc) AS span FROM res GROUP BY arm)") + f"""
SELECT {r('x.span')} AS span_above, {r('y.span')} AS span_below, {r('x.span / y.span')} AS ratio FROM sp x, sp y WHERE x.arm = 'a' AND y.arm = 'c'""")
def a18_ratio(spark, sf):
    t = Tables(spark, sf)
    x = rs.auc(rs.long_scores(score(t), ["cohort"], "y", ["a", "b", "c"]), ["cohort", "arm"], "y", "s", hot=t.hot("documents"))
    out = op.span_ratio(op.spans(x, ["arm"], "cohort", "auc"), "arm", "a", "c")
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query("a18_spans", with_views(SCORE, LONG, auc_cte("res", "slong", "cohort, arm", "y", "s")) + f"""
SELECT arm, {r('max(auc) - min(auc)')} AS span, arg_max(cohort, (auc, cohort)) FILTER (auc IS NOT NULL) AS best, arg_min(cohort, (auc, cohort)) FILTER (auc IS NOT NULL) AS worst FROM res GROUP BY arm""")
def a18(spark, sf):
    t = Tables(spark, sf)
    x = rs.auc(rs.long_scores(score(t), ["cohort"], "y", ["a", "b", "c"]), ["cohort", "arm"], "y", "s", hot=t.hot("documents"))
    return op.spans(x, ["arm"], "cohort", "auc").withColumn("span", rounded(F.col("span")))


@query("a19_events_per_variable", with_views(SUBJECT, CONTRAST, CUBE) + f"""
, f AS (SELECT cond, count(*) AS k FROM (SELECT cond, feature FROM cube GROUP BY 1, 2 HAVING count(*) = count(value)) GROUP BY 1),
c AS (SELECT contrast, cohort, least(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) AS m FROM contr GROUP BY 1, 2)
SELECT contrast, cohort, cond, {r('m / greatest(k, 1)::DOUBLE')} AS epv, m / greatest(k, 1)::DOUBLE >= 10 AS powered FROM c CROSS JOIN f""")
def a19(spark, sf):
    t = Tables(spark, sf)
    k = lb.usable_features(cube(t), ["cond", "feature"]).groupBy("cond").agg(F.count("*").alias("k"))
    m = contrast_rows(t).groupBy("contrast", "cohort").agg(
        F.least(F.sum(rs.positives("y")), F.sum(rs.negatives("y"))).alias("m"))
    e = sc.events_per_variable(F.col("m"), F.col("k"))
    return m.crossJoin(k).select("contrast", "cohort", "cond", rounded(e).alias("epv"), (e >= dims.MIN_EPV).alias("powered"))


@query("a22_carried_f1", with_views(SCORE) + f"""
, thr AS (SELECT quantile_cont(a, 0.8) AS threshold FROM score WHERE y = 0 AND cohort = 'en'),
g AS (SELECT source, count(*) FILTER (y = 1 AND a > threshold) AS tp, count(*) FILTER (y = 0 AND a > threshold) AS fp,
  count(*) FILTER (y = 1 AND a <= threshold) AS fn, count(*) FILTER (y = 0 AND a <= threshold) AS tn FROM score CROSS JOIN thr GROUP BY 1)
SELECT *, {r('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0e0 * tp / (2 * tp + fp + fn) ELSE 0 END')} AS f1 FROM g""")
def a22(spark, sf):
    t = Tables(spark, sf)
    s = score(t)
    thr = rs.control_threshold(s.filter("cohort = 'en'"), [], "y", "a", hot=t.hot("documents"))
    return op.f1_at(s.crossJoin(F.broadcast(thr)), ["source"], "y", F.col("a") > F.col("threshold")).withColumn("f1", rounded(F.col("f1")))


@query("a23_strata_composition", with_views(SUBJECT) + f"""
, sc AS (SELECT o_custkey AS subject, sum(o_totalprice / 100000) AS score FROM orders GROUP BY 1)
SELECT stratum, count(*) AS n, {r('avg(age)')} AS mean_age, {r('avg(score)')} AS mean_score, {r('avg(CASE WHEN score < 19 THEN 1.0e0 WHEN score >= 19 THEN 0.0e0 END)')} AS share_severe FROM (
  SELECT age, score, unnest(CASE WHEN label = 'CN' THEN ['all', 'controls', cohort] ELSE ['all', cohort] END) AS stratum
  FROM subject LEFT JOIN sc USING (subject) WHERE age IS NOT NULL) GROUP BY 1""")
def a23(spark, sf):
    t = Tables(spark, sf)
    measured = t.orders.groupBy(F.col("o_custkey").alias("subject")).agg(F.sum(F.col("o_totalprice") / 100000).alias("score"))
    s = subject_with_age(t).join(measured, "subject", "left")
    strata = F.array_compact(F.array(F.lit("all"), F.when(F.col("label") == "CN", "controls"), F.col("cohort")))
    return s.select("age", "score", F.explode(strata).alias("stratum")).groupBy("stratum").agg(
        F.count("*").alias("n"), rounded(F.avg("age")).alias("mean_age"), rounded(F.avg("score")).alias("mean_score"),
        rounded(F.avg((F.col("score") < 19).cast("double"))).alias("share_severe"))


def subject_with_age(t: Tables):
    from tidemark.tables import subject
    return subject(t).filter("age IS NOT NULL")


@query("a24_power_design", with_views(SUBJECT, CONTRAST) + f"""
SELECT contrast, cohort, {r('delta')} AS delta, {r('round_even(n * pow(se / (delta / (1.959964e0 + 0.8416212e0)), 2) / 10, 0) * 10')} AS n_required FROM (
  SELECT contrast, cohort, count(*) AS n, stddev_samp(age) / 100 / sqrt(count(*)) * 1.96e0 / 1.959964e0 AS se FROM contr GROUP BY 1, 2)
CROSS JOIN {dims.values_sql([(d,) for d in dims.DESIGN_DELTAS])} v(delta)""")
def a24(spark, sf):
    g = contrast_rows(Tables(spark, sf)).groupBy("contrast", "cohort").agg(
        F.count("*").alias("n"), (F.stddev_samp("age") / 100 / F.sqrt(F.count("*"))).alias("se"))
    g = g.withColumns({"ci_lo": -1.96 * F.col("se"), "ci_hi": 1.96 * F.col("se")})
    out = op.power_design(g, dims.table(spark, [(d,) for d in dims.DESIGN_DELTAS], "delta"))
    return out.select("contrast", "cohort", rounded(F.col("delta")).alias("delta"), rounded(F.col("n_required")).alias("n_required"))


STATED = """vals AS (SELECT DISTINCT substr(text, 1, 3) AS value FROM documents WHERE length(text) >= 3),
occ AS (SELECT value AS name, lang, CAST(sum((length(text) - length(replace(text, value, ''))) / length(value)) AS BIGINT) AS n,
  count(*) AS n_texts FROM documents JOIN vals ON contains(text, value) GROUP BY 1, 2)"""


def stated_values(t: Tables):
    """(name, value): the openings of all texts, looked for in every text."""
    value = F.substring("text", 1, 3)
    return t.documents.filter(F.length("text") >= 3).select(value.alias("name"), value.alias("value")).distinct()


@query("a26_occurrences", f"WITH {STATED} SELECT name, lang, n, n_texts FROM occ")
def a26(spark, sf):
    t = Tables(spark, sf)
    return op.occurrences(t.documents, ["lang"], "text", stated_values(t))


@query("a26_miscounted", f"""WITH {STATED}, rec AS (SELECT substr(text, 1, 3) AS name, count(*) AS stated FROM documents WHERE length(text) >= 3 AND lang <> 'fr' GROUP BY 1),
cur AS (SELECT name, sum(n_texts) AS current FROM occ GROUP BY 1)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN current IS NULL THEN 'vanished' WHEN stated IS NULL THEN 'new' WHEN stated = current THEN 'match'
  WHEN stated < current THEN 'miscounted' ELSE 'drifted' END AS status FROM rec FULL JOIN cur USING (name)) GROUP BY 1""")
def a26_miscounted(spark, sf):
    """Recorded counts of values against their occurrences in the texts."""
    t = Tables(spark, sf)
    found = op.occurrences(t.documents, [], "text", stated_values(t)).select("name", F.col("n_texts").alias("current"))
    stated = t.documents.filter((F.length("text") >= 3) & (F.col("lang") != "fr")).groupBy(F.substring("text", 1, 3).alias("name")).agg(F.count("*").alias("stated"))
    status = (F.when(F.col("current").isNull(), "vanished").when(F.col("stated").isNull(), "new").when(F.col("stated") == F.col("current"), "match")
              .when(F.col("stated") < F.col("current"), "miscounted").otherwise("drifted"))
    return stated.join(found, "name", "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("r02_rank_fraction", with_views(SCORE, LONG.replace("SELECT cohort,", "SELECT id, cohort,")) + f"""
SELECT id, {r('avg(rk)')} AS score FROM (SELECT id, {midrank('cohort, arm', 's')} / count(*) OVER (PARTITION BY cohort, arm) AS rk FROM slong) GROUP BY id""")
def r02(spark, sf):
    t = Tables(spark, sf)
    rows = rs.long_scores(score(t), ["id", "cohort"], "y", ["a", "b", "c"])
    f = op.rank_fraction(rows, ["cohort", "arm"], "s", "f", t.hot("documents"))
    return f.groupBy("id").agg(rounded(F.avg("f")).alias("score"))


@query("r03_first_crossing", with_views(SCORE) + """
SELECT cohort, (round(min(b) FILTER (c >= 0.5e0 * tot), 6) + 0.0e0) AS b_half FROM (SELECT cohort, b, sum(b) OVER (PARTITION BY cohort ORDER BY b, id) AS c,
  sum(b) OVER (PARTITION BY cohort) AS tot FROM score) GROUP BY cohort""")
def r03(spark, sf):
    from tidemark.operators.ordered import running
    t = Tables(spark, sf)
    s = score(t).select("cohort", "id", "b")
    cum = running(s, ["cohort"], ["b", "id"], {"cum": F.col("b")}, t.hot("documents"))
    tot = s.groupBy("cohort").agg(F.sum("b").alias("tot"))
    return cum.join(tot, "cohort").groupBy("cohort").agg(rounded(F.min(F.when(F.col("cum") >= 0.5 * F.col("tot"), F.col("b")))).alias("b_half"))


@query("r04_differences", with_views(SIGNAL) + f"""
SELECT rec, channel, t, {r('x - lag(x) OVER w', 4)} AS d1, {r('x - 2 * lag(x) OVER w + lag(x, 2) OVER w', 4)} AS d2 FROM signal
WINDOW w AS (PARTITION BY rec, channel ORDER BY t)""")
def r04(spark, sf):
    d = op.differences(signal(Tables(spark, sf)), ["rec", "channel"], "t", "x")
    return d.select("rec", "channel", "t", rounded(F.col("d1"), 4).alias("d1"), rounded(F.col("d2"), 4).alias("d2"))


@query("r05_holm", f"""
WITH t AS (SELECT source, doc_id, {u("'holm'", 'doc_id')} / 20 AS p FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM t)
SELECT source, doc_id, {r('least(1.0e0, max((n - k + 1) * p) OVER (PARTITION BY source ORDER BY k))')} AS p_holm FROM k""")
def r05(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("source", "doc_id", (uniform("holm", F.col("doc_id")) / 20).alias("p"))
    return rs.holm(d, ["source"], "p", ["doc_id"], hot=t.hot("documents")).select("source", "doc_id", rounded(F.col("p_holm")).alias("p_holm"))


@query("r06_rank_interpolation", with_views(SCORE) + f"""
, ra AS (SELECT cohort, a, row_number() OVER (PARTITION BY cohort ORDER BY a, id) AS i FROM score WHERE y = 0),
rc AS (SELECT cohort, c, row_number() OVER (PARTITION BY cohort ORDER BY c, id) AS i FROM score WHERE y = 0),
tb AS (SELECT cohort, a, min(c) AS fst, max(c) AS lst FROM ra JOIN rc USING (cohort, i) GROUP BY 1, 2),
h AS (SELECT cohort, id, a FROM score WHERE y = 1),
p AS (SELECT h.cohort, h.id, h.a, (SELECT max(t.a) FROM tb t WHERE t.cohort = h.cohort AND t.a <= h.a) AS lo,
   (SELECT min(t.a) FROM tb t WHERE t.cohort = h.cohort AND t.a >= h.a) AS hi FROM h)
SELECT p.cohort, p.id, {r('''CASE WHEN lo IS NULL THEN (SELECT min(fst) FROM tb t WHERE t.cohort = p.cohort)
  WHEN hi IS NULL THEN (SELECT max(lst) FROM tb t WHERE t.cohort = p.cohort) WHEN lo = hi THEN l.lst
  ELSE l.lst + (u.fst - l.lst) * (p.a - lo) / (hi - lo) END''')} AS placed FROM p
LEFT JOIN tb l ON l.cohort = p.cohort AND l.a = lo LEFT JOIN tb u ON u.cohort = p.cohort AND u.a = hi
WHERE p.cohort IN (SELECT cohort FROM tb)""")
def r06(spark, sf):
    t = Tables(spark, sf)
    s = score(t)
    out = op.interpolated_ranks(s.filter("y = 0"), s.filter("y = 1"), ["cohort"], "a", "c", hot=t.hot("documents"))
    return out.select("cohort", "id", rounded(F.col("placed")).alias("placed"))


TOP_FEATURES = 6
FAUC = auc_cte("fauc", "frow", "contrast, cond, feature", "y", "value")
FROW = """frow AS (SELECT k.contrast, k.cohort, c.cond, c.feature, c.value, k.y FROM cube c JOIN contr k ON k.subject = c.subject)"""


def feature_aucs(t: Tables):
    """AUC and strength of every (contrast, condition, feature)."""
    rows = cube(t).join(contrast_rows(t).select("contrast", "subject", "y"), "subject")
    return rs.auc(rows, ["contrast", "cond", "feature"], "y", "value", hot=t.hot("customer")).withColumn("strength", F.abs(F.col("auc") - 0.5))


@query("a05_feature_auc", with_views(SUBJECT, CONTRAST, CUBE, FROW, FAUC) + f"""
SELECT contrast, cond, feature, {r('auc')} AS auc, {r('abs(auc - 0.5e0)')} AS strength, n_pos, n_neg FROM fauc""")
def a05(spark, sf):
    return feature_aucs(Tables(spark, sf)).withColumns({"auc": rounded(F.col("auc")), "strength": rounded(F.col("strength"))})


@query("r07_top_features", with_views(SUBJECT, CONTRAST, CUBE, FROW, FAUC) + f"""
, p AS (SELECT contrast, feature, max(abs(auc - 0.5e0)) AS strength, arg_max(cond, (abs(auc - 0.5e0), cond)) AS peak FROM fauc GROUP BY 1, 2)
SELECT contrast, feature, peak, {r('strength')} AS strength, k FROM (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY strength DESC, feature) AS k FROM p) WHERE k <= 3""")
def r07(spark, sf):
    p = feature_aucs(Tables(spark, sf)).groupBy("contrast", "feature").agg(
        F.max("strength").alias("strength"), F.max_by("cond", F.struct("strength", "cond")).alias("peak"))
    top = op.top_k(p, ["contrast"], [F.col("strength").desc(), "feature"], 3)
    return top.select("contrast", "feature", "peak", rounded(F.col("strength")).alias("strength"), "k")


@query("a05_topography", with_views(SUBJECT, CONTRAST, CUBE, FROW, auc_cte("cauc", "frow", "contrast, cohort, cond, feature", "y", "value")) + f"""
, pr AS (SELECT contrast, feature, cond AS region, avg(abs(auc - 0.5e0)) AS strength, count(auc) AS n_cohorts FROM cauc WHERE n_pos >= 5 GROUP BY 1, 2, 3),
 pk AS (SELECT contrast, feature, max(strength) AS strength, arg_max(region, (round(strength, 9), region)) AS peak_region FROM pr GROUP BY 1, 2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY round(strength, 9) DESC, feature) AS k FROM pk)
SELECT pr.contrast, k, feature, peak_region, region, {r('pr.strength')} AS strength, n_cohorts, {r('avg(pr.strength) OVER (PARTITION BY pr.contrast, region)')} AS region_mean
FROM pr JOIN rk USING (contrast, feature) WHERE k <= {TOP_FEATURES}""")
def a05_topography(spark, sf):
    """Profile of the strongest features over the measured regions, averaged over cohorts with enough cases; the region where each peaks."""
    from pyspark.sql import Window as W
    t = Tables(spark, sf)
    rows = cube(t).join(contrast_rows(t).select("contrast", "cohort", "subject", "y"), "subject")
    per = rs.auc(rows, ["contrast", "cohort", "cond", "feature"], "y", "value", hot=t.hot("customer")).filter("n_pos >= 5")
    g = ["contrast", "feature"]
    profile = per.groupBy(*g, F.col("cond").alias("region")).agg(F.avg(F.abs(F.col("auc") - 0.5)).alias("strength"), F.count("auc").alias("n_cohorts"))
    place = F.struct(F.round("strength", 9).alias("s"), "region")
    # One row a region: the regions of a feature are a design list.
    peak = profile.groupBy(*g).agg(F.max("strength").alias("best"), F.max_by("region", place).alias("peak_region"), F.collect_list(F.struct("region", "strength", "n_cohorts")).alias("l"))
    top = op.top_k(peak, ["contrast"], [F.round("best", 9).desc(), "feature"], TOP_FEATURES).select("contrast", "k", "feature", "peak_region", F.explode("l").alias("e"))
    out = top.select("contrast", "k", "feature", "peak_region", "e.*").withColumn("region_mean", F.avg("strength").over(W.partitionBy("contrast", "region")))
    return out.withColumns({"strength": rounded(F.col("strength")), "region_mean": rounded(F.col("region_mean"))})


@query("r08_case_pick", with_views(SUBJECT, CONTRAST) + f"""
, lim AS (SELECT contrast, quantile_cont(age, 0.2) AS q FROM contr WHERE y = 1 GROUP BY 1),
z AS (SELECT k.contrast, k.subject, o_orderkey, o_totalprice / 100000 - 2.5e0 AS z FROM contr k JOIN lim USING (contrast) JOIN orders ON o_custkey = subject
  WHERE k.y = 1 AND age < q),
best AS (SELECT contrast, arg_max(subject, (m, -subject)) AS subject FROM (SELECT contrast, subject, max(abs(z)) AS m FROM z GROUP BY 1, 2) GROUP BY 1)
SELECT contrast, subject, o_orderkey, {r('z')} AS z, k FROM (SELECT z.*, row_number() OVER (PARTITION BY contrast ORDER BY abs(z) DESC, o_orderkey) AS k
  FROM z JOIN best USING (contrast, subject)) WHERE k <= 3""")
def r08(spark, sf):
    from tidemark.operators.ordered import quantiles
    t = Tables(spark, sf)
    case = contrast_rows(t).filter("y = 1")
    lim = quantiles(case, ["contrast"], "age", {"q": 0.2}, t.hot("customer"))
    young = case.join(lim, "contrast").filter("age < q").select("contrast", "subject")
    z = young.join(t.orders.select(F.col("o_custkey").alias("subject"), "o_orderkey", (F.col("o_totalprice") / 100000 - 2.5).alias("z")), "subject")
    peak = z.groupBy("contrast", "subject").agg(F.max(F.abs("z")).alias("m"))
    best = peak.groupBy("contrast").agg(F.max_by("subject", F.struct("m", (-F.col("subject")).alias("s"))).alias("subject"))
    top = op.top_k(z.join(best, ["contrast", "subject"]), ["contrast"], [F.abs("z").desc(), "o_orderkey"], 3)
    return top.select("contrast", "subject", "o_orderkey", rounded(F.col("z")).alias("z"), "k")


@query("r09_smallest_n", """
SELECT source, min(k) FILTER (c >= 0.5e0 * tot) AS n_half FROM (SELECT source, row_number() OVER w AS k, sum(n_chars) OVER w AS c,
  sum(n_chars) OVER (PARTITION BY source) AS tot FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)) GROUP BY 1""")
def r09(spark, sf):
    from tidemark.operators.ordered import running
    t = Tables(spark, sf)
    d = t.documents.select("source", "doc_id", "n_chars", (-F.col("n_chars")).alias("o"))
    run = running(d, ["source"], ["o", "doc_id"], {"k": F.lit(1).cast("bigint"), "cum": F.col("n_chars")}, t.hot("documents"))
    tot = d.groupBy("source").agg(F.sum("n_chars").alias("tot"))
    return run.join(tot, "source").groupBy("source").agg(F.min(F.when(F.col("cum") >= 0.5 * F.col("tot"), F.col("k"))).alias("n_half"))


@query("r10_conservative_reading", with_views(SCORE, LONG, auc_cte("res", "slong", "cohort, arm", "y", "s")) + f"""
SELECT cohort, arg_min(arm, (auc, arm)) FILTER (auc IS NOT NULL) AS worst_arm, {r('min(auc)')} AS worst, arg_max(arm, (auc, arm)) FILTER (auc IS NOT NULL) AS best_arm, {r('max(auc)')} AS best FROM res GROUP BY 1""")
def r10(spark, sf):
    t = Tables(spark, sf)
    x = rs.auc(rs.long_scores(score(t), ["cohort"], "y", ["a", "b", "c"]), ["cohort", "arm"], "y", "s", hot=t.hot("documents"))
    ends = x.groupBy("cohort").agg(rounded(F.min("auc")).alias("low"), rounded(F.max("auc")).alias("high"))
    return op.spans(x, ["cohort"], "arm", "auc").join(ends, "cohort").select(
        "cohort", F.col("worst").alias("worst_arm"), F.col("low").alias("worst"), F.col("best").alias("best_arm"), F.col("high").alias("best"))


@query("s01_report_formats", f"""
SELECT o_custkey AS k, printf('%.3f', v) AS plain, printf('%+.3f', v) AS signed, printf('%.0f%%', v * 100) AS percent,
  CASE WHEN v < 1e-4 THEN 'P<0.0001' WHEN v < 1e-3 THEN 'P=' || printf('%.4f', v) ELSE 'P=' || printf('%.3f', v) END AS p,
  printf('[%+.3f, %+.3f]', v - 0.1e0, v + 0.1e0) AS ci FROM (SELECT o_custkey, {u("'fmt'", 'o_custkey')} AS v FROM orders GROUP BY 1)""")
def s01(spark, sf):
    v = F.col("v")
    d = Tables(spark, sf).orders.select(F.col("o_custkey").alias("k")).distinct().withColumn("v", uniform("fmt", F.col("k")))
    return d.select("k", sc.text3(v).alias("plain"), sc.text_signed(v).alias("signed"), sc.text_percent(v).alias("percent"),
                    sc.text_p(v).alias("p"), sc.text_ci(v - 0.1, v + 0.1).alias("ci"))
