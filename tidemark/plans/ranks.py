"""Rank statistics, paired tests and operating points over the adapters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import rounded, wilson
from tidemark.operators import rankstats as rs
from tidemark.operators.ordered import midranks
from tidemark.plans.registry import Tables, query
from tidemark.plans.sql import auc_cte, delong_cte, midrank, p_of, r
from tidemark.tables import (CONTRAST, CUBE, SCORE, SUBJECT, contrast_rows, features_wide, score,
                             with_views)

LONG = """slong AS (SELECT cohort, 'a' AS arm, y, a AS s FROM score
  UNION ALL SELECT cohort, 'b', y, b FROM score UNION ALL SELECT cohort, 'c', y, c FROM score)"""


@query("r01_midrank", with_views(SCORE) + f"""
SELECT id, cohort, {r(midrank('cohort', 'a'))} AS midrank FROM score""")
def r01(spark, sf):
    t = Tables(spark, sf)
    return midranks(score(t), ["cohort"], "a", hot=t.hot("documents")).select(
        "id", "cohort", rounded(F.col("midrank")).alias("midrank"))


@query("a03_auc", with_views(SCORE, LONG, auc_cte("res", "slong", "cohort, arm", "y", "s")) + f"""
SELECT cohort, arm, {r('auc')} AS auc, n_pos, n_neg FROM res""")
def a03(spark, sf):
    t = Tables(spark, sf)
    rows = rs.long_scores(score(t), ["cohort"], "y", ["a", "b", "c"])
    return rs.auc(rows, ["cohort", "arm"], "y", "s", hot=t.hot("documents")).withColumn(
        "auc", rounded(F.col("auc")))


@query("a04_direction_free_auc",
       with_views(SUBJECT, CONTRAST, auc_cte("res", "contr", "contrast, cohort", "y", "age")) + f"""
SELECT contrast, cohort, {r('auc')} AS transported, {r('greatest(auc, 1 - auc)')} AS sign_agnostic FROM res""")
def a04(spark, sf):
    t = Tables(spark, sf)
    out = rs.auc(contrast_rows(t), ["contrast", "cohort"], "y", "age", hot=t.hot("customer"))
    a = F.col("auc")
    return out.select("contrast", "cohort", rounded(a).alias("transported"),
                      rounded(F.greatest(a, 1 - a)).alias("sign_agnostic"))


DELONG_OUT = f"""n, {r('auc_a')} AS auc_a, {r('auc_b')} AS auc_b, {r('diff')} AS diff, {r('se')} AS se,
  {r('z', 5)} AS z, {r(p_of(), 5)} AS p, {r('CASE WHEN flat THEN 0.0e0 ELSE diff - 1.96e0 * se END')} AS ci_lo,
  {r('CASE WHEN flat THEN 0.0e0 ELSE diff + 1.96e0 * se END')} AS ci_hi"""


def delong_out(df, *keys):
    return df.select(*keys, "n", *[rounded(F.col(c)).alias(c) for c in ("auc_a", "auc_b", "diff", "se")],
                     rounded(F.col("z"), 5).alias("z"), rounded(F.col("p"), 5).alias("p"),
                     *[rounded(F.col(c)).alias(c) for c in ("ci_lo", "ci_hi")])


@query("i01_delong_covariance", with_views(SCORE, delong_cte("res", "score", "cohort", "y", "a", "c")) + f"""
SELECT cohort, n, {r('auc_a')} AS auc_a, {r('auc_b')} AS auc_b, {r('se * se', 9)} AS var_diff FROM res""")
def i01(spark, sf):
    t = Tables(spark, sf)
    d = rs.delong(score(t), ["cohort"], "y", "a", "c", hot=t.hot("documents"))
    return d.select("cohort", "n", rounded(F.col("auc_a")).alias("auc_a"), rounded(F.col("auc_b")).alias("auc_b"),
                    rounded(F.col("se") * F.col("se"), 9).alias("var_diff"))


@query("i02_delong_test", with_views(SCORE, delong_cte("res", "score", "source", "y", "a", "b")) + f"""
SELECT source, {DELONG_OUT} FROM res""")
def i02(spark, sf):
    t = Tables(spark, sf)
    return delong_out(rs.delong(score(t), ["source"], "y", "a", "b", hot=t.hot("documents")), "source")


MARGIN_SRC = """msrc AS (SELECT f.cond, k.contrast, k.y, k.age, f.f_total AS s,
  0.5e0 * f.f_total + 0.01e0 * k.age AS tot FROM contr k JOIN fwide f ON f.subject = k.subject)"""


def margin_rows(t: Tables):
    """(cond, contrast, y, age, s, tot): fixed scores of every subject under every condition."""
    f = features_wide(t).select("cond", "subject", F.col("f_total").alias("s"))
    return contrast_rows(t).join(f, "subject").withColumn(
        "tot", 0.5 * F.col("s") + 0.01 * F.col("age"))


@query("i03_registered_margins", with_views(
    SUBJECT, CONTRAST, CUBE, MARGIN_SRC, delong_cte("sub", "msrc", "cond, contrast", "y", "s", "age"),
    delong_cte("inc", "msrc", "cond, contrast", "y", "tot", "age"),
    f"""tests AS (SELECT 'sub' AS margin, *, {p_of()} AS p FROM sub
       UNION ALL SELECT 'inc' AS margin, *, {p_of()} AS p FROM inc)""",
    """ranked AS (SELECT *, count(*) OVER (PARTITION BY cond) - row_number() OVER
        (PARTITION BY cond ORDER BY p, contrast, margin) + 1 AS mult,
        row_number() OVER (PARTITION BY cond ORDER BY p, contrast, margin) AS k FROM tests)""") + f"""
SELECT cond, contrast, margin, n, {r('auc_a')} AS auc_score, {r('auc_b')} AS auc_age, {r('diff')} AS diff,
  {r('se')} AS se, {r('z', 5)} AS z, {r('p', 5)} AS p,
  {r('least(1.0e0, max(mult * p) OVER (PARTITION BY cond ORDER BY k))', 5)} AS p_holm FROM ranked""")
def i03_registered(spark, sf):
    """Margins of scores that are registered once, with no fit: exact."""
    t = Tables(spark, sf)
    rows = margin_rows(t)
    arms = rows.select("cond", "contrast", "y", "age", F.explode(F.create_map(
        F.lit("sub"), F.col("s"), F.lit("inc"), F.col("tot"))).alias("margin", "s"))
    d = rs.delong(arms, ["cond", "contrast", "margin"], "y", "s", "age",
                  hot=t.hot("customer", fanout=30))  # rows of all groups
    d = rs.holm(d, ["cond"], "p", ["contrast", "margin"], hot=False)  # six tests a family
    return d.select("cond", "contrast", "margin", "n", rounded(F.col("auc_a")).alias("auc_score"),
                    rounded(F.col("auc_b")).alias("auc_age"), rounded(F.col("diff")).alias("diff"),
                    rounded(F.col("se")).alias("se"), *[rounded(F.col(c), 5).alias(c) for c in ("z", "p", "p_holm")])
