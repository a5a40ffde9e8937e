"""Joins, set operations and descriptive counts over the adapters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.draws import digest
from tidemark.functions.scalars import rounded
from tidemark.operators import joins as jn
from tidemark.operators.ordered import row_numbers
from tidemark.plans.registry import Tables, query
from tidemark.plans.sql import digest as dsql
from tidemark.plans.sql import r
from tidemark.sources import release
from tidemark.tables import (CONTRAST, CUBE, SCORE, SUBJECT, contrast_rows, cube, score, subject,
                             with_views)

J1 = """j1 AS (SELECT d.doc_id, d.source, CASE WHEN d.lang = 'en' THEN l.quality + 0.0e0
  WHEN d.lang = 'fr' THEN u.age END AS age,
  coalesce(CASE WHEN d.lang = 'en' THEN CAST(l.toxic AS VARCHAR) WHEN d.lang = 'fr' THEN u.tag END, '') AS subtype
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN (SELECT user_id, CAST(count(*) AS DOUBLE) AS age, max(event_type) AS tag FROM events GROUP BY 1) u
    ON u.user_id = d.doc_id)"""


@query("j01_left_enrich", with_views(J1) + f"SELECT doc_id, {r('age')} AS age, subtype FROM j1")
def j01(spark, sf):
    t = Tables(spark, sf)
    en = t.labels.select(F.col("doc_id"), F.lit("en").alias("lang"), F.col("quality").cast("double").alias("age"),
                         F.col("toxic").cast("string").alias("subtype"))
    fr = t.events.groupBy(F.col("user_id").alias("doc_id")).agg(
        F.count("*").cast("double").alias("age"), F.max("event_type").alias("subtype")).withColumn("lang", F.lit("fr"))
    # The key rule depends on the cohort, so the cohort is part of one joint key.
    meta = en.unionByName(fr)
    return t.documents.join(meta, ["doc_id", "lang"], "left").select(
        "doc_id", rounded(F.col("age")).alias("age"), F.coalesce("subtype", F.lit("")).alias("subtype"))


@query("j02_subject_features", with_views(SUBJECT, CUBE) + f"""
SELECT cohort, label, cond, feature, count(value) AS n, floor(avg(value) * 1e6 + 0.5001e0) / 1e6 AS mean FROM subject JOIN cube USING (subject)
GROUP BY 1, 2, 3, 4""")
def j02(spark, sf):
    t = Tables(spark, sf)
    return cube(t).join(subject(t), "subject").groupBy("cohort", "label", "cond", "feature").agg(
        # Means of decimal values often lie half-way between two digits; a tie goes up, however the sum was ordered.
        F.count("value").alias("n"), (F.floor(F.avg("value") * 1e6 + 0.5001) / 1e6).alias("mean"))


@query("j03_preferred_match", """
WITH ses AS (SELECT DISTINCT user_id AS subject, strftime(ts, '%Y_%m_%d') AS date FROM events WHERE event_type <> 'signup'),
meta AS (SELECT user_id AS subject, strftime(ts, '%Y.%m.%d') AS mdate, event_id AS ord, value FROM events
  WHERE event_type = 'signup')
SELECT subject, date, mdate, matched, (round(value, 6) + 0.0e0) AS value FROM (
  SELECT s.subject, s.date, m.mdate, m.value, replace(s.date, '_', '.') = m.mdate AS matched,
    row_number() OVER (PARTITION BY s.subject, s.date ORDER BY replace(s.date, '_', '.') = m.mdate DESC, ord) AS k
  FROM ses s JOIN meta m ON m.subject = s.subject) WHERE k = 1""")
def j03(spark, sf):
    e = Tables(spark, sf).events
    ses = e.filter("event_type <> 'signup'").select(
        F.col("user_id").alias("subject"), F.date_format("ts", "yyyy_MM_dd").alias("date")).distinct()
    meta = e.filter("event_type = 'signup'").select(
        F.col("user_id").alias("subject"), F.date_format("ts", "yyyy.MM.dd").alias("mdate"),
        F.col("event_id").alias("ord"), "value")
    ses = ses.withColumn("day", release.date_key(F.col("date")))
    out = release.preferred_match(ses, meta, "subject", "day", "mdate", "ord")
    return out.select("subject", "date", "mdate", "matched", rounded(F.col("value")).alias("value"))


GRID_XYZ = [(f"A{i}", round((i % 5) * 0.5 - 1, 3), round((i // 5) * 0.4 - 1, 3), round(((i * 7) % 11) / 11 - 0.5, 3))
            for i in range(30)]


@query("j04_nearest_site", f"""
SELECT target, arg_min(site, (d, site)) AS site, {r('min(d)')} AS distance FROM (
  SELECT vec_id AS target, site, sqrt((embedding[1]::DOUBLE * 4 - x) * (embedding[1]::DOUBLE * 4 - x)
    + (embedding[2]::DOUBLE * 4 - y) * (embedding[2]::DOUBLE * 4 - y)
    + (embedding[3]::DOUBLE * 4 - z) * (embedding[3]::DOUBLE * 4 - z)) AS d
  FROM embeddings CROSS JOIN {dims.values_sql(GRID_XYZ)} g(site, x, y, z)) GROUP BY target""")
def j04(spark, sf):
    e = Tables(spark, sf).embeddings
    at = lambda i: F.element_at("embedding", i).cast("double") * 4
    targets = e.select(F.col("vec_id").alias("target"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))
    grid = dims.table(spark, GRID_XYZ, "site, x, y, z")
    out = jn.nearest_site(targets, grid, ["x", "y", "z"])
    return out.select("target", "site", rounded(F.col("distance")).alias("distance"))


@query("j05_caliper_nearest", with_views(SUBJECT, CONTRAST) + f"""
, ca AS (SELECT contrast, cohort, subject, age FROM contr WHERE y = 1),
 lo AS (SELECT ca.*, c.age AS lo FROM ca ASOF LEFT JOIN (SELECT DISTINCT contrast, cohort, age FROM contr WHERE y = 0) c
   ON c.contrast = ca.contrast AND c.cohort = ca.cohort AND ca.age >= c.age),
 hi AS (SELECT lo.*, c.age AS hi FROM lo ASOF LEFT JOIN (SELECT DISTINCT contrast, cohort, age FROM contr WHERE y = 0) c
   ON c.contrast = lo.contrast AND c.cohort = lo.cohort AND lo.age <= c.age),
 nb AS (SELECT *, CASE WHEN age - lo <= 0.3e0 AND (hi IS NULL OR age - lo <= hi - age) THEN lo
   WHEN hi - age <= 0.3e0 THEN hi END AS near FROM hi)
SELECT contrast, subject, {r('near')} AS nearest, {r('abs(age - near)')} AS distance FROM nb""")
def j05(spark, sf):
    t = Tables(spark, sf)
    rows = contrast_rows(t).withColumn("ref", (F.col("y") == 0).cast("int"))
    out = jn.nearest_value(rows, ["contrast", "cohort"], "age", "ref", 0.3, t.hot("customer"))
    return out.select("contrast", "subject", rounded(F.col("nearest")).alias("nearest"),
                      rounded(F.col("distance")).alias("distance"))


@query("j06_pinned_windows", """
WITH off AS (SELECT DISTINCT user_id AS rec, CAST(floor(value) AS BIGINT) * 16 AS start FROM events),
tot AS (SELECT rec, max(n) AS n FROM (SELECT l_suppkey AS rec, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1),
win AS (SELECT rec, unnest(range(0, n // 16 + 1)) * 16 AS start FROM tot)
SELECT w.rec, w.start FROM win w JOIN off o ON o.rec = w.rec AND o.start = w.start JOIN tot ON tot.rec = w.rec
WHERE o.start + 16 <= tot.n""")
def j06(spark, sf):
    t = Tables(spark, sf)
    off = t.events.select(F.col("user_id").alias("rec"), (F.floor("value") * 16).alias("start")).distinct()
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("rec"), "l_linenumber").agg(F.count("*").alias("n"))
    tot = per.groupBy("rec").agg(F.max("n").alias("n_samples"))
    win = tot.select("rec", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_samples") / 16))).alias("w")
                     ).select("rec", (F.col("w") * 16).alias("start"))
    return jn.pinned(win, off, "rec", "start", 16, tot)


@query("j07_complete_cases", with_views(CUBE) + """
, arm AS (SELECT DISTINCT feature, subject, cond FROM cube WHERE value IS NOT NULL),
full_ AS (SELECT feature, subject FROM arm GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT cond) FROM arm))
SELECT feature, cond, count(f.subject) AS n_analysed, count(*) - count(f.subject) AS n_dropped FROM arm LEFT JOIN full_ f USING (feature, subject) GROUP BY 1, 2""")
def j07(spark, sf):
    c = cube(Tables(spark, sf)).filter("value IS NOT NULL").select("feature", "subject", "cond")
    kept = jn.complete_cases(c, ["feature", "subject"], "cond", c).groupBy("feature", "cond").agg(F.count("*").alias("n_analysed"))
    return c.groupBy("feature", "cond").agg(F.count("*").alias("n")).join(kept, ["feature", "cond"], "left").select(
        "feature", "cond", F.coalesce("n_analysed", F.lit(0)).alias("n_analysed"),
        (F.col("n") - F.coalesce("n_analysed", F.lit(0))).alias("n_dropped"))


@query("j08_shared_controls", with_views(SUBJECT, CONTRAST) + f"""
SELECT a.cohort, count(*) AS n_shared, {r('avg(a.age)')} AS mean_age FROM contr a JOIN contr b ON a.subject = b.subject
WHERE a.contrast = 'dementia' AND b.contrast = 'mci' AND a.y = 0 AND b.y = 0 GROUP BY 1""")
def j08(spark, sf):
    c = contrast_rows(Tables(spark, sf)).filter("y = 0")
    shared = c.filter("contrast = 'dementia'").join(
        c.filter("contrast = 'mci'").select("subject"), "subject", "left_semi")
    return shared.groupBy("cohort").agg(F.count("*").alias("n_shared"), rounded(F.avg("age")).alias("mean_age"))


@query("j09_missing_metadata", """
SELECT 'no_label' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'no_file', user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT doc_id FROM labels)""")
def j09(spark, sf):
    t = Tables(spark, sf)
    docs = t.documents.join(t.labels, "doc_id", "left_anti").select(F.lit("no_label").alias("side"), F.col("doc_id").alias("id"))
    users = t.events.select(F.col("user_id").alias("doc_id")).distinct().join(t.labels, "doc_id", "left_anti")
    return docs.unionByName(users.select(F.lit("no_file").alias("side"), F.col("doc_id").alias("id")))


@query("j13_cube_parity", with_views(CUBE) + f"""
, b AS (SELECT cond, subject, feature, CASE WHEN feature = 'f_mean' THEN value * 2
    WHEN feature = 'f_sd' THEN coalesce(value, 0) ELSE value END AS value FROM cube WHERE NOT (feature = 'f_n' AND value > 3))
SELECT coalesce(a.feature, b.feature) AS feature, count(*) AS n, count(*) FILTER (b.subject IS NULL) AS only_a,
  count(*) FILTER (a.subject IS NULL) AS only_b, {r('max(abs(a.value - b.value))')} AS max_abs_diff,
  bool_and((a.value IS NULL) = (b.value IS NULL)) AS same_nulls
FROM cube a FULL JOIN b ON a.cond = b.cond AND a.subject = b.subject AND a.feature = b.feature GROUP BY 1""")
def j13(spark, sf):
    a = cube(Tables(spark, sf))
    v = F.col("value")
    b = a.filter("NOT (feature = 'f_n' AND value > 3)").withColumn(
        "value", F.when(F.col("feature") == "f_mean", v * 2).when(F.col("feature") == "f_sd", F.coalesce(v, F.lit(0.0))).otherwise(v))
    out = jn.parity(a, b, ["cond", "subject", "feature"], "value", ["feature"])
    return out.withColumn("max_abs_diff", rounded(F.col("max_abs_diff")))


@query("j14_recorded_values", """
WITH rec AS (SELECT o_custkey AS name, CAST(count(*) AS VARCHAR) AS stated FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
cur AS (SELECT o_custkey AS name, CAST(count(*) AS VARCHAR) AS current FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN current IS NULL THEN 'vanished' WHEN stated IS NULL THEN 'new'
  WHEN stated = current THEN 'match' ELSE 'drifted' END AS status FROM rec FULL JOIN cur ON rec.name = cur.name) GROUP BY 1""")
def j14(spark, sf):
    o = Tables(spark, sf).orders
    count = lambda d: d.groupBy(F.col("o_custkey").alias("name")).agg(F.count("*").cast("string").alias("value"))
    v = jn.verified(count(o.filter("o_orderstatus <> 'P'")), count(o.filter("o_orderpriority <> '5-LOW'")))
    return v.groupBy("status").agg(F.count("*").alias("n"))


ARM_PAIRS = [("1-URGENT", "2-HIGH"), ("1-URGENT", "5-LOW"), ("2-HIGH", "3-MEDIUM"), ("4-NOT SPECIFIED", "5-LOW")]


@query("j15_score_pairs", with_views(CUBE) + f"""
SELECT p.a, p.b, x.feature, count(*) AS n_pairs FROM {dims.values_sql(ARM_PAIRS)} p(a, b) JOIN cube x ON x.cond = p.a
  JOIN cube y ON y.cond = p.b AND y.feature = x.feature AND y.subject = x.subject WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2, 3""")
def j15(spark, sf):
    c = cube(Tables(spark, sf)).filter("value IS NOT NULL")
    return jn.pair_counts(c, "subject", "cond", dims.table(spark, ARM_PAIRS, "a, b"), ["feature"])


@query("t01_union_cohorts", """
SELECT 'customer' AS cohort, c_custkey AS id, c_mktsegment AS label, NULL AS site, (round(c_acctbal, 6) + 0.0e0) AS bal FROM customer
UNION ALL SELECT 'supplier', s_suppkey, NULL, s_name, (round(s_acctbal, 6) + 0.0e0) FROM supplier""")
def t01(spark, sf):
    t = Tables(spark, sf)
    a = t.customer.select(F.lit("customer").alias("cohort"), F.col("c_custkey").alias("id"),
                          F.col("c_mktsegment").alias("label"), rounded(F.col("c_acctbal")).alias("bal"))
    b = t.supplier.select(F.lit("supplier").alias("cohort"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("site"),
                          rounded(F.col("s_acctbal")).alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


def _held(t: Tables, status: str, pruned: bool):
    d = t.orders.filter(F.col("o_orderstatus") == status)
    if pruned:
        d = d.filter("o_totalprice > 100000")
    return d.select("o_custkey")


@query("t02_repeat_visits", """
SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)
UNION SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000)""")
def t02(spark, sf):
    t = Tables(spark, sf)
    parts = [_held(t, s, False).subtract(_held(t, s, True)) for s in ("F", "O")]
    return parts[0].union(parts[1]).distinct()


@query("t03_held_out_overlap", """
SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000)""")
def t03(spark, sf):
    t = Tables(spark, sf)
    return _held(t, "F", True).intersect(_held(t, "O", True)).agg(F.count("*").alias("n"))


@query("t04_symmetric_accounting", """
SELECT count(*) FILTER (d IS NOT NULL AND u IS NULL) AS only_documents, count(*) FILTER (d IS NULL AND u IS NOT NULL) AS only_users,
  count(*) FILTER (d IS NOT NULL AND u IS NOT NULL) AS both FROM (SELECT doc_id AS d FROM documents)
  FULL JOIN (SELECT DISTINCT user_id AS u FROM events) ON d = u""".replace("AS both", 'AS "both"'))
def t04(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select(F.col("doc_id").alias("id")).distinct().withColumn("d", F.lit(1))
    u = t.events.select(F.col("user_id").alias("id")).distinct().withColumn("u", F.lit(1))
    j = d.join(u, "id", "full_outer")
    return j.agg(F.count_if(F.col("u").isNull()).alias("only_documents"), F.count_if(F.col("d").isNull()).alias("only_users"),
                 F.count_if(F.col("d").isNotNull() & F.col("u").isNotNull()).alias("both"))


@query("t05_ordered_dedup", """
SELECT user_id, event_id, row_number() OVER (ORDER BY event_id) AS pos FROM (
  SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1)""")
def t05(spark, sf):
    t = Tables(spark, sf)
    first = t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return row_numbers(first, [], ["event_id"], "pos", t.hot("events"))


@query("a01_cohort_counts", with_views(SUBJECT) + f"""
SELECT coalesce(cohort, 'all') AS cohort, coalesce(label, 'all') AS label, count(*) AS n, count(age) AS n_age,
  {r('avg(age)')} AS age_mean, {r('stddev_samp(age)')} AS age_sd FROM subject GROUP BY ROLLUP (cohort, label)""")
def a01(spark, sf):
    return subject(Tables(spark, sf)).rollup("cohort", "label").agg(
        F.count("*").alias("n"), F.count("age").alias("n_age"), rounded(F.avg("age")).alias("age_mean"),
        rounded(F.stddev_samp("age")).alias("age_sd")).select(
        F.coalesce("cohort", F.lit("all")).alias("cohort"), F.coalesce("label", F.lit("all")).alias("label"),
        "n", "n_age", "age_mean", "age_sd")


@query("a01_tag_subsets", """
SELECT tag, count(*) AS n, (round(avg(n_chars), 6) + 0.0e0) AS mean_chars FROM (
  SELECT unnest(string_split(lang || ';' || source || ';all', ';')) AS tag, n_chars FROM documents) GROUP BY tag""")
def a01_tags(spark, sf):
    d = Tables(spark, sf).documents.withColumn("subtype", F.concat_ws(";", "lang", "source", F.lit("all")))
    return d.select(F.explode(F.split("subtype", ";")).alias("tag"), "n_chars").groupBy("tag").agg(
        F.count("*").alias("n"), rounded(F.avg("n_chars")).alias("mean_chars"))


@query("a02_covariate_gap", with_views(SUBJECT, CONTRAST) + f"""
SELECT contrast, cohort, {r('avg(age) FILTER (y = 1)')} AS age_case, {r('avg(age) FILTER (y = 0)')} AS age_control,
  {r('avg(age) FILTER (y = 1) - avg(age) FILTER (y = 0)')} AS age_gap FROM contr GROUP BY 1, 2""")
def a02(spark, sf):
    case, ctrl = F.avg(F.when(F.col("y") == 1, F.col("age"))), F.avg(F.when(F.col("y") == 0, F.col("age")))
    return contrast_rows(Tables(spark, sf)).groupBy("contrast", "cohort").agg(
        rounded(case).alias("age_case"), rounded(ctrl).alias("age_control"), rounded(case - ctrl).alias("age_gap"))


@query("a25_weighted_mean", with_views(SUBJECT) + f"""
SELECT cohort, {r('sum(m * n) / sum(n)')} AS age_impaired FROM (SELECT cohort, label, avg(age) AS m, count(age) AS n
  FROM subject WHERE label <> 'CN' GROUP BY 1, 2) GROUP BY cohort""")
def a25(spark, sf):
    g = subject(Tables(spark, sf)).filter("label <> 'CN'").groupBy("cohort", "label").agg(
        F.avg("age").alias("m"), F.count("age").alias("n"))
    return g.groupBy("cohort").agg(rounded(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("age_impaired"))


@query("r11_limit_per_group", f"""
SELECT source, doc_id, k FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source
  ORDER BY {dsql("'r11'", 'doc_id')}) AS k FROM documents) WHERE k <= 10""")
def r11(spark, sf):
    from pyspark.sql import Window as W
    d = Tables(spark, sf).documents.select("source", "doc_id", digest(F.lit("r11"), F.col("doc_id")).alias("h"))
    # A row_number limit is applied per partition before the shuffle, so a hot group sends 10 rows a task.
    k = F.row_number().over(W.partitionBy("source").orderBy("h"))
    return d.withColumn("k", k).filter("k <= 10").select("source", "doc_id", "k")


@query("r12_sorted_output", with_views(SUBJECT) + "SELECT cohort, subject, label FROM subject ORDER BY cohort, subject")
def r12(spark, sf):
    return subject(Tables(spark, sf)).select("cohort", "subject", "label").orderBy("cohort", "subject")
