"""Label semantics, projections and filters over the adapters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import clip, rounded
from tidemark.operators import labels as lb
from tidemark.plans.registry import Tables, query
from tidemark.plans.sql import r
from tidemark.sources.sinks import with_flags
from tidemark.tables import (CONTRAST, CUBE, SCORE, SUBJECT, contrast_rows, cube, score, subject,
                             with_views)

RAW_LABEL = {"FURNITURE": "Healthy", "MACHINERY": "Dementia", "BUILDING": "MCI",
             "AUTOMOBILE": "F", "HOUSEHOLD": "TGA"}
RAW = f"""raw AS (SELECT c_custkey AS subject, g AS "group", c_acctbal / 100 AS age, c_nationkey FROM customer
  JOIN {dims.values_sql(list(RAW_LABEL.items()))} v(seg, g) ON seg = c_mktsegment)"""
LABEL_SQL = f"""lab AS (SELECT raw.*, m.label FROM raw JOIN {dims.values_sql(list(dims.LABELS.items()))}
  m(g, label) ON m.g = raw."group")"""

def raw_labels(t: Tables):
    from tidemark.tables import case_map
    return t.customer.select(F.col("c_custkey").alias("subject"),
                             case_map(F.col("c_mktsegment"), RAW_LABEL).alias("group"),
                             (F.col("c_acctbal") / 100).alias("age"), "c_nationkey")


def doc_tags(t: Tables):
    """Tags of a document from its counts: several may apply."""
    n, d = F.col("n_chars"), F.col("doc_id")
    words = F.size(F.split("text", " "))
    tags = F.array_compact(F.array(
        F.when(n < 400, "ftd"), F.when((words > 150) & (words < 400), "mci_ad"),
        F.when((n > 300) & (n < 1500), "ad"), F.when(words > 500, "vd"),
        F.when(F.col("lang") == "en", "cb_normal"), F.when(F.col("lang") == "fr", "tga"),
        F.when(F.col("lang") == "es", "mci")))
    return t.documents.select(d.alias("subject"), "source", tags.alias("tags"))


DTAGS = """dt AS (SELECT doc_id AS subject, source, list_filter([
  CASE WHEN n_chars < 400 THEN 'ftd' END, CASE WHEN w > 150 AND w < 400 THEN 'mci_ad' END,
  CASE WHEN n_chars > 300 AND n_chars < 1500 THEN 'ad' END, CASE WHEN w > 500 THEN 'vd' END,
  CASE WHEN lang = 'en' THEN 'cb_normal' END, CASE WHEN lang = 'fr' THEN 'tga' END,
  CASE WHEN lang = 'es' THEN 'mci' END], lambda x: x IS NOT NULL) AS tags
  FROM (SELECT *, len(string_split(text, ' ')) AS w FROM documents))"""
_FTD = "list_has_any(tags, ['ftd', 'bvftd', 'non_fluent_aphasia', 'semantic_aphasia'])"
_VD = "list_has_any(tags, ['vd', 'sivd', 'ad_vd_mixed'])"
_MCI = "len(list_filter(tags, lambda x: starts_with(x, 'mci'))) > 0"
CLS = f"""cls AS (SELECT subject, source, tags, CASE
  WHEN {_FTD} THEN CASE WHEN {_VD} THEN 'EXCL' ELSE 'FTD' END
  WHEN list_has_any(tags, ['ad', 'load', 'eoad']) AND NOT {_MCI} THEN CASE WHEN {_VD} THEN 'EXCL' ELSE 'AD' END
  WHEN {_MCI} THEN 'MCI' WHEN list_has_any(tags, ['normal', 'cb_normal', 'hc_normal']) THEN 'CN'
  ELSE 'EXCL' END AS class FROM dt)"""


@query("p01_label_map", with_views(RAW, LABEL_SQL) + 'SELECT subject, "group", label FROM lab')
def p01(spark, sf):
    return lb.normalise_labels(raw_labels(Tables(spark, sf)), "group").select("subject", "group", "label")


@query("p02_derived_flags", with_views(RAW, LABEL_SQL) + """
SELECT subject, label, CAST(label IN ('AD', 'FTD', 'MCI', 'VAD') AS INT) AS impaired,
  CAST(label IN ('CN', 'AD', 'FTD', 'MCI', 'VAD') AS INT) AS in_screening FROM lab""")
def p02(spark, sf):
    d = lb.normalise_labels(raw_labels(Tables(spark, sf)), "group")
    return with_flags(d).select("subject", "label", "impaired", "in_screening")


@query("p03_tag_taxonomy", with_views(DTAGS, CLS) + "SELECT subject, class FROM cls")
def p03(spark, sf):
    return doc_tags(Tables(spark, sf)).select("subject", lb.assign_class(F.col("tags")).alias("class"))


@query("p04_recovered_classes", with_views(DTAGS, CLS) + f"""
SELECT subject, CASE WHEN class = 'EXCL' THEN CASE WHEN {_VD} THEN 'VAD'
  WHEN list_contains(tags, 'tga') THEN 'TGA' ELSE class END ELSE class END AS class FROM cls""")
def p04(spark, sf):
    d = doc_tags(Tables(spark, sf))
    cls = lb.assign_class(F.col("tags"))
    return d.select("subject", lb.recover_class(F.col("tags"), cls).alias("class"))


@query("p05_whole_tag", with_views(DTAGS) + """
SELECT source, count(*) FILTER (list_contains(tags, 'ad')) AS n_ad, count(*) FILTER (list_contains(tags, 'mci')) AS n_mci,
  count(*) FILTER (list_contains(tags, 'mci_ad')) AS n_mci_ad FROM dt GROUP BY source""")
def p05(spark, sf):
    d = doc_tags(Tables(spark, sf)).withColumn("subtype", F.concat_ws(";", "tags"))
    return d.groupBy("source").agg(*[F.count_if(lb.has_tag(F.col("subtype"), tag)).alias(f"n_{tag}")
                                     for tag in ("ad", "mci", "mci_ad")])


@query("p06_contrasts", with_views(SUBJECT, CONTRAST) + f"""
SELECT contrast, subject, cohort, y, {r('age')} AS age FROM contr""")
def p06(spark, sf):
    return contrast_rows(Tables(spark, sf)).select("contrast", "subject", "cohort", "y", rounded(F.col("age")).alias("age"))


@query("p07_scale_contrasts", """
SELECT contrast, user_id, CAST(y AS INT) AS y FROM (
  SELECT user_id, 'severe_vs_normal' AS contrast, CASE WHEN m < 19 THEN 1 WHEN m >= 26 THEN 0 END AS y FROM (
     SELECT user_id, max(value) AS m FROM events GROUP BY 1)
  UNION ALL SELECT user_id, 'severe_vs_rest', CASE WHEN m < 19 THEN 1 ELSE 0 END FROM (
     SELECT user_id, max(value) AS m FROM events GROUP BY 1)) WHERE y IS NOT NULL""")
def p07(spark, sf):
    m = Tables(spark, sf).events.groupBy("user_id").agg(F.max("value").alias("moca"))
    x = F.col("moca")
    arms = F.create_map(F.lit("severe_vs_normal"), F.when(x < 19, 1).when(x >= 26, 0),
                        F.lit("severe_vs_rest"), F.when(x < 19, 1).otherwise(0))
    return (m.select("user_id", F.explode(arms).alias("contrast", "y"))
            .filter("y IS NOT NULL").select("contrast", "user_id", "y"))


@query("p08_exclusion_reason", with_views(SUBJECT) + """
SELECT cohort, excluded, count(*) AS n FROM (SELECT cohort, CASE WHEN label = 'CN' AND age < 55
  THEN 'control under 55' ELSE '' END AS excluded FROM subject) GROUP BY 1, 2""")
def p08(spark, sf):
    s = lb.exclusion(subject(Tables(spark, sf)),
                     F.coalesce((F.col("label") == "CN") & (F.col("age") < 55), F.lit(False)), "control under 55")
    return s.groupBy("cohort", "excluded").agg(F.count("*").alias("n"))


P9_RAW = ["T7-AVG", "P8", "O1-REF", "O2-AVG", "FP1x", "CZ-AVG", " Pz-REF"]


@query("p09_channel_names", f"""
SELECT l_suppkey AS rec, raw, site, ord, count(*) AS n FROM lineitem JOIN {dims.values_sql(
    [(i + 1, raw, site, dims.CANON.index(site) + 1 if site in dims.CANON else None) for i, (raw, site) in enumerate(
     zip(P9_RAW, ['T3', 'T6', 'O1', 'O2', 'FP1x', 'Cz', 'Pz']))])} v(k, raw, site, ord) ON k = l_linenumber
WHERE ord IS NOT NULL GROUP BY 1, 2, 3, 4""")
def p09(spark, sf):
    li = Tables(spark, sf).lineitem
    raw = F.element_at(lb.tag_set(P9_RAW), F.col("l_linenumber"))
    d = li.select(F.col("l_suppkey").alias("rec"), raw.alias("raw"))
    d = d.groupBy("rec", "raw").agg(F.count("*").alias("n"))
    d = d.withColumn("site", lb.canonical_channel(F.col("raw"))).withColumn("ord", lb.site_order(F.col("site")))
    return d.filter(F.col("ord").isNotNull()).select("rec", "raw", "site", F.col("ord").cast("int").alias("ord"), "n")


@query("p09_missing_sites", """
SELECT c_mktsegment AS rec, n_name AS channel FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN nation
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = rec AND c.c_nationkey = n_nationkey AND c_acctbal < -900)""")
def p09_missing(spark, sf):
    t = Tables(spark, sf)
    have = t.customer.filter("c_acctbal < -900").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("rec"), F.col("n_name").alias("channel"))
    everyone = t.customer.select(F.col("c_mktsegment").alias("rec"), F.lit(None).cast("string").alias("channel"))
    return lb.missing_sites(have.unionByName(everyone), "rec", "channel", [f"NATION_{i}" for i in range(25)])


@query("p10_usable_features", with_views(CUBE) + """
SELECT cond, feature FROM cube GROUP BY 1, 2 HAVING count(*) = count(value)""")
def p10(spark, sf):
    return lb.usable_features(cube(Tables(spark, sf)), ["cond", "feature"])


@query("p11_joint_mask", with_views(SUBJECT, CUBE) + """
SELECT feature, count(*) AS n_cohorts FROM (SELECT s.cohort, feature FROM cube c JOIN subject s USING (subject)
  GROUP BY 1, 2 HAVING count(*) = count(value)) WHERE feature IN (SELECT feature FROM cube GROUP BY 1
  HAVING count(*) = count(value)) GROUP BY feature""")
def p11(spark, sf):
    t = Tables(spark, sf)
    d = cube(t).join(subject(t).select("subject", "cohort"), "subject")
    joint = lb.jointly_usable(d, "cohort", ["feature"])
    per = lb.usable_features(d, ["cohort", "feature"])
    return per.join(joint, "feature", "left_semi").groupBy("feature").agg(F.count("*").alias("n_cohorts"))


@query("p12_class_from_id", """
SELECT doc_id, CASE WHEN NOT regexp_matches(sid, 'sub-[0-9]+') THEN '?'
  WHEN substr(sid, 5, 2) = '10' THEN 'CN' WHEN substr(sid, 5, 2) = '20' THEN 'FTD'
  WHEN substr(sid, 5, 2) = '30' THEN 'AD' WHEN substr(sid, 5, 2) = '40' THEN 'PD' ELSE '?' END AS class,
  CASE WHEN lang = 'en' THEN 'rs' WHEN lang = 'de' THEN 'rs-HEP' WHEN lang = 'fr' THEN 'PD' ELSE 'other' END AS paradigm
FROM (SELECT doc_id, lang, CASE WHEN lang = 'es' THEN 'x' ELSE 'sub-' || CAST(doc_id AS VARCHAR) END AS sid FROM documents)""")
def p12(spark, sf):
    t = Tables(spark, sf)
    sid = F.when(F.col("lang") == "es", "x").otherwise(F.concat(F.lit("sub-"), F.col("doc_id")))
    file = (F.when(F.col("lang") == "en", "A_rs_1.set").when(F.col("lang") == "de", "A_rs-HEP.set")
            .when(F.col("lang") == "fr", "PD_reject_rs.set").otherwise("z.set"))
    d = t.documents.select("doc_id", sid.alias("sid"), F.lower(file).alias("f"))
    code = F.substring(F.regexp_extract("sid", r"sub-(\d+)", 1), 1, 2)
    cls = (F.when(code == "10", "CN").when(code == "20", "FTD").when(code == "30", "AD")
           .when(code == "40", "PD").otherwise("?"))
    f = F.col("f")
    par = (F.when(f.contains("pd_reject") | f.contains("_pd_"), "PD").when(f.contains("rs-hep"), "rs-HEP")
           .when(f.contains("_rs_") | f.contains("_rs-") | f.contains("rs_eeg"), "rs")
           .when(f.contains("extero"), "extero").when(f.contains("intero"), "intero").otherwise("other"))
    return d.select("doc_id", cls.alias("class"), par.alias("paradigm"))


def condition_grid(spark):
    """The swept grid: every montage at native digitisation, two montages over rate and depth, two
    over preprocessing."""
    m = dims.montage(spark).select("montage")
    axis_a = m.select("montage", F.lit(dims.NATIVE_RATE).alias("rate"), F.lit(None).cast("int").alias("bits"),
                      F.lit("full").alias("preproc"), F.lit("electrodes").alias("axis"))
    two = m.filter(F.col("montage").isin("b19", "b4"))
    rates = dims.table(spark, [(x,) for x in dims.RATES], "rate")
    bits = dims.table(spark, [(x,) for x in dims.DEPTHS], "bits")
    axis_b = (two.crossJoin(rates).crossJoin(bits)
              .filter(~((F.col("rate") == dims.NATIVE_RATE) & F.col("bits").isNull()))
              .select("montage", "rate", "bits", F.lit("full").alias("preproc"), F.lit("digitisation").alias("axis")))
    pre = dims.table(spark, [(x,) for x in dims.PREPROC_BAND if x != "full"], "preproc")
    axis_c = two.crossJoin(pre).select("montage", F.lit(dims.NATIVE_RATE).alias("rate"),
                                       F.lit(None).cast("int").alias("bits"), "preproc",
                                       F.lit("preprocessing").alias("axis"))
    g = axis_a.unionByName(axis_b).unionByName(axis_c)
    sites = F.broadcast(dims.montage(spark).select("montage", "n_electrodes"))
    g = g.join(sites, "montage").withColumn("description", F.format_string(
        "%s (%d el), %d Hz, %s, %s", "montage", "n_electrodes", "rate",
        F.coalesce(F.concat(F.col("bits").cast("string"), F.lit("-bit")), F.lit("float32")), "preproc")).drop("n_electrodes")
    return g.withColumn("cond", F.concat_ws("|", "montage", F.col("rate").cast("string"),
                                            F.coalesce(F.col("bits").cast("string"), F.lit("f32")), "preproc"))


@query("p13_condition_load", f"""
WITH m AS (SELECT * FROM {dims.values_sql([(k, len(v[0])) for k, v in dims.MONTAGES.items()])} v(montage, el)),
g AS (SELECT montage, el, 256 AS rate, 'f32' AS bits, 'full' AS pre, 'electrodes' AS axis FROM m
  UNION ALL SELECT montage, el, rate, bits, 'full', 'digitisation' FROM m,
    (VALUES (256), (128), (64)) a(rate), (VALUES ('f32'), ('16'), ('12'), ('8')) b(bits)
    WHERE montage IN ('b19', 'b4') AND NOT (rate = 256 AND bits = 'f32')
  UNION ALL SELECT montage, el, 256, 'f32', p, 'preprocessing' FROM m, (VALUES ('emgfree'), ('noica')) c(p)
    WHERE montage IN ('b19', 'b4'))
SELECT montage || '|' || rate || '|' || bits || '|' || pre AS cond, axis, cohort, n, montage || ' (' || el || ' el), ' || rate || ' Hz, '
  || CASE bits WHEN 'f32' THEN 'float32' ELSE bits || '-bit' END || ', ' || pre AS description
FROM g CROSS JOIN (SELECT r_name AS cohort, count(*) AS n FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)""")
def p13(spark, sf):
    n = subject(Tables(spark, sf)).groupBy("cohort").agg(F.count("*").alias("n"))
    return condition_grid(spark).select("cond", "axis", "description").crossJoin(n)


@query("p14_covariate_scaling", with_views(SUBJECT) + f"""
SELECT subject, {r('CASE WHEN age IS NOT NULL THEN least(greatest((age - 40) / 50, 0.0e0), 1.0e0) END')} AS age_unit, {r('(age - 70) / 10')} AS age_decade
FROM subject""")
def p14(spark, sf):
    a = F.col("age")
    return subject(Tables(spark, sf)).select(
        "subject", rounded(F.when(a.isNotNull(), clip((a - 40) / 50, 0, 1))).alias("age_unit"),
        rounded((a - 70) / 10).alias("age_decade"))


@query("p15_banding", """
SELECT band, count(*) AS n FROM (SELECT CASE WHEN value > -1 AND value <= 18.5 THEN 0 WHEN value > 18.5 AND value <= 25.5
  THEN 1 WHEN value > 25.5 AND value <= 31 THEN 2 END AS band FROM events) GROUP BY band""")
def p15(spark, sf):
    e = Tables(spark, sf).events
    return e.groupBy(lb.banded(F.col("value"), dims.SCALE_EDGES).alias("band")).agg(F.count("*").alias("n"))


@query("p16_rank_to_prob", with_views(SCORE) + f"""
SELECT id, {r('CASE WHEN hi > lo THEN (a - lo) / (hi - lo) ELSE 0.5e0 END')} AS p FROM (
  SELECT id, a, min(a) OVER (PARTITION BY source) AS lo, max(a) OVER (PARTITION BY source) AS hi FROM score)""")
def p16(spark, sf):
    return lb.min_max_scaled(score(Tables(spark, sf)), ["source"], "a", "p").select("id", rounded(F.col("p")).alias("p"))


# Counts a release declares for its cohorts, kept apart from the tables; most are wrong here, one cohort does not exist.
DECLARED = [("AFRICA", 300), ("AMERICA", 299), ("ASIA", 301), ("EUROPE", 296), ("ATLANTIS", 7)]


@query("p17_corpus_check", f"""
SELECT coalesce(e.cohort, a.cohort) AS cohort, expected, actual, expected IS NOT DISTINCT FROM actual AS ok
FROM (SELECT cohort, CAST(n AS BIGINT) AS expected FROM {dims.values_sql(DECLARED)} v(cohort, n)) e
FULL OUTER JOIN (SELECT r_name AS cohort, count(*) AS actual FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1) a ON a.cohort = e.cohort""")
def p17(spark, sf):
    actual = subject(Tables(spark, sf)).groupBy("cohort").agg(F.count("*").alias("n"))
    expected = dims.table(spark, DECLARED, "cohort, n").withColumn("n", F.col("n").cast("bigint"))
    return lb.check_counts(actual, expected, "cohort", halt=False)


@query("p17_cohort_gaps", with_views(SUBJECT) + """
SELECT site, count(*) AS n, count(age) AS n_age, count(DISTINCT label) AS n_labels, count(DISTINCT label) = 1 AS single_class,
  count(age) = 0 AS no_covariate FROM subject GROUP BY site""")
def p17_gaps(spark, sf):
    return subject(Tables(spark, sf)).groupBy("site").agg(
        F.count("*").alias("n"), F.count("age").alias("n_age"), F.count_distinct("label").alias("n_labels"),
        (F.count_distinct("label") == 1).alias("single_class"), (F.count("age") == 0).alias("no_covariate"))


ESTIMATOR = [("full", n) for n in ("f_n", "f_total", "f_open", "f_final", "f_mean", "f_sd")] + [
    ("slow3", n) for n in ("f_total", "f_open", "f_final")]


@query("p18_feature_subset", with_views(CUBE) + f"""
SELECT estimator, cond, count(DISTINCT c.feature) AS n_features, count(value) AS n_values FROM cube c
JOIN {dims.values_sql(ESTIMATOR)} e(estimator, feature) ON e.feature = c.feature GROUP BY 1, 2""")
def p18(spark, sf):
    est = dims.table(spark, ESTIMATOR, "estimator, feature")
    return cube(Tables(spark, sf)).join(F.broadcast(est), "feature").groupBy("estimator", "cond").agg(
        F.count_distinct("feature").alias("n_features"), F.count("value").alias("n_values"))
