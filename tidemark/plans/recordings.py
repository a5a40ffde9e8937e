"""Windows, channel algebra, digitisation and quality over the sample adapter."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import rounded
from tidemark.operators import channels as ch
from tidemark.operators import degrade as dg
from tidemark.operators import quality as ql
from tidemark.operators import windows as wn
from tidemark.plans.registry import Tables, query
from tidemark.plans.sql import digest as dsql
from tidemark.plans.sql import h as hsql
from tidemark.plans.sql import band_gain, r
from tidemark.tables import SIGNAL, SITES, WINDOWS, signal, window_vectors, with_views

N, LIMIT, QUOTA = 16, 70000.0, 3
PTP = f"""wchan AS (SELECT rec, CAST(floor(t / {N}) AS BIGINT) AS win, channel, count(*) AS n, max(x) - min(x) AS ptp,
    avg(x) AS mean, stddev_pop(x) AS sd FROM signal GROUP BY 1, 2, 3 HAVING count(*) = {N}),
wptp AS (SELECT rec, win, max(ptp) AS ptp, count(*) AS k FROM wchan GROUP BY 1, 2
  HAVING count(*) = (SELECT count(DISTINCT channel) FROM signal s WHERE s.rec = wchan.rec))"""
ACC = f"""wacc AS (SELECT * FROM (SELECT rec, win, ptp, count(*) OVER (PARTITION BY rec) AS n_windows,
    count(*) FILTER (ptp <= {LIMIT}e0) OVER (PARTITION BY rec) AS n_ok,
    row_number() OVER (PARTITION BY rec ORDER BY ptp, win) AS q FROM wptp)
  WHERE (n_ok > 0 AND ptp <= {LIMIT}e0) OR (n_ok = 0 AND q <= {QUOTA}))"""
SAMPLED = f"""wsam AS (SELECT rec, win FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY {dsql('rec', 'win')}) AS k
  FROM wacc) WHERE k <= {QUOTA})"""


def ptp_of(t: Tables):
    return wn.window_ptp(signal(t), N)


@query("w01_tumbling_windows", with_views(SIGNAL, PTP) + f"""
SELECT rec, win, channel, {r('mean', 7)} AS mean FROM wchan""")
def w01(spark, sf):
    return wn.full_windows(signal(Tables(spark, sf)), N).select("rec", "win", "channel", rounded(F.col("mean"), 7).alias("mean"))


@query("w02_peak_to_peak", with_views(SIGNAL, PTP) + f"SELECT rec, win, {r('ptp', 4)} AS ptp, k AS n_channels FROM wptp")
def w02(spark, sf):
    return ptp_of(Tables(spark, sf)).select("rec", "win", rounded(F.col("ptp"), 4).alias("ptp"), F.col("k").alias("n_channels"))


@query("w03_reject_fallback", with_views(SIGNAL, PTP, ACC) + f"""
SELECT rec, win, n_ok, CASE WHEN n_ok > 0 THEN n_windows - n_ok ELSE n_windows - least(n_windows, {QUOTA}) END AS rejected
FROM wacc""")
def w03(spark, sf):
    return wn.accepted(ptp_of(Tables(spark, sf)), LIMIT, QUOTA).select("rec", "win", "n_ok", "rejected")


@query("w04_quota_sample", with_views(SIGNAL, PTP, ACC, SAMPLED) + "SELECT rec, win FROM wsam")
def w04(spark, sf):
    return wn.sampled(wn.accepted(ptp_of(Tables(spark, sf)), LIMIT, QUOTA), QUOTA).select("rec", "win")


@query("w05_window_zscore", with_views(SIGNAL) + f"""
SELECT rec, channel, t, {r('(x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8)')} AS z FROM signal
WINDOW w AS (PARTITION BY rec, CAST(floor(t / {N}) AS BIGINT), channel)""")
def w05(spark, sf):
    return wn.standardised(signal(Tables(spark, sf)), N).select("rec", "channel", "t", rounded(F.col("z")).alias("z"))


@query("w06_subject_score", with_views(SIGNAL, PTP) + f"""
SELECT rec, {r('avg(sd / 1000)')} AS score, count(*) AS n_windows FROM wchan GROUP BY rec""")
def w06(spark, sf):
    w = wn.full_windows(signal(Tables(spark, sf)), N).withColumn("score", F.col("sd") / 1000)
    return wn.subject_scores(w, "rec", "score").withColumn("score", rounded(F.col("score")))


MCH = "mch AS (SELECT * FROM " + dims.values_sql(
    [(m, s[1], c) for m, s in dims.MONTAGES.items() for c in s[0]]) + " v(montage, ref, channel))"
MPAIR = "mpair AS (SELECT * FROM " + dims.values_sql(
    [(m, a, b) for m, s in dims.MONTAGES.items() for a, b in s[2]]) + " v(montage, a, b))"
MOK = """mok AS (SELECT rec, montage FROM (SELECT DISTINCT rec, channel FROM signal) s JOIN mch USING (channel)
  GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM mch m2 WHERE m2.montage = mch.montage))"""
MCAR = """mcar AS (SELECT montage, rec, t, channel, x - avg(x) OVER (PARTITION BY montage, rec, t) AS x
  FROM signal JOIN mch USING (channel) WHERE ref = 'subset_car')"""
MBI = """mbi AS (SELECT montage, p.rec, p.t, a || '-' || b AS channel, p.x - q.x AS x FROM mpair
  JOIN signal p ON p.channel = a JOIN signal q ON q.channel = b AND q.rec = p.rec AND q.t = p.t)"""
MINH = "minh AS (SELECT montage, rec, t, channel, x FROM signal JOIN mch USING (channel) WHERE ref = 'inherit')"
MALL = """mcnt AS (SELECT montage, rec, t FROM signal JOIN mch USING (channel) GROUP BY 1, 2, 3
  HAVING count(*) = (SELECT count(*) FROM mch m2 WHERE m2.montage = mch.montage)),
mall AS (SELECT * FROM (SELECT * FROM mcar UNION ALL SELECT * FROM mbi UNION ALL SELECT * FROM minh) JOIN mcnt USING (montage, rec, t))"""
SUMMARY = "SELECT {k}, count(*) AS n, " + r("max(x)") + " AS top, " + r("stddev_pop(x)") + " AS sd FROM {src} GROUP BY {k}"


def summary(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), rounded(F.max("x")).alias("top"),
                                 rounded(F.stddev_pop("x")).alias("sd"))


@query("m01_channel_subset", with_views(SIGNAL, MCH, MINH) + SUMMARY.format(k="montage, rec, channel", src="minh"))
def m01(spark, sf):
    d = ch.subset(signal(Tables(spark, sf)), dims.montage_channel(spark).filter("ref = 'inherit'"))
    return summary(d, "montage", "rec", "channel")


@query("m02_subset_reference", with_views(SIGNAL, MCH, MCAR) + SUMMARY.format(k="montage, rec, channel", src="mcar"))
def m02(spark, sf):
    return summary(ch.subset_referenced(signal(Tables(spark, sf)), dims.montage_channel(spark)), "montage", "rec", "channel")


@query("m03_bipolar", with_views(SIGNAL, MPAIR, MBI) + f"SELECT montage, rec, t, channel, {r('x', 4)} AS x FROM mbi")
def m03(spark, sf):
    d = ch.bipolar(signal(Tables(spark, sf)), dims.montage_pair(spark))
    return d.select("montage", "rec", "t", "channel", rounded(F.col("x"), 4).alias("x"))


@query("m04_montage_registry", with_views(SIGNAL, MCH, MOK) + f"""
SELECT m.montage, m.ref, m.family, m.n_electrodes, m.n_signals, count(mok.rec) AS n_recordings FROM {dims.values_sql(
    dims.montage_rows())} m(montage, ref, family, n_electrodes, n_signals) LEFT JOIN mok ON mok.montage = m.montage
GROUP BY 1, 2, 3, 4, 5""")
def m04(spark, sf):
    ok = ch.measurable(signal(Tables(spark, sf)), dims.montage_channel(spark)).groupBy("montage").agg(
        F.count("*").alias("k"))
    return dims.montage(spark).join(ok, "montage", "left").select(
        "montage", "ref", "family", "n_electrodes", "n_signals", F.coalesce("k", F.lit(0)).alias("n_recordings"))


@query("m05_all_montages", with_views(SIGNAL, MCH, MPAIR, MCAR, MBI, MINH, MALL)
       + SUMMARY.format(k="montage, rec, channel", src="mall"))
def m05(spark, sf):
    return summary(ch.all_montages(signal(Tables(spark, sf))), "montage", "rec", "channel")


NB = {c: [n for n in ns if n in SITES] for c, ns in dims.NEIGHBOURS.items() if c in SITES}
NB = {c: ns for c, ns in NB.items() if ns}
EDGE = f"""nbl AS (SELECT * FROM {dims.values_sql([(c, i, n, len(ns)) for c, ns in NB.items() for i, n in enumerate(ns)])}
    v(channel, slot, neighbour, k)),
edge AS (SELECT rec, channel, neighbour FROM (SELECT DISTINCT rec, channel FROM signal) s JOIN nbl USING (channel)
  WHERE slot = {hsql('rec', "'displace'", 'channel')} % k)"""


@query("j12_neighbour_edge", with_views(SIGNAL, EDGE) + "SELECT rec, channel, neighbour FROM edge")
def j12(spark, sf):
    return ch.chosen_neighbour(signal(Tables(spark, sf)), ch.reachable_neighbours(spark, SITES), "displace")


@query("m06_displaced_channel", with_views(SIGNAL, EDGE) + f"""
SELECT s.rec, s.channel, s.t, {r('0.5e0 * s.x + 0.5e0 * n.x', 4)} AS x FROM signal s JOIN edge USING (rec, channel)
JOIN signal n ON n.rec = s.rec AND n.t = s.t AND n.channel = neighbour""")
def m06(spark, sf):
    s = signal(Tables(spark, sf))
    e = ch.chosen_neighbour(s, ch.reachable_neighbours(spark, SITES), "displace")
    return ch.displaced(s, e, 0.5).select("rec", "channel", "t", rounded(F.col("x"), 4).alias("x"))


LOST = f"""lost AS (SELECT DISTINCT rec, [{', '.join(f"'{s}'" for s in dims.B4)}][{hsql('rec', "'contact'")} % 4 + 1] AS lost FROM signal)"""


@query("m07_dropped_lead", with_views(SIGNAL, LOST) + f"""
SELECT rec, t, channel, {r('x - avg(x) OVER (PARTITION BY rec, t)', 4)} AS x FROM signal JOIN lost USING (rec)
WHERE channel IN ('T5', 'T6', 'O1', 'O2') AND channel <> lost""")
def m07(spark, sf):
    return ch.dropped_lead(signal(Tables(spark, sf)), dims.B4, "contact").select(
        "rec", "t", "channel", rounded(F.col("x"), 4).alias("x"))


@query("m08_short_recording", with_views(SIGNAL, PTP, ACC) + f"""
SELECT cond, rec, win FROM (SELECT rec, win, row_number() OVER (PARTITION BY rec ORDER BY {dsql('rec', 'win')}) AS k FROM wacc)
JOIN {dims.values_sql(list(dims.SHORT_QUOTAS.items()))} q(cond, quota) ON k <= quota""")
def m08(spark, sf):
    acc = wn.accepted(ptp_of(Tables(spark, sf)), LIMIT, QUOTA)
    return wn.sampled_by_condition(acc, wn.quota_grid(spark)).select("cond", "rec", "win")


FS = 200000.0


@query("d01_quantise", with_views(SIGNAL) + f"""
SELECT rec, channel, t, bits, {r(f"CASE WHEN bits IS NULL THEN x ELSE greatest(least(round_even(x / ({FS}e0 / pow(2.0e0, bits)), 0) * ({FS}e0 / pow(2.0e0, bits)), {FS / 2}e0), -{FS / 2}e0) END", 4)} AS x
FROM (SELECT rec, channel, t, x - 40000 AS x FROM signal), (VALUES (NULL), (16), (12), (8)) b(bits)""")
def d01(spark, sf):
    bits = dims.table(spark, [(b,) for b in dims.DEPTHS], "bits")
    s = signal(Tables(spark, sf)).crossJoin(F.broadcast(bits))
    return s.select("rec", "channel", "t", "bits",
                    rounded(dg.quantised(F.col("x") - 40000, F.col("bits"), FS), 4).alias("x"))


def taps_sql(k: int) -> str:
    half = 10 * k
    return dims.values_sql([(i - half, float(v)) for i, v in enumerate(dg.decimation_taps(k))]) + " taps(j, h)"


@query("d02_decimate", with_views(WINDOWS) + f"""
, s AS (SELECT rec, win, channel, unnest(x) AS x, unnest(range(0, 64)) AS t FROM wvec)
SELECT rec, win, channel, m, {r('sum(x * h)')} AS x FROM s JOIN {taps_sql(2)} ON (t + j) % 2 = 0
  AND t + j >= 0 AND t + j < 64 CROSS JOIN LATERAL (SELECT (t + j) // 2 AS m) GROUP BY rec, win, channel, m""")
def d02(spark, sf):
    d = dg.decimated(window_vectors(Tables(spark, sf)), 64, 32)
    return d.select("rec", "win", "channel", F.posexplode("x").alias("m", "x")).select(
        "rec", "win", "channel", F.col("m").cast("bigint").alias("m"), rounded(F.col("x")).alias("x"))


@query("d03_band_restrict", with_views(WINDOWS) + f"""
, s AS (SELECT rec, win, channel, unnest(x) AS x, unnest(range(0, 64)) AS t FROM wvec),
 c AS (SELECT rec, win, channel, k, sum(x * cos(2 * pi() * k * t / 64)) AS re, sum(x * sin(2 * pi() * k * t / 64)) AS im
   FROM s, (SELECT unnest(range(1, 32)) AS k) GROUP BY 1, 2, 3, 4)
SELECT rec, win, channel, CAST(t AS INT) AS t, {r('sum(' + band_gain('k', 64, 2, 20) + ' * (re * cos(2 * pi() * k * t / 64) + im * sin(2 * pi() * k * t / 64))) / 32')} AS x
FROM c, (SELECT unnest(range(0, 64)) AS t) GROUP BY 1, 2, 3, 4""")
def d03(spark, sf):
    d = dg.restricted(window_vectors(Tables(spark, sf)), 64, 2.0, 20.0)
    return d.select("rec", "win", "channel", F.posexplode("x").alias("t", "x")).withColumn("x", rounded(F.col("x")))


@query("d04_budget_grid", with_views(WINDOWS) + f"""
, s AS (SELECT rec, win, channel, unnest(x) AS x, unnest(range(0, 64)) AS t FROM wvec),
low AS (SELECT rec, win, channel, m, 32 AS rate, sum(x * h) AS x FROM s JOIN {taps_sql(2)} ON (t + j) % 2 = 0
  AND t + j >= 0 AND t + j < 64 CROSS JOIN LATERAL (SELECT (t + j) // 2 AS m) GROUP BY rec, win, channel, m),
a AS (SELECT rec, channel, rate, x FROM low UNION ALL SELECT rec, channel, 64, x FROM s)
SELECT rec, channel, rate, bits, count(*) AS n, {r("sum(abs(CASE WHEN bits IS NULL THEN x ELSE greatest(least(round_even(x / (4.0e0 / pow(2.0e0, bits)), 0) * (4.0e0 / pow(2.0e0, bits)), 2.0e0), -2.0e0) END))", 4)} AS total
FROM a, (VALUES (NULL), (16), (12), (8)) b(bits) GROUP BY 1, 2, 3, 4""")
def d04(spark, sf):
    bits = dims.table(spark, [(b,) for b in dims.DEPTHS], "bits")
    d = dg.with_budget(window_vectors(Tables(spark, sf)), 64, [64, 32], bits, 4.0)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v))
    return d.groupBy("rec", "channel", "rate", "bits").agg(
        F.sum(F.size("x")).alias("n"), rounded(F.sum(total), 4).alias("total"))


@query("q01_unit_detection", with_views(SIGNAL) + f"""
, lv AS (SELECT rec, channel, quantile_cont(abs(CASE WHEN channel = 'Cz' THEN 0 ELSE x END), 0.5) AS m FROM signal GROUP BY 1, 2)
SELECT rec, {r('coalesce(quantile_cont(m, 0.5) FILTER (m > 0), 0)', 4)} AS median_abs, count(*) FILTER (m > 0) AS n_live,
  CASE WHEN quantile_cont(m, 0.5) FILTER (m > 0) > 38000 THEN 1e-6 ELSE 1.0e0 END AS unit_factor,
  count(*) FILTER (m > 0) < 0.5e0 * count(*) AS low_density FROM lv GROUP BY rec""")
def q01(spark, sf):
    t = Tables(spark, sf)
    s = signal(t).withColumn("x", F.when(F.col("channel") == "Cz", 0.0).otherwise(F.col("x")))
    return ql.units(s, 38000.0, t.hot("lineitem")).select(
        "rec", rounded(F.col("median_abs"), 4).alias("median_abs"), "n_live", "unit_factor", "low_density")


@query("q02_flat_channels", with_views(SIGNAL) + """
SELECT rec, count(*) AS n_channels, count(*) FILTER (sd < 1e-15) AS n_flat FROM (SELECT rec, channel,
  stddev_pop(CASE WHEN channel = 'Cz' THEN 0 ELSE x END) AS sd FROM signal GROUP BY 1, 2) GROUP BY rec""")
def q02(spark, sf):
    s = signal(Tables(spark, sf)).withColumn("x", F.when(F.col("channel") == "Cz", 0.0).otherwise(F.col("x")))
    return ql.flat_channels(s)


@query("q04_average_reference", with_views(SIGNAL) + f"""
SELECT rec, channel, t, {r('x - avg(x) OVER (PARTITION BY rec, t)', 4)} AS x FROM signal""")
def q04(spark, sf):
    return ch.average_referenced(signal(Tables(spark, sf))).select("rec", "channel", "t", rounded(F.col("x"), 4).alias("x"))


@query("q05_amplitude_guard", with_views(SIGNAL) + f"""
, b AS (SELECT rec, quantile_cont(abs(x), 0.5) AS before FROM signal GROUP BY 1),
a AS (SELECT rec, quantile_cont(abs(x), 0.5) AS after FROM (SELECT rec, x - avg(x) OVER (PARTITION BY rec, t) AS x FROM signal) GROUP BY 1)
SELECT rec, {r('after / before')} AS ratio, NOT (after / before < 0.5 OR after / before > 20) AS ok FROM a JOIN b USING (rec)""")
def q05(spark, sf):
    t = Tables(spark, sf)
    s = signal(t)
    out = ql.amplitude_ratio(s, ch.average_referenced(s), lo=0.5, halt=False, hot=t.hot("lineitem"))
    return out.select("rec", rounded(F.col("ratio")).alias("ratio"), "ok")


@query("q06_robust_scale", with_views(SIGNAL) + f"""
, q AS (SELECT rec, channel, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS q3
  FROM signal GROUP BY 1, 2), g AS (SELECT rec, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m,
  quantile_cont(x, 0.75) AS q3 FROM signal GROUP BY 1)
SELECT 'channel' AS mode, s.rec, s.channel, t, {r('CASE WHEN q3 <> q1 THEN (x - m) / (q3 - q1) ELSE 0 END')} AS scaled
  FROM signal s JOIN q USING (rec, channel)
UNION ALL SELECT 'global', s.rec, s.channel, t, {r('CASE WHEN q3 <> q1 THEN (x - m) / (q3 - q1) ELSE 0 END')} FROM signal s JOIN g USING (rec)""")
def q06(spark, sf):
    t = Tables(spark, sf)
    s, hot = signal(t), t.hot("lineitem")
    per = [ql.robust_scaled(s, keys, hot).select(F.lit(mode).alias("mode"), "rec", "channel", "t",
                                                 rounded(F.col("scaled")).alias("scaled"))
           for mode, keys in (("channel", ["rec", "channel"]), ("global", ["rec"]))]
    return per[0].unionByName(per[1])


@query("q07_longest_recording", f"""
SELECT o_custkey AS subject, arg_max(o_orderkey, (n, -o_orderkey)) AS row, max(n) AS n_samples,
  {r('arg_min(age, o_orderkey) FILTER (age > 0)')} AS age, arg_min(sex, o_orderkey) FILTER (sex IS NOT NULL) AS sex FROM (
  SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS n,
    CAST(day(o_orderdate) AS DOUBLE) - 10 AS age, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS sex FROM orders)
GROUP BY 1 HAVING max(n) >= 4000""")
def q07(spark, sf):
    o = Tables(spark, sf).orders.select(
        F.col("o_custkey").alias("subject"), "o_orderkey", F.floor(F.col("o_totalprice") / 100).alias("n"),
        (F.dayofmonth("o_orderdate").cast("double") - 10).alias("age"),
        F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "M").alias("sex"))
    return ql.longest_recording(o, "subject", "o_orderkey", "n", 4000).withColumn("age", rounded(F.col("age")))


@query("q08_preferred_copy", """
SELECT subject, path, has_data, n_copies FROM (SELECT source AS subject, lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path,
  n_chars > 3000 AS has_data, count(*) OVER (PARTITION BY source) AS n_copies,
  row_number() OVER (PARTITION BY source ORDER BY n_chars > 3000 DESC, lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS k
  FROM documents) WHERE k = 1""")
def q08(spark, sf):
    d = Tables(spark, sf).documents.select(
        F.col("source").alias("subject"), F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
        (F.col("n_chars") > 3000).alias("has_data"))
    return ql.preferred_copy(d, "subject", "has_data", "path")


@query("q08_availability", """
SELECT lang AS class, n_chars > 3000 AS present, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1, 2""")
def q08_avail(spark, sf):
    d = Tables(spark, sf).documents
    return d.groupBy(F.col("lang").alias("class"), (F.col("n_chars") > 3000).alias("present")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


BLOCKS = [("temporal", "T5"), ("temporal", "T6"), ("occipital", "O1"), ("occipital", "O2"), ("frontal", "Fp1"), ("frontal", "Fp2")]


@query("q09_block_structure", with_views(SIGNAL) + f"""
, c AS (SELECT a.rec, a.channel AS a, b.channel AS b, corr(a.x, b.x) AS r FROM signal a JOIN signal b ON a.rec = b.rec
   AND a.t = b.t AND a.channel <> b.channel GROUP BY 1, 2, 3),
bl AS (SELECT * FROM {dims.values_sql(BLOCKS)} v(block, channel)),
per AS (SELECT rec, p.block, avg(r) FILTER (p.block IS NOT DISTINCT FROM q.block) AS w,
   avg(r) FILTER (p.block IS DISTINCT FROM q.block) AS b FROM c JOIN bl p ON p.channel = c.a LEFT JOIN bl q ON q.channel = c.b GROUP BY 1, 2)
SELECT block, count(*) AS n_recordings, {r('avg(w)')} AS mean_within, {r('avg(b)')} AS mean_between, {r('avg(w - b)')} AS separation,
  {r('avg(w - b) - 1.959964e0 * stddev_samp(w - b) / sqrt(count(*))')} AS ci_lo,
  {r('avg(w - b) + 1.959964e0 * stddev_samp(w - b) / sqrt(count(*))')} AS ci_hi, avg(w) > avg(b) AS separated FROM per GROUP BY block""")
def q09(spark, sf):
    t = Tables(spark, sf)
    out = ql.block_structure(ql.channel_correlations(signal(t), t.one_hot("lineitem", "l_suppkey")), dims.table(spark, BLOCKS, "block, channel"))
    return out.select("block", "n_recordings", *[rounded(F.col(c)).alias(c) for c in (
        "mean_within", "mean_between", "separation", "ci_lo", "ci_hi")], "separated")
