"""Spectral features over the window adapter, with a direct-DFT statement as the twin."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import rounded
from tidemark.operators import spectral as sp
from tidemark.operators import sweep as sw
from tidemark.plans.recordings import ACC, LIMIT, PTP, QUOTA, SAMPLED, ptp_of, taps_sql
from tidemark.plans.registry import Tables, query
from tidemark.plans.sql import band_gain, r
from tidemark.operators import windows as wn
from tidemark.tables import LONG_WINDOWS, SCALP, SIGNAL, long_windows, raw_scalp, scalp, with_views

# Windows of 320 samples at 96 Hz: segments of 192 samples, two of them, bins of half a hertz up to 48 Hz.
RATE, LENGTH = 96, 320
GRID = sp.Grid(LENGTH, RATE)
GRIDS = sp.Grids([GRID])
PSD = """seg AS (SELECT rec, win, channel, g, t - g * 96 AS t, x FROM smp, (SELECT unnest(range(0, 2)) AS g) WHERE t >= g * 96 AND t < g * 96 + 192),
tap AS (SELECT rec, win, channel, g, t, (x - avg(x) OVER (PARTITION BY rec, win, channel, g)) * (0.5e0 - 0.5e0 * cos(2 * pi() * t / 192)) AS v FROM seg),
psg AS (SELECT rec, win, channel, g, k, (pow(sum(v * cos(2 * pi() * k * t / 192)), 2) + pow(sum(v * sin(2 * pi() * k * t / 192)), 2))
   / (96 * 72.0e0) * CASE WHEN k IN (0, 96) THEN 1 ELSE 2 END AS p FROM tap, (SELECT unnest(range(0, 97)) AS k) GROUP BY 1, 2, 3, 4, 5),
psd AS (SELECT rec, win, channel, k, k / 2.0e0 AS f, avg(p) AS p FROM psg GROUP BY 1, 2, 3, 4)"""


def _trap(lo: int, hi: int) -> str:
    return f"(sum(p) FILTER (f >= {lo} AND f < {hi}) - sum(p) FILTER (f IN ({lo}, {hi - 0.5})) / 2) / 2"


FEAT = f"""dif AS (SELECT rec, win, channel, t, x, x - lag(x) OVER w AS d1,
   x - 2 * lag(x) OVER w + lag(x, 2) OVER w AS d2 FROM smp WINDOW w AS (PARTITION BY rec, win, channel ORDER BY t)),
hj AS (SELECT rec, win, channel, sqrt(var_pop(d1) / var_pop(x)) AS mob, sqrt(var_pop(d2) / var_pop(d1)) AS mob1 FROM dif GROUP BY 1, 2, 3),
cum AS (SELECT *, p / sum(p) OVER (PARTITION BY rec, win, channel) AS q,
   sum(p) OVER (PARTITION BY rec, win, channel ORDER BY f) / sum(p) OVER (PARTITION BY rec, win, channel) AS c FROM psd),
bp AS (SELECT rec, win, channel, {_trap(1, 4)} AS d, {_trap(4, 8)} AS th, {_trap(8, 13)} AS a, {_trap(13, 30)} AS b, {_trap(30, 45)} AS g,
   -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(97) AS ent, min(f) FILTER (c >= 0.95e0) AS edge, min(f) FILTER (c >= 0.5e0) AS med,
   arg_max(f, (p, -f)) FILTER (f BETWEEN 6 AND 13) AS pf, max(p) FILTER (f BETWEEN 6 AND 13) / sum(p) FILTER (f BETWEEN 6 AND 13) AS ps,
   -regr_slope(log10(greatest(p, 1e-30)), log10(f)) FILTER (f BETWEEN 2 AND 24) AS ape FROM cum GROUP BY 1, 2, 3),
feat AS (SELECT rec, win, channel, d / (d + th + a + b + g) AS rel_delta, th / (d + th + a + b + g) AS rel_theta, a / (d + th + a + b + g) AS rel_alpha,
   b / (d + th + a + b + g) AS rel_beta, g / (d + th + a + b + g) AS rel_gamma, th / a AS theta_alpha_ratio, (d + th) / (a + b) AS slowing_ratio,
   ent AS spectral_entropy, CAST(edge AS DOUBLE) AS spectral_edge95, CAST(med AS DOUBLE) AS spectral_median, CAST(pf AS DOUBLE) AS pdr_frequency,
   ps AS pdr_prominence, ape AS aperiodic_exponent, mob AS hjorth_mobility, mob1 / mob AS hjorth_complexity, a AS alpha
   FROM bp JOIN hj USING (rec, win, channel))"""
REG = {c: k for k, cs in dims.REGION.items() for c in cs}
SPATIAL = f"""pr AS (SELECT * FROM {dims.values_sql(dims.LATERAL_PAIRS)} v(l, r)),
rg AS (SELECT * FROM {dims.values_sql(list(REG.items()))} v(channel, region)),
asym AS (SELECT a.rec, a.win, avg(abs((a.alpha - b.alpha) / (a.alpha + b.alpha))) AS asymmetry_alpha FROM pr JOIN feat a ON a.channel = l
   JOIN feat b ON b.channel = r AND b.rec = a.rec AND b.win = a.win GROUP BY 1, 2),
grad AS (SELECT rec, win, (po - an) / (po + an) AS ap_gradient_alpha FROM (SELECT rec, win, avg(alpha) FILTER (region = 'posterior') AS po,
   avg(alpha) FILTER (region = 'frontal') AS an FROM feat JOIN rg USING (channel) GROUP BY 1, 2)),
wfeat AS (SELECT f.rec, f.win, {', '.join(f'avg({n}) AS {n}' for n in dims.FEATURES[:15])}, any_value(asymmetry_alpha) AS asymmetry_alpha,
   any_value(ap_gradient_alpha) AS ap_gradient_alpha FROM feat f LEFT JOIN asym USING (rec, win) LEFT JOIN grad USING (rec, win) GROUP BY 1, 2)"""


def spectrum(t: Tables):
    return sp.spectra(long_windows(t), RATE)


def per_channel(t: Tables):
    return sp.channel_features(spectrum(t), GRIDS)


@query("f01_welch_psd", with_views(LONG_WINDOWS, PSD) + f"SELECT rec, win, channel, k AS f, {r('p', 9)} AS p FROM psd")
def f01(spark, sf):
    return spectrum(Tables(spark, sf)).select("rec", "win", "channel", F.posexplode("p").alias("f", "p")).select(
        "rec", "win", "channel", F.col("f").cast("bigint").alias("f"), rounded(F.col("p"), 9).alias("p"))


@query("f02_band_power", with_views(LONG_WINDOWS, PSD, FEAT) + f"""
SELECT rec, win, channel, {r('d', 9)} AS delta, {r('th', 9)} AS theta, {r('a', 9)} AS alpha, {r('b', 9)} AS beta,
  {r('g', 9)} AS gamma FROM bp""")
def f02(spark, sf):
    d = sp.with_band_powers(spectrum(Tables(spark, sf)), GRIDS)
    return d.select("rec", "win", "channel", *[rounded(F.col(f"bp_{b}"), 9).alias(b) for b in dims.BANDS])


def _register(number: int, name: str) -> None:
    @query(f"f{number:02d}_{name}", with_views(LONG_WINDOWS, PSD, FEAT) + f"""
SELECT rec, win, channel, {r(name)} AS {name} FROM feat""")
    def run(spark, sf):
        return per_channel(Tables(spark, sf)).select("rec", "win", "channel", rounded(F.col(name)).alias(name))


for _i, _name in enumerate(dims.FEATURES[:15], start=3):
    _register(_i, _name)


@query("f18_asymmetry_alpha", with_views(LONG_WINDOWS, PSD, FEAT, SPATIAL) + f"""
SELECT rec, win, {r('asymmetry_alpha')} AS asymmetry_alpha FROM wfeat""")
def f18(spark, sf):
    w = sp.window_features(per_channel(Tables(spark, sf)), ["rec", "win"])
    return w.select("rec", "win", rounded(F.col("asymmetry_alpha")).alias("asymmetry_alpha"))


@query("f19_ap_gradient_alpha", with_views(LONG_WINDOWS, PSD, FEAT, SPATIAL) + f"""
SELECT rec, win, {r('ap_gradient_alpha')} AS ap_gradient_alpha FROM wfeat""")
def f19(spark, sf):
    w = sp.window_features(per_channel(Tables(spark, sf)), ["rec", "win"])
    return w.select("rec", "win", rounded(F.col("ap_gradient_alpha")).alias("ap_gradient_alpha"))


ALL_R = ", ".join(f"{r(n)} AS {n}" for n in dims.FEATURES)


@query("f20_window_vector", with_views(LONG_WINDOWS, PSD, FEAT, SPATIAL) + f"SELECT rec, win, {ALL_R} FROM wfeat")
def f20(spark, sf):
    w = sp.window_features(per_channel(Tables(spark, sf)), ["rec", "win"])
    return w.select("rec", "win", *[rounded(F.col(n)).alias(n) for n in dims.FEATURES])


@query("f21_recording_vector", with_views(LONG_WINDOWS, PSD, FEAT, SPATIAL) + f"""
SELECT rec, count(*) AS n_windows, {', '.join(r(f'quantile_cont({n}, 0.5)') + f' AS {n}' for n in dims.FEATURES)} FROM wfeat GROUP BY rec""")
def f21(spark, sf):
    t = Tables(spark, sf)
    w = sp.window_features(per_channel(t), ["rec", "win"])
    return sp.recording_features(w, ["rec"], hot=t.hot("embeddings")).select(
        "rec", "n_windows", *[rounded(F.col(n)).alias(n) for n in dims.FEATURES])


@query("j10_lateral_pairs", with_views(LONG_WINDOWS, PSD, FEAT, SPATIAL) + f"""
SELECT a.rec, a.win, l || '-' || r AS pair, {r('(a.alpha - b.alpha) / (a.alpha + b.alpha)')} AS contrast FROM pr
JOIN feat a ON a.channel = l JOIN feat b ON b.channel = r AND b.rec = a.rec AND b.win = a.win""")
def j10(spark, sf):
    f = per_channel(Tables(spark, sf)).select("rec", "win", "channel", "alpha")
    side = F.broadcast(dims.lateral_pair(spark).select(
        F.concat_ws("-", "l", "r").alias("pair"),
        F.explode(F.create_map(F.col("l"), F.lit(1.0), F.col("r"), F.lit(-1.0))).alias("channel", "sign")))
    g = f.join(side, "channel").groupBy("rec", "win", "pair").agg(
        F.sum(F.col("sign") * F.col("alpha")).alias("d"), F.sum("alpha").alias("s"), F.count("*").alias("k"))
    return g.filter("k = 2").select("rec", "win", "pair", rounded(sp.ratio(F.col("d"), F.col("s"))).alias("contrast"))


@query("j11_region_membership", with_views(LONG_WINDOWS, PSD, FEAT, SPATIAL) + f"""
SELECT rec, win, region, {r('avg(alpha)', 9)} AS alpha, count(*) AS n_sites FROM feat JOIN rg USING (channel) GROUP BY 1, 2, 3""")
def j11(spark, sf):
    f = per_channel(Tables(spark, sf)).join(F.broadcast(dims.region_channel(spark)), "channel")
    return f.groupBy("rec", "win", "region").agg(rounded(F.avg("alpha"), 9).alias("alpha"), F.count("*").alias("n_sites"))


MAINS = f"""mp AS (SELECT rec, f, avg(p) AS v FROM psd GROUP BY 1, 2),
mc AS (SELECT rec, f0, max(v) FILTER (f > f0 - 2 AND f < f0 + 2) AS peak, quantile_cont(v, 0.5) AS loc, count(*) AS n FROM mp,
   {dims.values_sql([(12.0,), (20.0,)])} c(f0) WHERE f > f0 - 10 AND f < f0 + 10 AND f0 < 30 GROUP BY 1, 2)"""


@query("q03_mains_detection", with_views(LONG_WINDOWS, PSD, MAINS) + f"""
SELECT rec, {r('max(peak / (loc + 1e-30))')} AS ratio, CASE WHEN max(peak / (loc + 1e-30)) >= 1.2e0
  THEN arg_max(f0, peak / (loc + 1e-30)) END AS mains_hz FROM mc GROUP BY rec""")
def q03(spark, sf):
    m = sp.mains(spectrum(Tables(spark, sf)), ["rec"], GRID, (12.0, 20.0), 1.2)
    return m.select("rec", rounded(F.col("ratio")).alias("ratio"), "mains_hz")


@query("f22_participant_collapse", f"""
WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, quantile_cont(value, 0.5) AS v, arg_min(event_type, ts) AS site FROM events GROUP BY 1, 2),
 m AS (SELECT user_id, event_type AS disease, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2)
SELECT s.user_id, {r('quantile_cont(v, 0.5)')} AS value, any_value(disease) AS disease, arg_min(site, day) AS site, count(*) AS n_sessions,
  bool_and(v > 0.5e0) AS usable FROM s JOIN m ON m.user_id = s.user_id AND k = 1 GROUP BY 1""")
def f22(spark, sf):
    t = Tables(spark, sf)
    return participants(t.events, t.hot("events"))


def participants(events, hot):
    """Sessions first, then one row per participant: median measure, modal tag, first site."""
    from tidemark.operators.ordered import medians
    ev = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    ses = medians(ev, ["user_id", "day"], "value", "v", hot)
    info = ev.groupBy("user_id").agg(F.mode("event_type", True).alias("disease"),
                                     F.min_by("event_type", "ts").alias("site"))
    per = medians(ses, ["user_id"], "v", "value", hot)
    use = ses.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.bool_and(F.col("v") > 0.5).alias("usable"))
    return per.join(info, "user_id").join(use, "user_id").select(
        "user_id", rounded(F.col("value")).alias("value"), "disease", "site", "n_sessions", "usable")


# The sweep: 19 sites at a nominal 96 Hz, windows of 64 samples, bins of 1.5 Hz at every rate.
S_RATE, S_RATES, S_LENGTH, S_LIMIT, S_SCALE = 96, [96, 48, 24], 64, 0.8, 2.0


def sweep_cube(t: Tables):
    raw, offsets = raw_scalp(t)
    return sw.swept(scalp(t), S_LENGTH, S_RATE, S_LIMIT, QUOTA, S_RATES, dims.DEPTHS, S_SCALE, False, raw, offsets)


CONDS = [(m, r, b, p, f"{m}|{r}|{'f32' if b is None else b}|{p}", dims.MONTAGES[m][1] == "bipolar")
         for m, p, r, b in sw.conditions(S_RATE, S_RATES, dims.DEPTHS, True)]
_SPTP = PTP.replace(" / 16)", " / 64)").replace("= 16", "= 64")
_SACC = ACC.replace(f"{LIMIT}e0", f"{S_LIMIT}e0")


def _trap2(lo: int, hi: int) -> str:
    """Trapezoid on the 1.5 Hz grid of the sweep."""
    first, last = 1.5 * -(-lo * 2 // 3), 1.5 * (-(-hi * 2 // 3) - 1)
    return f"1.5e0 * (sum(p) FILTER (f >= {lo} AND f < {hi}) - sum(p) FILTER (f IN ({first}, {last})) / 2)"


def _decimated(name: str, k: int) -> str:
    return f"""{name} AS (SELECT montage, rec, win, channel, (t + j) // {k} AS t, sum(x * h) AS x FROM sig JOIN {taps_sql(k)}
  ON (t + j) % {k} = 0 AND t + j >= 0 AND t + j < 64 WHERE src = 'ica' AND montage IN ('b19', 'b4') GROUP BY 1, 2, 3, 4, 5)"""


# From samples cell(cond, bip, rate, rec, win, channel, t, x) on a grid of 1.5 Hz to the medians of every recording.
CUBE_OF_CELLS = f"""stap AS (SELECT *, rate * 2 // 3 AS n, (x - avg(x) OVER w) * (0.5e0 - 0.5e0 * cos(2 * pi() * t / (rate * 2 // 3))) AS v,
   x - lag(x) OVER o AS d1, x - 2 * lag(x) OVER o + lag(x, 2) OVER o AS d2 FROM cell
   WINDOW w AS (PARTITION BY cond, rec, win, channel), o AS (PARTITION BY cond, rec, win, channel ORDER BY t)),
sps AS (SELECT cond, bip, rate, rec, win, channel, 1.5e0 * k AS f, (pow(sum(v * cos(2 * pi() * k * t / n)), 2) + pow(sum(v * sin(2 * pi() * k * t / n)), 2))
   / (rate * n * 0.375e0) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS p
   FROM stap, (SELECT unnest(range(0, 33)) AS k) WHERE 2 * k <= n GROUP BY cond, bip, rate, rec, win, channel, k, n),
scum AS (SELECT *, p / sum(p) OVER g AS q, sum(p) OVER (PARTITION BY cond, rec, win, channel ORDER BY f) / sum(p) OVER g AS c FROM sps
   WINDOW g AS (PARTITION BY cond, rec, win, channel)),
sbp AS (SELECT cond, bip, rate, rec, win, channel, {_trap2(1, 4)} AS d, {_trap2(4, 8)} AS th, CASE WHEN rate > 24 THEN {_trap2(8, 13)} END AS a,
   CASE WHEN rate = 96 THEN {_trap2(13, 30)} END AS b, CASE WHEN rate = 96 THEN {_trap2(30, 45)} END AS g,
   -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(count(*)) AS ent, min(f) FILTER (c >= 0.95e0) AS edge, min(f) FILTER (c >= 0.5e0) AS med,
   arg_max(f, (p, -f)) FILTER (f BETWEEN 6 AND 13) AS pf, max(p) FILTER (f BETWEEN 6 AND 13) / sum(p) FILTER (f BETWEEN 6 AND 13) AS ps,
   -regr_slope(log10(greatest(p, 1e-30)), log10(f)) FILTER (f BETWEEN 2 AND 24) AS ape FROM scum GROUP BY 1, 2, 3, 4, 5, 6),
sall AS (SELECT *, d + th + coalesce(a, 0) + coalesce(b, 0) + coalesce(g, 0) AS whole FROM sbp),
shj AS (SELECT cond, rec, win, channel, sqrt(var_pop(d1) / var_pop(x)) AS mob, sqrt(var_pop(d2) / var_pop(d1)) AS mob1 FROM stap GROUP BY 1, 2, 3, 4),
sas AS (SELECT x.cond, x.rec, x.win, avg(abs((x.a - y.a) / (x.a + y.a))) AS asy FROM {dims.values_sql(dims.LATERAL_PAIRS)} pr(l, r) JOIN sbp x ON x.channel = l
   JOIN sbp y ON y.channel = r AND y.cond = x.cond AND y.rec = x.rec AND y.win = x.win WHERE NOT x.bip GROUP BY 1, 2, 3),
sgr AS (SELECT cond, rec, win, (po - an) / (po + an) AS grd FROM (SELECT cond, rec, win, avg(a) FILTER (region = 'posterior') AS po,
   avg(a) FILTER (region = 'frontal') AS an FROM sbp JOIN {dims.values_sql(list(REG.items()))} rg(channel, region) USING (channel) WHERE NOT bip GROUP BY 1, 2, 3)),
swn AS (SELECT s.cond, s.rec, s.win, avg(d / whole) AS rel_delta, avg(th / whole) AS rel_theta, avg(a / whole) AS rel_alpha, avg(b / whole) AS rel_beta,
   avg(g / whole) AS rel_gamma, avg(th / a) AS theta_alpha_ratio, avg((d + th) / (a + b)) AS slowing_ratio, avg(ent) AS spectral_entropy,
   avg(edge) AS spectral_edge95, avg(med) AS spectral_median, avg(pf) AS pdr_frequency, avg(ps) AS pdr_prominence, avg(ape) AS aperiodic_exponent,
   avg(mob) AS hjorth_mobility, avg(mob1 / mob) AS hjorth_complexity, any_value(asy) AS asymmetry_alpha, any_value(grd) AS ap_gradient_alpha
   FROM sall s JOIN shj USING (cond, rec, win, channel) LEFT JOIN sas USING (cond, rec, win) LEFT JOIN sgr USING (cond, rec, win) GROUP BY 1, 2, 3),
swp AS (SELECT cond, rec, count(*) AS n_windows, {', '.join(f'quantile_cont({n}, 0.5) AS {n}' for n in dims.FEATURES)} FROM swn GROUP BY 1, 2)"""


SWEEP = f"""{_SPTP}, {_SACC}, {SAMPLED},
raw AS (SELECT s.rec, w.win, s.channel, s.t - w.win * 64 AS t, s.x FROM signal s JOIN wsam w ON w.rec = s.rec AND w.win = CAST(floor(s.t / 64) AS BIGINT)),
inp AS (SELECT 'ica' AS src, * FROM raw UNION ALL SELECT 'raw', rec, win, channel, t, 1.1e0 * x + 0.01e0 * (t % 2) FROM raw),
sch AS (SELECT * FROM {dims.values_sql([(m, s[1], c) for m, s in dims.MONTAGES.items() for c in s[0]])} v(montage, ref, channel)),
spr AS (SELECT * FROM {dims.values_sql([(m, a, b) for m, s in dims.MONTAGES.items() for a, b in s[2]])} v(montage, a, b)),
sig AS (SELECT src, montage, rec, win, channel, t, x - CASE WHEN ref = 'subset_car' THEN avg(x) OVER (PARTITION BY src, montage, rec, win, t) ELSE 0 END AS x
    FROM inp JOIN sch USING (channel) WHERE ref <> 'bipolar'
  UNION ALL SELECT p.src, montage, p.rec, p.win, a || '-' || b, p.t, p.x - q.x FROM spr JOIN inp p ON p.channel = a
    JOIN inp q ON q.channel = b AND q.src = p.src AND q.rec = p.rec AND q.win = p.win AND q.t = p.t),
emc AS (SELECT montage, rec, win, channel, k, sum(x * cos(2 * pi() * k * t / 64)) AS re, sum(x * sin(2 * pi() * k * t / 64)) AS im
  FROM sig, (SELECT unnest(range(1, 32)) AS k) WHERE src = 'ica' AND montage IN ('b19', 'b4') GROUP BY 1, 2, 3, 4, 5),
{_decimated('dec2', 2)}, {_decimated('dec4', 4)},
arms AS (SELECT montage, 'full' AS preproc, 96 AS rate, rec, win, channel, t, x FROM sig WHERE src = 'ica'
  UNION ALL SELECT montage, 'noica', 96, rec, win, channel, t, x FROM sig WHERE src = 'raw' AND montage IN ('b19', 'b4')
  UNION ALL SELECT montage, 'emgfree', 96, rec, win, channel, t, sum({band_gain('1.5e0 * k', 96, 2, 20)} * (re * cos(2 * pi() * k * t / 64) + im * sin(2 * pi() * k * t / 64))) / 32
    FROM emc, (SELECT unnest(range(0, 64)) AS t) GROUP BY montage, rec, win, channel, t
  UNION ALL SELECT montage, 'full', 48, rec, win, channel, t, x FROM dec2
  UNION ALL SELECT montage, 'full', 24, rec, win, channel, t, x FROM dec4),
cell AS (SELECT cond, bip, rate, rec, win, channel, t, CASE WHEN bits IS NULL THEN x ELSE
    greatest(least(round_even(x / (2e0 / pow(2.0e0, bits)), 0) * (2e0 / pow(2.0e0, bits)), 1e0), -1e0) END AS x
  FROM arms JOIN {dims.values_sql(CONDS)} c(montage, rate, bits, preproc, cond, bip) USING (montage, rate, preproc)),
{CUBE_OF_CELLS}"""


@query("f23_sweep", with_views(SCALP, SWEEP) + f"SELECT cond, rec, n_windows, {', '.join(f'{r(n, 5)} AS {n}' for n in dims.FEATURES)} FROM swp")
def f23(spark, sf):
    out = sweep_cube(Tables(spark, sf))
    return out.select("cond", "rec", "n_windows", *[rounded(F.col(n), 5).alias(n) for n in dims.FEATURES])


@query("f24_sweep_report", with_views(SCALP, SWEEP) + f"""
SELECT cond, count(*) AS n_recordings, {' + '.join(f'CASE WHEN count({n}) = count(*) THEN 1 ELSE 0 END' for n in dims.FEATURES)} AS n_usable,
  CAST(quantile_cont(n_windows, 0.5) AS DOUBLE) AS median_windows FROM swp GROUP BY cond""")
def f24(spark, sf):
    return sw.sweep_report(sweep_cube(Tables(spark, sf)))


@query("f24_window_report", with_views(SIGNAL, PTP, ACC) + f"""
SELECT CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_windows, CAST(quantile_cont(rej, 0.5) AS DOUBLE) AS median_rejected, count(*) AS n_recordings
FROM (SELECT rec, count(*) AS n, max(CASE WHEN n_ok > 0 THEN n_windows - n_ok ELSE n_windows - least(n_windows, {QUOTA}) END) AS rej FROM wacc GROUP BY rec)""")
def f24w(spark, sf):
    per = wn.accepted(ptp_of(Tables(spark, sf)), LIMIT, QUOTA).groupBy("rec").agg(
        F.count("*").alias("n"), F.max("rejected").alias("rej"))
    return per.agg(F.percentile("n", F.lit(0.5)).alias("median_windows"), F.percentile("rej", F.lit(0.5)).alias("median_rejected"),
                   F.count("*").alias("n_recordings"))
