"""The stress cube and the stress table: what faults of an acquisition leave of a measurement."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import rounded
from tidemark.operators import batched as bt
from tidemark.operators import bootstrap as bs
from tidemark.operators import resample as rp
from tidemark.operators import stress as st
from tidemark.operators import sweep as sw
from tidemark.plans.inference import POOLED, _family, margin_tests, pair_family
from tidemark.plans.recordings import QUOTA, taps_sql
from tidemark.plans.registry import Tables, query
from tidemark.plans.spectra import CUBE_OF_CELLS, S_LENGTH, S_LIMIT, S_RATE, S_SCALE, SWEEP
from tidemark.plans.sql import delong_cte
from tidemark.plans.sql import digest as dsql
from tidemark.plans.sql import h as hsql
from tidemark.plans.sql import r
from tidemark.session import stored
from tidemark.tables import SCALP, SIGNAL, SITES, case_map, scalp, signal, with_views


def scaled(share: int) -> dict[str, tuple]:
    """The fault list with quotas for recordings a ``share``-th as long."""
    return {n: (move, drop, max(1, quota // share), divisor, bits) for n, (move, drop, quota, divisor, bits) in dims.STRESS.items()}


def cube_sql(length: int, rate: int, limit: float, full_scale: float, montages: list[str], faults: dict, sites: list[str]) -> str:
    """CTEs from signal(rec, channel, t, x) to swp(cond, rec, n_windows, features)."""
    named = {n: st.Fault(*f) for n, f in faults.items()}
    mixes = st.mixes(named)
    place = [(m, c, i, len(dims.MONTAGES[m][0])) for m in montages for i, c in enumerate(dims.MONTAGES[m][0])]
    near = [(c, i, n, len(ns)) for c in sites for ns in [[n for n in dims.NEIGHBOURS[c] if n in sites]] for i, n in enumerate(ns)]
    moved = dims.values_sql([(m, float(f.share)) for m, f in mixes.items() if f.share])
    rows = dims.values_sql([(n, st.mix_of(n, f), f.quota, rate // f.divisor, f.bits) for n, f in named.items()])
    lsb = f"({full_scale}e0 / pow(2.0e0, bits))"
    return f"""sful AS (SELECT rec, t // {length} AS win, channel FROM signal GROUP BY 1, 2, 3 HAVING count(*) = {length}),
sned AS (SELECT rec, count(DISTINCT channel) AS need FROM signal GROUP BY 1),
swin AS (SELECT rec, win FROM sful JOIN sned USING (rec) GROUP BY rec, win HAVING count(*) = max(need)),
src AS (SELECT s.rec, w.win, s.channel, s.t - w.win * {length} AS t, s.x FROM signal s JOIN swin w ON w.rec = s.rec AND w.win = s.t // {length}),
smc AS (SELECT * FROM {dims.values_sql(place)} v(montage, channel, pos, n)),
snb AS (SELECT * FROM {dims.values_sql(near)} v(channel, slot, neighbour, k)),
smv AS (SELECT * FROM {moved} v(mix, share)),
sedg AS (SELECT rec, mix, channel, neighbour FROM sned CROSS JOIN smv CROSS JOIN snb WHERE slot = {hsql('rec', "mix || '|displace'", 'channel')} % k),
slst AS (SELECT rec, montage, channel AS lost FROM sned CROSS JOIN smc WHERE pos = {hsql('rec', "'contact|' || montage")} % n),
smix AS (SELECT '{st.PLAIN}' AS mix, montage, rec, win, channel, t, x FROM src JOIN smc USING (channel)
  UNION ALL SELECT 'contact_drop', montage, rec, win, channel, t, x FROM src JOIN smc USING (channel) JOIN slst USING (rec, montage) WHERE channel <> lost
  UNION ALL SELECT smv.mix, montage, s.rec, s.win, s.channel, s.t, CASE WHEN n.x IS NULL THEN s.x ELSE (1 - share) * s.x + share * n.x END
    FROM src s JOIN smc ON smc.channel = s.channel CROSS JOIN smv LEFT JOIN sedg e ON e.rec = s.rec AND e.mix = smv.mix AND e.channel = s.channel
    LEFT JOIN src n ON n.rec = s.rec AND n.win = s.win AND n.t = s.t AND n.channel = e.neighbour),
sig AS (SELECT mix, montage, rec, win, channel, t, x - avg(x) OVER (PARTITION BY mix, montage, rec, win, t) AS x FROM smix),
sptp AS (SELECT mix, montage, rec, win, max(p) AS ptp FROM (SELECT mix, montage, rec, win, channel, max(x) - min(x) AS p FROM sig GROUP BY ALL) GROUP BY ALL),
skep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mix, montage, rec ORDER BY ptp > {limit}e0,
    CASE WHEN ptp <= {limit}e0 THEN {dsql('rec', 'win')} END, ptp, win) AS k, bool_or(ptp <= {limit}e0) OVER (PARTITION BY mix, montage, rec) AS any_ok FROM sptp)
  WHERE ptp <= {limit}e0 OR NOT any_ok),
sdec AS (SELECT mix, montage, rec, win, channel, (t + j) // 2 AS t, sum(x * h) AS x FROM sig JOIN {taps_sql(2)}
  ON (t + j) % 2 = 0 AND t + j >= 0 AND t + j < {length} WHERE mix LIKE 'mix%' GROUP BY mix, montage, rec, win, channel, (t + j) // 2),
cell AS (SELECT fault || '|' || montage AS cond, false AS bip, rate, rec, win, channel, t, CASE WHEN bits IS NULL THEN x ELSE
    greatest(least(round_even(x / {lsb}, 0) * {lsb}, {full_scale / 2}e0), -{full_scale / 2}e0) END AS x
  FROM (SELECT *, {rate} AS rate FROM sig UNION ALL SELECT *, {rate // 2} FROM sdec) JOIN {rows} f(fault, mix, quota, rate, bits) USING (mix, rate)
  JOIN skep USING (mix, montage, rec, win) WHERE k <= quota),
{CUBE_OF_CELLS}"""


STRESS = scaled(3)


@query("f23_stress_cube", with_views(SCALP, cube_sql(S_LENGTH, S_RATE, S_LIMIT, S_SCALE, ["b19", "b4"], STRESS, dims.CANON))
       + f"SELECT cond, rec, n_windows, {', '.join(f'{r(n, 5)} AS {n}' for n in dims.FEATURES)} FROM swp")
def f23_stress(spark, sf):
    """Every fault of every recording at nineteen and at four sites."""
    t = Tables(spark, sf)
    out = st.stressed(scalp(t), S_LENGTH, S_RATE, S_LIMIT, S_SCALE, ["b19", "b4"], STRESS)
    return out.select("cond", "rec", "n_windows", *[rounded(F.col(n), 5).alias(n) for n in dims.FEATURES])


# The stress table: a recording a supplier, windows of 32 samples at a nominal 48 Hz, two montages of four sites.
T_RATE, T_LENGTH, T_LIMIT, T_SCALE, T_MONTAGES = 48, 32, 90000.0, 200000.0, ["b4", "muse"]
T_STRESS = scaled(12)
T_LABELS = ["CN", "AD", "MCI", "FTD", "VAD"]
T_CONTRASTS = ["screening", "dementia"]
FAULTS = [f for f in T_STRESS if f != "clean"]


def table_cube(t: Tables):
    """(contrast, montage, fault, rec, y, age, features): the stress cube of the labelled recordings with a known covariate."""
    out = st.stressed(signal(t), T_LENGTH, T_RATE, T_LIMIT, T_SCALE, T_MONTAGES, T_STRESS)
    part = F.split("cond", r"\|")
    out = out.select(part[0].alias("fault"), part[1].alias("montage"), "rec", *dims.FEATURES)
    who = t.supplier.filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("rec"), (F.col("s_acctbal") / 100).alias("age"),
                                                     case_map((F.col("s_nationkey") % 5).cast("int"), dict(enumerate(T_LABELS))).alias("label"))
    who = who.join(F.broadcast(dims.contrast(t.spark).filter(F.col("contrast").isin(T_CONTRASTS))), "label")
    return stored(out.join(who.drop("label"), "rec"), "stress-cube")


T_WHO = f"""who AS (SELECT s_suppkey AS rec, contrast, y, s_acctbal / 100 AS age FROM supplier JOIN {dims.values_sql(list(enumerate(T_LABELS)))} l(k, label) ON k = s_nationkey % 5
  JOIN {dims.values_sql([(c, l, 1) for c in T_CONTRASTS for l in dims.CONTRASTS[c]] + [(c, dims.CONTROL, 0) for c in T_CONTRASTS])} c(contrast, label, y) USING (label) WHERE s_acctbal >= 0)"""
KNOWN = " + ".join(f"CASE WHEN count({n}) = count(*) THEN 1 ELSE 0 END" for n in dims.FEATURES)


@query("mt11_stress_cube", with_views(SIGNAL, cube_sql(T_LENGTH, T_RATE, T_LIMIT, T_SCALE, T_MONTAGES, T_STRESS, SITES), T_WHO) + f"""
SELECT contrast, string_split(cond, '|')[2] AS montage, string_split(cond, '|')[1] AS fault, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_case, {KNOWN} AS n_features,
  {', '.join(f'{r(f"avg({n})", 5)} AS {n}' for n in dims.FEATURES)} FROM swp JOIN who USING (rec) GROUP BY 1, 2, 3""")
def mt11_cube(spark, sf):
    """What the stress table reads: recordings, cases, features known everywhere, and feature means."""
    return table_cube(Tables(spark, sf)).groupBy("contrast", "montage", "fault").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_case"), sum(F.when(F.count(n) == F.count("*"), 1).otherwise(0) for n in dims.FEATURES).alias("n_features"),
        *[rounded(F.avg(n), 5).alias(n) for n in dims.FEATURES])


def stress_scores(t: Tables, hot):
    """(contrast, montage, rec, y, age, one column a fault, regime and arm): fitted on the fault (device) or on clean recordings (clinic).

    Recordings measured under every fault. A feature takes part where it is known of all recordings it is fitted on and scored on. A row has the
    features of every fault once; arms take theirs.
    """
    cube, g = table_cube(t), ["contrast", "montage"]
    known = cube.groupBy(*g, "fault").agg(F.array(*[F.count(n) == F.count("*") for n in dims.FEATURES]).alias("known"))
    # One row for each contrast, montage and fault: the size of the design.
    of_group: dict = {}
    for r in known.collect():
        of_group.setdefault((r["contrast"], r["montage"]), {})[r["fault"]] = r["known"]
    x = F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in dims.FEATURES])
    per = cube.groupBy(*g, "rec", "y", "age").agg(F.map_from_entries(F.collect_list(F.struct("fault", x))).alias("m"))
    per = per.filter(F.size("m") == len(T_STRESS)).select(
        *g, "rec", "y", "age", F.array(F.col("age") / 25).alias("own"), *[F.element_at("m", F.lit(f)).alias(f"x_{f}") for f in T_STRESS])

    def shared(f: str, *others: str) -> tuple:
        """The features of a fault that are known under it and the others."""
        return f"x_{f}", {k: [i for i in range(len(dims.FEATURES)) if all(known[o][i] for o in (f, *others))] for k, known in of_group.items() if {f, *others} <= known.keys()}

    arms = {f"{f}:device{b}": [shared(f), *own] for f in T_STRESS for b, own in (("", []), ("_age", ["own"]))}
    arms |= {f"{f}:clinic{b}": ([shared("clean", f), *own], [shared(f, "clean"), *own]) for f in FAULTS for b, own in (("", []), ("_age", ["own"]))}
    s = bt.cross_validated(per, g, "rec", "y", arms, large=t.large("supplier"), hot=hot, carry=["age"], keep=None)
    return stored(s, "stress")


CASES = ["clean:device", *[f"{f}:{regime}" for f in FAULTS for regime in ("device", "clinic")]]


@query("mt11_stress_table")
def mt11(spark, sf):
    """Faults × montage × regime: scores and increments over the covariate, paired with clean."""
    t = Tables(spark, sf)
    hot = t.hot("supplier", fanout=2 * 3 * len(CASES))
    s = stress_scores(t, hot)
    tests = [(f"{c}:{m}", *p) for c in CASES for m, p in (
        ("inc", (f"{c}_age", "age")), ("score_to_clean", (c, "clean:device")), ("both_to_clean", (f"{c}_age", "clean:device_age")))
             if m == "inc" or c != "clean:device"]
    d = margin_tests(s, ["contrast", "montage"], tests, hot)
    part = F.split("margin", ":")
    return d.select("contrast", "montage", part[0].alias("fault"), part[1].alias("regime"), part[2].alias("test"), "n",
                    *[rounded(F.col(c)).alias(c) for c in ("auc_a", "auc_b", "diff", "se", "ci_lo", "ci_hi")], rounded(F.col("p"), 5).alias("p"))


@query("mt11_stress_intervals")
def mt11_intervals(spark, sf):
    """AUC of the features alone under every fault, with the bootstrap interval."""
    t = Tables(spark, sf)
    s = stress_scores(t, t.hot("supplier", fanout=len(CASES)))
    out = rp.interval(bs.aucs(s, ["contrast", "montage"], "rec", "y", CASES, 2000, "stress"), ["contrast", "montage", "arm"], "auc")
    part = F.split("arm", ":")
    return out.select("contrast", "montage", part[0].alias("fault"), part[1].alias("regime"), *[rounded(F.col(c)).alias(c) for c in ("mean", "ci_lo", "ci_hi")], "n_replicates")


# Placement pairs: every window of the scalp recordings is a recording of its own, so that each cohort has enough of them.
WHOLE_SCALP = SCALP.replace("signal AS (", "whole AS (", 1) + f""",
signal AS (SELECT rec * 1000000 + t // {S_LENGTH} AS rec, channel, t % {S_LENGTH} AS t, x FROM whole)"""
PLACED = f"""pl_s AS (SELECT rec, string_split(cond, '|')[1] AS montage, n.feature, n.value FROM swp
  CROSS JOIN LATERAL (VALUES {', '.join(f"('{n}', round({n}, 7))" for n in dims.SLOWING_TRIAD)}) n(feature, value) WHERE cond LIKE '%|{S_RATE}|f32|full'),
pr AS (SELECT a.feature AS task, p.ma || '_vs_' || p.mb AS pair, CASE WHEN a.rec % 2 = 0 THEN 'even' ELSE 'odd' END AS cohort,
   CASE WHEN a.rec // 1000000 >= 5 THEN 1 ELSE 0 END AS y, a.value AS sa, b.value AS sb
  FROM pl_s a JOIN pl_s b USING (rec, feature) JOIN {dims.values_sql(dims.PLACEMENT_PAIRS)} p(ma, mb) ON p.ma = a.montage AND p.mb = b.montage)"""


@query("i13_placement_pairs", with_views(WHOLE_SCALP, SWEEP, PLACED, delong_cte("res", "pr", "task, pair, cohort", "y", "sa", "sb"),
       POOLED.format(g="task, pair,", src="res")) + ", " + _family("task"))
def i13_placement(spark, sf):
    """Ten placements against each other by three measures of slowing, on the same recordings, pooled over cohorts and Holm-adjusted per measure."""
    t = Tables(spark, sf)
    at = F.floor(F.col("t") / S_LENGTH)
    own = scalp(t).select((F.col("rec") * 1000000 + at).alias("rec"), "channel", (F.col("t") % S_LENGTH).alias("t"), "x")
    cube = sw.swept(own, S_LENGTH, S_RATE, S_LIMIT, QUOTA, [S_RATE], [None], S_SCALE)
    wide = cube.groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct("cond", F.struct(*dims.SLOWING_TRIAD).alias("v")))).alias("m"))
    of = lambda m, n: F.round(F.try_element_at("m", F.lit(f"{m}|{S_RATE}|f32|full"))[n], 7)
    pairs = F.array(*[F.struct(F.lit(n).alias("task"), F.lit(f"{a}_vs_{b}").alias("pair"), of(a, n).alias("sa"), of(b, n).alias("sb"))
                      for n in dims.SLOWING_TRIAD for a, b in dims.PLACEMENT_PAIRS])
    rows = wide.select(F.when(F.col("rec") % 2 == 0, "even").otherwise("odd").alias("cohort"), (F.floor(F.col("rec") / 1000000) >= 5).cast("int").alias("y"),
                       F.explode(pairs).alias("p")).select("cohort", "y", "p.*")
    return pair_family(stored(rows, "placements"), ["task"], t.hot("embeddings", fanout=len(dims.PLACEMENT_PAIRS)))
