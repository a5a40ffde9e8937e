import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.operators import channels as ch
from tidemark.operators import degrade as dg
from tidemark.operators import operating as op
from tidemark.operators import quality as ql
from tidemark.operators import spectral as sp
from tidemark.operators import windows as wn


def samples(spark, data):
    rows = [(r, c, t, float(x)) for (r, c), xs in data.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "rec string, channel string, t bigint, x double")


def direct_psd(x, rate):
    n = min(len(x), 2 * rate)
    hop = n - n // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    out = []
    for s in range(0, len(x) - n + 1, hop):
        seg = (x[s:s + n] - x[s:s + n].mean()) * w
        k = np.arange(n // 2 + 1)[:, None]
        dft = (seg * np.exp(-2j * np.pi * k * np.arange(n) / n)).sum(1)
        p = np.abs(dft) ** 2 / (rate * (w ** 2).sum())
        p[1:-1] *= 2
        out.append(p)
    return np.mean(out, axis=0)


def test_welch_with_overlapping_segments():
    x = np.random.default_rng(0).normal(size=(2, 256))
    for row, p in zip(x, sp.welch_rows(x, 32)):
        assert np.allclose(p, direct_psd(row, 32))


def test_spectrum_power_equals_variance():
    x = np.random.default_rng(1).normal(size=(1, 4096))
    p = sp.welch_rows(x, 64)[0]
    assert abs(p.sum() * 0.5 - x.var()) < 0.1


def test_features_of_a_pure_rhythm(spark):
    t = np.arange(512) / 128
    x = np.sin(2 * np.pi * 10 * t)
    df = spark.createDataFrame([("r", 0, "O1", x.tolist()), ("r", 0, "O2", (2 * x).tolist()), ("r", 0, "Fp1", [0.0] * 512)],
                               "rec string, win int, channel string, x array<double>")
    f = sp.channel_features(sp.spectra(df, 128), sp.Grids([sp.Grid(512, 128)]))
    out = {r["channel"]: r for r in f.collect()}
    assert out["O1"]["pdr_frequency"] == 10.0 and out["O1"]["rel_alpha"] > 0.95
    assert out["Fp1"]["rel_alpha"] is None and out["Fp1"]["hjorth_mobility"] is None
    w = sp.window_features(f, ["rec", "win"]).first()
    assert abs(w["asymmetry_alpha"] - 0.6) < 1e-9      # (1 - 4) / (1 + 4)
    assert abs(w["ap_gradient_alpha"] - 1.0) < 1e-9
    low = sp.channel_features(sp.spectra(df, 64), sp.Grids([sp.Grid(512, 64)])).first()
    assert low["rel_gamma"] is None                    # band above Nyquist


def test_decimation(spark):
    x = np.random.default_rng(2).normal(size=64)
    h = dg.decimation_taps(2)
    want = [sum(h[20 + j] * x[2 * m - j] for j in range(-20, 21) if 0 <= 2 * m - j < 64) for m in range(32)]
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    assert np.allclose(dg.decimated(df, 64, 32).first()["x"], want)
    assert abs(h.sum() - 1) < 1e-12
    with pytest.raises(ValueError, match="integer multiple"):
        dg.decimated(df, 64, 48)


def test_band_restriction_keeps_only_the_band():
    t = np.arange(256) / 64
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 30 * t) + 3
    y = dg.restrict_rows(x[None], 64, 2, 20)[0]
    assert np.allclose(y, np.sin(2 * np.pi * 10 * t), atol=1e-3)
    gain = dg.band_gain(np.array([0.0, 2.0, 20.0, 32.0]), 64, 2, 20)
    assert np.allclose(gain, [0, 0.5, 0.5, 0])      # two half-power passes at the edges


def test_quantise_is_half_even_and_clipped(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (100.0,), (-100.0,)], "x double")
    got = [r[0] for r in df.select(dg.quantised(F.col("x"), 3, 8.0)).collect()]
    assert got == [0.0, 2.0, 2.0, 4.0, -4.0]
    assert df.select(dg.quantised(F.col("x"), F.lit(None).cast("int"), 8.0)).first()[0] == 0.5
    assert dg.converted_rows(np.array([r[0] for r in df.select("x").collect()]), 3, 8.0).tolist() == got


def test_subset_reference_removes_the_old_reference(spark):
    rng = np.random.default_rng(3)
    raw = {("r", c): rng.normal(size=8) for c in dims.CANON}
    s = samples(spark, raw)
    mc = dims.montage_channel(spark)
    key = lambda d: {(r["montage"], r["channel"], r["t"]): r["x"] for r in d.collect()}
    a = key(ch.subset_referenced(s, mc))
    b = key(ch.subset_referenced(ch.average_referenced(s), mc))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12
    assert {r["montage"] for r in ch.all_montages(s).select("montage").distinct().collect()} == set(dims.MONTAGES)


def test_windows_reject_and_fall_back(spark):
    quiet, loud = np.tile([0, 1], 8), np.tile([0, 9], 8)
    s = samples(spark, {("mixed", "a"): np.r_[quiet, loud, quiet, [0] * 5], ("bad", "a"): np.r_[loud, loud * 2, loud * 3],
                        ("short", "a"): [1, 2, 3]})
    ptp = wn.window_ptp(s, 16)
    out = {}
    for r in wn.accepted(ptp, 2.0, 2).collect():
        out.setdefault(r["rec"], []).append((r["win"], r["rejected"]))
    assert sorted(out["mixed"]) == [(0, 1), (2, 1)] and sorted(out["bad"]) == [(0, 1), (1, 1)] and "short" not in out


def test_units_and_flat_channels(spark):
    rng = np.random.default_rng(4)
    s = samples(spark, {("uv", "a"): rng.normal(size=50) * 3, ("uv", "b"): np.zeros(50), ("uv", "c"): np.zeros(50),
                        ("volt", "a"): rng.normal(size=50) * 3e-6})
    u = {r["rec"]: r for r in ql.units(s, hot=False).collect()}
    assert u["uv"]["unit_factor"] == 1e-6 and u["uv"]["low_density"] and u["uv"]["n_live"] == 1
    assert u["volt"]["unit_factor"] == 1.0
    assert {r["rec"]: r["n_flat"] for r in ql.flat_channels(s).collect()} == {"uv": 2, "volt": 0}


def test_amplitude_collapse_stops_the_job(spark):
    a = samples(spark, {("r", "a"): np.arange(20.0)})
    ok = ql.amplitude_ratio(a, a.withColumn("x", F.col("x") * 0.5), hot=False)
    assert ok.first()["ok"]
    with pytest.raises(Exception, match="amplitude collapsed"):
        ql.amplitude_ratio(a, a.withColumn("x", F.col("x") * 1e-3), hot=False).collect()


def test_robust_scale_of_a_flat_channel_is_zero(spark):
    s = samples(spark, {("r", "a"): [5.0] * 6, ("r", "b"): [1.0, 2, 3, 4, 5, 6]})
    out = ql.robust_scaled(s, ["rec", "channel"], hot=False).collect()
    assert all(r["scaled"] == 0 for r in out if r["channel"] == "a")
    assert max(r["scaled"] for r in out if r["channel"] == "b") == 1.0


def test_differences_cross_block_borders(spark):
    x = np.random.default_rng(5).normal(size=37)
    s = samples(spark, {("r", "a"): x})
    out = {r["t"]: r for r in op.differences(s, ["rec", "channel"], "t", "x", block=5).collect()}
    assert len(out) == 37 and out[0]["d1"] is None and out[1]["d2"] is None
    for t in range(2, 37):
        assert abs(out[t]["d1"] - (x[t] - x[t - 1])) < 1e-12 and abs(out[t]["d2"] - (x[t] - 2 * x[t - 1] + x[t - 2])) < 1e-12


def test_condition_grid_has_42_conditions(spark):
    from tidemark.plans.spine import condition_grid
    g = condition_grid(spark)
    assert g.count() == 42 and g.select("cond").distinct().count() == 42
    with pytest.raises(ValueError, match="unknown sites"):
        dims.check_sites("x", ["T5", "T9"])


def test_sweep_derives_the_same_signals_as_the_montage_operator(spark):
    from tidemark.operators import sweep as sw
    rng = np.random.default_rng(8)
    raw = {("r", c): rng.normal(size=8) for c in dims.CANON}
    want = {(r["montage"], r["channel"], r["t"]): r["x"] for r in ch.all_montages(samples(spark, raw)).collect()}
    x = np.stack([raw["r", c] for c in sorted(dims.CANON)])[None]
    n = 0
    for m in dims.MONTAGES:
        matrix, names = sw.mixing(sorted(dims.CANON), m)
        sig = matrix @ x[0]
        for i, c in enumerate(names):
            for t in range(8):
                assert abs(sig[i, t] - want[m, c, t]) < 1e-12
                n += 1
    assert n == len(want)
    assert sw.mixing(["Fp1", "Fp2", "F7"], "b4") is None
    assert len(sw.conditions(256, dims.RATES, dims.DEPTHS)) == 40
    assert len(sw.conditions(256, dims.RATES, dims.DEPTHS, True)) == 42


def test_sweep_cube(spark):
    from tidemark.operators import sweep as sw
    rng = np.random.default_rng(9)
    s = samples(spark, {(r, c): rng.normal(size=700) for r in ("a", "b") for c in dims.CANON})
    out = sw.swept(s, 256, 64, 100.0, 2, [64, 32], [None, 8], 20.0)
    rows = {(r["cond"], r["rec"]): r for r in out.collect()}
    assert {r["n_windows"] for r in rows.values()} == {2}
    assert rows["b1|64|f32|full", "a"]["asymmetry_alpha"] is None
    assert rows["b19|64|f32|full", "a"]["ap_gradient_alpha"] is not None
    assert rows["b19|32|f32|full", "a"]["rel_beta"] is None and rows["b19|64|f32|full", "a"]["rel_beta"] is not None


def test_displaced_against_a_loop_with_gaps_and_null_keys(spark):
    rows = [(rec, c, t, float(10 * i + t)) for rec in ("a", None) for i, c in enumerate(("T5", "O1", "Cz")) for t in range(4) if not (c == "O1" and t == 2)]
    rows += [("a", None, 0, 5.0), ("b", "T5", 0, 1.0)]
    s = spark.createDataFrame(rows, "rec string, channel string, t bigint, x double")
    edges = spark.createDataFrame([(r, *e) for r in ("a", None) for e in (("T5", "O1"), ("O1", "T5"))], "rec string, channel string, neighbour string")
    at = {(r, c, t): x for r, c, t, x in rows}
    want = {(r, c, t): 0.75 * at[r, c, t] + 0.25 * at[r, n, t] for r in ("a", None) for c, n in (("T5", "O1"), ("O1", "T5")) for t in (0, 1, 3)}
    moved = ch.displaced(s, edges, 0.25)
    assert {(r["rec"], r["channel"], r["t"]): r["x"] for r in moved.collect()} == want


def test_budget_grid_makes_every_rate_in_one_pass(spark):
    x = np.random.default_rng(3).normal(size=(3, 64))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "k int, x array<double>")
    bits = dims.table(spark, [(None,), (8,)], "bits")
    out = dg.with_budget(df, 64, [64, 32, 16], bits, 8.0, (2.0, 20.0))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r["k"], r["rate"], r["bits"]): r["x"] for r in out.collect()}
    assert len(got) == 18
    for i, row in enumerate(dg.restrict_rows(x, 64, 2.0, 20.0)):
        for rate in (64, 32, 16):
            for b in (None, 8):
                assert np.allclose(got[i, rate, b], dg.converted_rows(dg.decimate_rows(row[None], 64 // rate), b, 8.0)[0])


def test_correlations_of_recordings_with_one_channel(spark):
    """A batch that holds instants of one channel only gives no pair and does not stop the job."""
    draw = np.random.default_rng(4)
    rows = samples(spark, {("one", "T5"): draw.normal(size=30), ("two", "T5"): draw.normal(size=40), ("two", "T6"): draw.normal(size=25)})
    got = {(r.rec, r.a, r.b): r.r for r in ql.channel_correlations(rows.coalesce(1)).collect()}
    x, y = ([r.x for r in rows.filter(f"rec = 'two' AND channel = '{c}' AND t < 25").orderBy("t").collect()] for c in ("T5", "T6"))
    assert set(got) == {("two", "T5", "T6"), ("two", "T6", "T5")}
    assert abs(got["two", "T5", "T6"] - np.corrcoef(x, y)[0, 1]) < 1e-12


def test_bipolar_query_returns_every_sample(spark):
    """One row an instant and pair, not a summary of a recording."""
    from tidemark.plans import recordings
    got = recordings.m03(spark, "/root/testdata/sf0.001")
    assert {"montage", "rec", "t", "channel", "x"} == set(got.columns)
    assert got.count() == got.select("montage", "rec", "t", "channel").distinct().count() > got.select("montage", "rec", "channel").distinct().count()


def test_subset_reference_shuffles_samples_not_montages(spark):
    sites, times = ("T5", "T6", "O1", "Cz", None), (0, 1, 5000)
    data = [(1, c, t, None if (i + j) % 4 == 0 else float(7 * i * i + j)) for i, c in enumerate(sites) for j, t in enumerate(times)] + [(None, "O1", None, 3.0)]
    s = spark.createDataFrame(data, "rec int, channel string, t bigint, x double")
    car = {"p": ["T5", "O1", "F3"], "q": ["T6", "Cz"], "r": ["O1"]}
    registry = spark.createDataFrame([(m, "subset_car", c) for m, cs in car.items() for c in cs] + [("z", "bipolar", "O1")], "montage string, ref string, channel string")
    out = ch.subset_referenced(s, registry)
    shuffles = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line and "rec#" in line]
    assert shuffles and not any("montage" in line for line in shuffles)
    want = []
    for m, cs in car.items():
        for rec, t in {(r, t) for r, _, t, _ in data}:
            own = [(c, x) for r, c, u, x in data if (r, u) == (rec, t) and c in cs]
            known = [x for _, x in own if x is not None]
            want += [(m, rec, t, c, None if x is None else round(x - sum(known) / len(known), 9)) for c, x in own]
    got = [(r.montage, r.rec, r.t, r.channel, None if r.x is None else round(r.x, 9)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_correlations_of_many_recordings_read_the_samples_once(spark, hot):
    """Whole recordings in a task, or instants in order; gaps, nulls, flat and unnamed channels, far offsets and null recordings as by hand."""
    draw = np.random.default_rng(8)
    data = {}
    for rec in [None, *range(40)]:
        common = draw.normal(size=30)
        for i, c in enumerate(("T5", "O1", "T6")):
            for t in range(30):
                if (t + i) % 7 and not (rec == 3 and c == "T6"):
                    data[rec, c, t] = None if (t * 3 + i) % 11 == 0 else 4.0 if rec == 5 and c == "O1" else float(1e6 + common[t] * i + draw.normal())
    rows = [(*k, v) for k, v in data.items()] + [(1, None, 2, 9.0)] * (not hot)
    out = ql.channel_correlations(spark.createDataFrame(rows, "rec int, channel string, t bigint, x double"), hot)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") + plan.count("FlatMapGroupsInArrow") == 1 and ("rangepartitioning" in plan) == hot
    got = {(r.rec, r.a, r.b): r.r for r in out.collect()}
    want = {}
    for rec in [None, *range(40)]:
        for a in ("T5", "O1", "T6"):
            for b in ("T5", "O1", "T6"):
                pairs = [(data[rec, a, t], data[rec, b, t]) for t in range(30) if data.get((rec, a, t)) is not None and data.get((rec, b, t)) is not None]
                if a != b and pairs:
                    x, y = np.array(pairs).T
                    want[rec, a, b] = None if rec == 5 and "O1" in (a, b) else np.corrcoef(x, y)[0, 1]
    assert got.keys() == want.keys() and len(want) == 6 * 40 + 2
    assert all(got[k] is None if w is None else abs(got[k] - w) < 1e-8 for k, w in want.items())
    blocks = spark.createDataFrame([("t", "T5"), ("t", "T6"), ("o", "O1")], "block string, channel string")
    plan = ql.block_structure(out, blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") + plan.count("FlatMapGroupsInArrow") == 1
