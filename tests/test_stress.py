"""The stress cube against a loop over recordings, and its defined results on awkward input."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.operators import degrade as dg
from tidemark.operators import stress as st

RATE, LENGTH, LIMIT, SCALE = 96, 64, 6.0, 8.0
FAULTS = {n: (move, drop, max(1, quota // 6), divisor, bits) for n, (move, drop, quota, divisor, bits) in dims.STRESS.items()}


def h32(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def recording(seed, windows, loud=(), sites=dims.CANON):
    x = np.random.default_rng(seed).normal(size=(len(sites), windows * LENGTH))
    for w in loud:
        x[:, w * LENGTH:(w + 1) * LENGTH] *= 5
    return dict(zip(sites, x))


def rows_of(data, rec):
    return [(rec, c, t, float(v)) for c, x in data.items() for t, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "rec string, channel string, t bigint, x double")


def faulted(data, rec, name, montage):
    """What the montage records, by loops over its sites: signals by name."""
    move, drop, _, _, _ = FAULTS[name]
    sites = list(dims.MONTAGES[montage][0])
    got = {s: data[s] for s in sites}
    if move:
        for s in sites:
            near = [n for n in dims.NEIGHBOURS[s] if n in data]
            if near:
                got[s] = (1 - move) * data[s] + move * data[near[h32(rec, f"{name}|displace", s) % len(near)]]
    if drop:
        got.pop(sites[h32(rec, f"contact|{montage}") % len(sites)])
    mean = np.mean(list(got.values()), axis=0)
    return {s: v - mean for s, v in got.items()}


def expected(data, rec, name, montage):
    """Windows kept under a fault, and the median over them of the mean mobility of the channels."""
    _, _, quota, divisor, bits = FAULTS[name]
    signals = np.stack(list(faulted(data, rec, name, montage).values()))
    cut = signals[:, :signals.shape[1] // LENGTH * LENGTH].reshape(len(signals), -1, LENGTH)
    ptp = (cut.max(axis=2) - cut.min(axis=2)).max(axis=0)
    ok = [w for w in range(len(ptp)) if ptp[w] <= LIMIT]
    order = sorted(ok, key=lambda w: hashlib.md5(f"{rec}|{w}".encode()).hexdigest()) if ok else sorted(range(len(ptp)), key=lambda w: ptp[w])
    kept = order[:quota]
    mob = []
    for w in kept:
        y = dg.converted_rows(dg.decimate_rows(cut[:, w], divisor), bits, SCALE)
        mob.append(np.mean(np.sqrt(np.diff(y, axis=1).var(axis=1) / y.var(axis=1))))
    return len(kept), float(np.median(mob))


def cube(spark, rows, montages=("b19", "b4")):
    out = st.stressed(frame(spark, rows), LENGTH, RATE, LIMIT, SCALE, montages, FAULTS)
    return {(r["cond"], r["rec"]): r for r in out.collect()}


def test_equals_a_loop_over_recordings(spark):
    data = {"a": recording(1, 7, loud=(0, 3)), "b": recording(2, 9), "loud": recording(3, 6, loud=range(6))}
    got = cube(spark, [r for k, d in data.items() for r in rows_of(d, k)])
    assert set(got) == {(f"{f}|{m}", k) for f in FAULTS for m in ("b19", "b4") for k in data}
    for (cond, rec), row in got.items():
        n, mob = expected(data[rec], rec, *cond.split("|"))
        assert row["n_windows"] == n, (cond, rec)
        assert row["hjorth_mobility"] == pytest.approx(mob, rel=1e-9), (cond, rec)
    # Faults choose windows of their own: some of them must differ from the clean choice.
    assert len({got["clean|b4", "a"]["hjorth_mobility"], got["displace50|b4", "a"]["hjorth_mobility"], got["contact_drop|b4", "a"]["hjorth_mobility"]}) == 3


def test_montages_share_the_move_of_an_electrode():
    faults = st.checked(FAULTS, ("b19", "b4"), RATE)
    draws = tuple(range(4 * len(dims.CANON) + 2))
    big, names = st.fault_matrix(dims.CANON, "b19", "displace100", faults, ("b19", "b4"), draws)
    small, few = st.fault_matrix(dims.CANON, "b4", "displace100", faults, ("b19", "b4"), draws)
    for i, s in enumerate(few):
        j = names.index(s)
        for k in range(len(few)):  # differences of two sites are free of the reference
            assert np.allclose(small[i] - small[k], big[j] - big[names.index(few[k])])


def test_missing_sites_unknown_samples_and_short_recordings(spark):
    part = recording(4, 3, sites=["T5", "T6", "O1", "O2"])
    hole = rows_of(recording(5, 3), "hole")
    hole = [(r, c, t, None if c == "O1" and t == 5 else x) for r, c, t, x in hole]
    short = rows_of(recording(6, 1), "short")[:-1]  # one site lacks a sample: no complete window
    got = cube(spark, rows_of(part, "part") + hole + short)
    assert {k for k in got if k[1] == "part"} == {(f"{f}|b4", "part") for f in FAULTS}
    assert not [k for k in got if k[1] == "short"]
    # The unknown sample is in the first window, so two are left for any montage that holds O1.
    assert got["clean|b19", "hole"]["n_windows"] == 2 and got["clean|b4", "hole"]["n_windows"] == 2
    row = got["displace50|b4", "part"]
    n, mob = expected(part, "part", "displace50", "b4")
    assert (row["n_windows"], row["hjorth_mobility"]) == (n, pytest.approx(mob, rel=1e-9))


def test_null_recording_and_empty_table(spark):
    data = recording(7, 4)
    got = cube(spark, rows_of(data, None) + rows_of(recording(8, 4), "x"), ("b4",))
    assert {k for k in got if k[1] is None} == {(f"{f}|b4", None) for f in FAULTS}
    assert got["clean|b4", None]["n_windows"] == 4
    assert cube(spark, []) == {}


def test_integer_recordings_with_a_null(spark):
    data = recording(9, 3)
    rows = [(r, c, t, float(v)) for r in (None, 2 ** 60 + 1) for c, x in data.items() for t, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "rec bigint, channel string, t bigint, x double")
    out = st.stressed(samples, LENGTH, RATE, LIMIT, SCALE, ("b4",), FAULTS)
    assert {r["rec"] for r in out.select("rec").distinct().collect()} == {None, 2 ** 60 + 1}


def test_bipolar_montage_has_no_lead_to_drop(spark):
    with pytest.raises(ValueError):
        st.stressed(frame(spark, []), LENGTH, RATE, LIMIT, SCALE, ("b1",), FAULTS)


def test_quota_is_a_row_limit_inside_tasks(spark):
    rows = [("plain", "b4", "a", w, w / 100) for w in range(1000)]
    ptp = spark.createDataFrame(rows, "mix string, montage string, rec string, win bigint, ptp double")
    plan = st.chosen(ptp, st.checked(FAULTS, ("b4",), RATE), LIMIT)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stress_scores_take_known_features_of_shared_columns(spark, monkeypatch):
    """Like designs of their own in which unknown features are 0; a feature is unknown under one fault, others only under clean or for one contrast."""
    from tidemark.operators import batched as bt
    from tidemark.plans import stress as ps
    from tidemark.plans.registry import Tables
    draw, n = np.random.default_rng(2), 60
    data = []
    for contrast in ps.T_CONTRASTS:
        for rec in range(n):
            base = draw.normal(size=len(dims.FEATURES)) + rec % 2
            for k, fault in enumerate(ps.T_STRESS):
                v = [float(e) for e in base + draw.normal(size=len(base)) * k / 5]
                lost = [2] if fault == "short3" else [4] if fault == "clean" else [5] if contrast == "dementia" and rec == 7 else []
                if not (rec == 11 and fault == "short6"):
                    data.append((contrast, "b4", fault, rec, rec % 2 if rec % 5 else 1, float(rec % 9), *[None if i in lost else e for i, e in enumerate(v)]))
    cube = spark.createDataFrame(data, "contrast string, montage string, fault string, rec int, y int, age double, " + ", ".join(f"{f} double" for f in dims.FEATURES)).cache()
    monkeypatch.setattr(ps, "table_cube", lambda t: cube)
    seen = {}
    real = bt.cross_validated
    monkeypatch.setattr(bt, "cross_validated", lambda rows, *a, **k: seen.update(rows=rows) or real(rows, *a, **k))
    s = ps.stress_scores(Tables(spark, "/root/testdata/sf0.001"), False)
    assert sum(c.startswith("x_") for c in seen["rows"].columns) == len(ps.T_STRESS) and len(seen["rows"].columns) == len(ps.T_STRESS) + 6
    got = {(r.contrast, r.rec): r for r in s.collect()}
    assert len(got) == 2 * (n - 1)
    by = {(r.contrast, r.fault, r.rec): r for r in cube.collect()}
    for contrast in ps.T_CONTRASTS:
        known = {f: [all(r[d] is not None for (c, g, _), r in by.items() if (c, g) == (contrast, f)) for d in dims.FEATURES] for f in ps.T_STRESS}
        assert not all(known["short3"]) and not all(known["clean"])
        recs = [i for i in range(n) if i != 11]
        for fault in ("short3", "mix_severe"):
            for fit, at, on, arm in ((fault, fault, known[fault], f"{fault}:device_age"), ("clean", fault, [a and b for a, b in zip(known["clean"], known[fault])], f"{fault}:clinic")):
                made = [[[by[contrast, g, i][d] if k else 0.0 for d, k in zip(dims.FEATURES, on)] + ([i % 9 / 25] if arm.endswith("_age") else []) for i in recs] for g in (fit, at)]
                rows = spark.createDataFrame([("g", i, by[contrast, fault, i].y, a, b) for i, a, b in zip(recs, *made)], "g string, id int, y int, a array<double>, b array<double>")
                want = {r.id: r.s for r in real(rows, ["g"], "id", "y", {"s": ("a", "b")}, large=False).collect()}
                assert all(abs(got[contrast, i][arm] - want[i]) < 1e-9 for i in recs), (contrast, arm)
    assert all(r.age == r.rec % 9 for r in got.values())


def test_recordings_with_equal_choices_share_a_matrix(monkeypatch):
    """Every draw differs, the choices are few; signals as by a matrix of each recording's own."""
    faults, names = {n: st.Fault(*f) for n, f in dims.STRESS.items()}, ["Cz", "Fp1", "Fp2", "O1", "O2", "T5", "T6"]
    draw, montages = np.random.default_rng(6), ["b4", "muse"]
    draws = [draw.integers(0, 2 ** 32, 19 * sum(bool(f.share) for f in st.mixes(faults).values()) + 2) for _ in range(400)]
    x, real, made = draw.normal(size=(400, 7, 16)), st.fault_matrix, []
    monkeypatch.setattr(st, "fault_matrix", lambda *a: made.append(1) or real(*a))
    for montage in ("b4", "muse"):
        for mix in st.mixes(faults):
            made.clear()
            got = st._mixed(names, draws, x, montage, mix, faults, montages)
            if got is None:
                assert real(names, montage, mix, faults, montages, draws[0]) is None
                continue
            assert len(made) <= 200
            for i in range(0, 400, 9):
                matrix, signals = real(names, montage, mix, faults, montages, draws[i])
                assert np.allclose(got[0][i], matrix @ x[i]) and list(got[1][i]) == signals
