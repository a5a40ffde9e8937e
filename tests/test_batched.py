import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import batched as bt
from tidemark.operators import models as ml
from tidemark.operators import rankstats as rs
from tidemark.operators import resample as rp


def sample(n=160, d=3, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)) * [1, 50, 0.01][:d] + [0, 400, 3][:d]
    y = (draw.random(n) < 1 / (1 + np.exp(-(x[:, 0] - (x[:, 1] - 400) / 50)))).astype(int)
    return x, y


def single(x, y, mask):
    return ml._fit_one("logistic", x[mask], y[mask].astype(float), 1.0, 1.0)


def test_masks_like_single_fits():
    x, y = sample()
    draw = np.random.default_rng(1)
    masks = draw.random((160, 40)) < draw.uniform(0.1, 0.9, 40)
    masks[:, 0] = y == 1  # one class
    masks[:, 1] = False
    x[masks[:, 2], 2] = 3.0  # a constant column under one mask
    b0, coef, fine = bt.fit_masks(x, y, masks)
    assert np.isnan(b0[:2]).all() and not fine[:2].any() and fine[2:].all()
    for j in range(2, 40):
        want = single(x, y, masks[:, j])
        assert abs(b0[j] - want[0]) < 1e-8 * (1 + abs(want[0])) and np.allclose(coef[j], want[1], rtol=1e-7, atol=1e-8)


def test_own_labels_and_small_batches(monkeypatch):
    x, y = sample()
    labels = np.stack([np.roll(y, j) for j in range(12)], axis=1)
    masks = np.ones((160, 12), bool)
    whole = bt.fit_masks(x, labels, masks)
    monkeypatch.setattr(bt, "CELLS", 500)
    for got in (whole, bt.fit_masks(x, labels, masks)):
        for j in range(12):
            want = single(x, labels[:, j], masks[:, j])
            assert abs(got[0][j] - want[0]) < 1e-7 and np.allclose(got[1][j], want[1], rtol=1e-7, atol=1e-8)


def test_separable_rows_stay_finite():
    x = np.r_[np.zeros(20), np.ones(20)][:, None]
    y = np.r_[np.zeros(20, int), np.ones(20, int)]
    b0, coef, fine = bt.fit_masks(x, y, np.ones((40, 1), bool))
    want = single(x, y, np.ones(40, bool))
    assert fine[0] and np.allclose([b0[0], coef[0, 0]], [want[0], want[1][0]], rtol=1e-7)


@pytest.fixture(scope="module")
def frame(spark):
    x, y = sample(200)
    rows = [(["a", "b", None][i % 3], i, int(y[i]), [float(v) for v in x[i]], [float(v) + 0.1 for v in x[i][:2]], bool(i % 5), bool(i % 2)) for i in range(200)]
    return spark.createDataFrame(rows, "g string, id long, y int, x array<double>, v array<double>, most boolean, half boolean")


def test_arms_and_subsets(frame, spark, small_limits):
    """The batch, the passes of large groups, and one out-of-fold run after the other agree; null keys are a group."""
    arms, subsets = {"one": "x", "two": "v", "shifted": ("x", "x")}, ["most", "half"]
    ways = [bt.cross_validated(frame, ["g"], "id", "y", arms, subsets, 3, 2, large, hot=False) for large in (False, True, None)]
    got = [{r["id"]: r for r in w.collect()} for w in ways]
    for s in subsets:
        for a, x in (("one", "x"), ("two", "v")):
            oof = ml.out_of_fold(frame.where(s), ["g"], "id", "y", x, 3, 2, hot=False, large=False)
            want = {r["id"]: r["s"] for r in ml.rank_mean(oof, ["g"], "id", "y", False).collect()}
            for rows in got:
                assert len(rows) == 200
                assert all(abs(rows[i][f"{s}_{a}"] - v) < 1e-9 for i, v in want.items())
                assert sum(r[f"{s}_{a}"] is not None for r in rows.values()) == len(want)
    assert all(len(r["repeats"]) == 6 and all(len(e) == 2 for e in r["repeats"]) for rows in got for r in rows.values())


def test_shifted_design(frame):
    got = {r["id"]: r["s"] for r in bt.cross_validated(frame.withColumn("w", F.transform("x", lambda e: F.rint(e))), ["g"], "id", "y", {"s": ("x", "w")}, (), 4, 2).collect()}
    oof = ml.out_of_fold(frame.withColumn("w", F.transform("x", lambda e: F.rint(e))), ["g"], "id", "y", "x", 4, 2, score_x="w")
    want = {r["id"]: r["s"] for r in ml.rank_mean(oof, ["g"], "id", "y", False).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("carried", [None, "c"])
def test_permutations_like_copies(frame, carried):
    """Against permuted copies of the rows, each cross-validated on its own."""
    rows = frame.withColumn("c", F.col("id") % 7 / 3.0).withColumn("x2", F.slice("x", 1, 2))
    got = {r["perm"]: r["auc"] for r in bt.permuted_aucs(rows, "id", "y", "x2", 5, "seed", carried, 3, 2, chunk=2).collect()}
    moved = rp.permuted(rows.select("id", "y", "c", "x2"), [], "id", ["y", "c"], 5, "seed")
    every = rows.select("id", "y", "c", "x2").withColumn("perm", F.lit(-1)).unionByName(moved)
    x = F.concat("x2", F.array("c")) if carried else F.col("x2")
    oof = ml.out_of_fold(every.withColumn("x", x).select("perm", "id", "y", "x"), ["perm"], "id", "y", "x", 3, 2)
    want = {r["perm"]: r["auc"] for r in rs.auc(ml.rank_mean(oof, ["perm"], "id", "y"), ["perm"], "y", "s").collect()}
    assert got.keys() == want.keys() == set(range(-1, 5))
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("carried", [None, "c"])
def test_permutations_by_passes_like_one_task(spark, small_limits, carried):
    x, y = sample(90)
    rows = spark.createDataFrame([(i, int(y[i]), x[i][:2].tolist(), float(x[i][2])) for i in range(90)], "id long, y int, v array<double>, c double")
    got = {large: {r["perm"]: r["auc"] for r in bt.permutation_aucs(rows, "id", "y", "v", 4, "seed", carried, 3, 2, large).collect()} for large in (True, False)}
    assert sorted(got[True]) == sorted(got[False]) == [-1, 0, 1, 2, 3]
    assert max(abs(got[True][p] - got[False][p]) for p in got[True]) < 1e-6


def test_permuted_rows_are_not_sent_to_every_task(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i)) for i in range(40)], "id long, y int, b double")
    got = rp.permuted(rows, [], "id", ["y", "b"], 6, "seed", False)
    assert got.columns == ["id", "perm", "y", "b"]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    for p in range(6):
        own = [(r.id, r.b) for r in got.filter(f"perm = {p}").collect()]
        assert sorted(i for i, _ in own) == list(range(40)) and sorted(b for _, b in own) == [float(i) for i in range(40)]


def test_wide_rows_are_taken_in_pieces():
    """What a task holds of wide rows is bounded by their entries, not by their number."""
    x = np.arange(1000 * 9000, dtype=float).reshape(1000, 9000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), bt._lists(x, 9000), bt._lists(np.ones((1000, 1)), 1)], ["g", "x", "y"])
    cut = ml.pieces(batch, ("x", "y"))
    assert len(cut) > 2 and max(p.num_rows for p in cut) * 9001 <= ml.CELLS_AT_ONCE
    assert [i for p in cut for i in p["g"].to_pylist()] == list(range(1000))
    assert np.array_equal(np.vstack([ml._matrix(pa.Table.from_batches([p])["x"]) for p in cut]), x)
    assert ml.pieces(batch.slice(0, 0), ("x", "y")) == []


def test_arms_of_a_wide_group_are_ranked_apart(spark, monkeypatch):
    draw = np.random.default_rng(5)
    d = draw.integers(0, 9, (80, 6)).astype(float)
    d[3, 1] = np.nan
    rows = [(i % 2, None if i == 7 else f"s{i}", i % 3, [None if np.isnan(v) else float(v) for v in d[i]]) for i in range(80)]
    decided = spark.createDataFrame(rows, "g int, sid string, label int, d array<double>")
    whole = sorted(map(str, bt.ranked_decisions(decided, 3, 2).collect()))
    monkeypatch.setattr(bt, "CELLS", 100)
    apart = bt.ranked_decisions(decided, 3, 2)
    plan = apart._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow [g#" in plan and plan.count("FlatMapGroupsInArrow") == 1 and ", b#" in plan.split("FlatMapGroupsInArrow [")[1].split("]")[0]
    assert sorted(map(str, apart.collect())) == whole


def test_a_group_is_handed_over_as_arrow(frame):
    """Arms as Python objects took several times the room of their numbers."""
    plan = bt.cross_validated(frame, ["g"], "id", "y", {"one": "x", "two": "v"}, (), 3, 2, large=False)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "InPandas" not in plan


def test_oof_scores_average_over_the_repeats_that_have_a_model(spark, small_limits):
    """As one out-of-fold run after the other, in all ways; group a has one case only, group b none."""
    from tidemark.plans.modelling import oof_scores
    x, y = sample(90)
    rows = [("a" if i < 24 else "b" if i < 40 else None, i, int(i == 5) if i < 24 else 0 if i < 40 else int(y[i]), x[i].tolist()) for i in range(90)]
    rows = spark.createDataFrame(rows, "g string, id long, y int, x array<double>")
    oof = ml.out_of_fold(rows, ["g"], "id", "y", "x", 4, 3, hot=False, large=False)
    want = {r["id"]: r["s"] for r in ml.rank_mean(oof, ["g"], "id", "y", False).collect()}
    assert 0 < sum(i < 24 for i in want) and not any(24 <= i < 40 for i in want)
    seen = {r["id"]: r["n"] for r in oof.groupBy("id").count().withColumnRenamed("count", "n").collect()}
    assert 0 < min(seen.values()) < 3
    spark.conf.set("spark.tidemark.hotGroupRows", "1000")
    for large, hot in ((False, False), (True, None), (None, None), (True, "ranges")):
        if hot == "ranges":
            spark.conf.set("spark.tidemark.hotGroupRows", "5")
        got = oof_scores(rows, ["g"], "id", 4, 3, hot=None if hot == "ranges" else hot, large=large)
        assert got.columns == ["g", "id", "y", "s"]
        got = {r["id"]: r["s"] for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want), (large, hot)


def test_oof_scores_keep_one_row_a_subject(spark, frame):
    """The rows of the design are stored as they are, not once a repeat."""
    from tidemark.plans.modelling import oof_scores
    plan = oof_scores(frame.select("g", "id", "y", "x"), ["g"], "id", large=False)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_groups_are_dealt_and_ranked_in_a_task_or_by_ranges(frame, spark, small_limits, monkeypatch):
    """Designs of shared parts, carried columns and AUCs of repeats: the same from one task, from passes, and from ranges; no row is copied by arm or repeat."""
    rows = frame.withColumns({"c": F.col("id") / 3, "w": F.concat("x", F.reverse("v")), "r": F.reverse("v")})
    picks = {("a",): [0, 2], ("b",): [1, 2], (None,): [0, 1]}
    parts = {"one": "x", "both": ["x", "r"], "some": [("x", picks), "r"], "moved": (["x", "v"], ["x", "r"])}
    arrays = rows.withColumns({"some": F.concat(F.when(F.col("g") == "a", F.array(F.get("x", 0), F.get("x", 2))).when(F.col("g") == "b", F.array(F.get("x", 1), F.get("x", 2)))
                                                .otherwise(F.array(F.get("x", 0), F.get("x", 1))), "r"), "xv": F.concat("x", "v"), "xr": F.concat("x", "r")})
    plain = {"one": "x", "both": "w", "some": "some", "moved": ("xv", "xr")}
    want = bt.cross_validated(arrays, ["g"], "id", "y", plain, ["most", "half"], 3, 2, False)
    names = [f"{s}_{a}" for s in ("most", "half") for a in parts]
    spread = {(r["g"], r["arm"]): r["auc_sd"] for r in bt.repeat_spread(want, ["g"], "y", names).collect()}
    want = {r["id"]: r for r in want.collect()}
    for large, cells in ((False, None), (True, None), (None, None), (True, 1)):
        if cells:
            monkeypatch.setattr(bt, "TASK_CELLS", cells)
        out = bt.cross_validated(rows, ["g"], "id", "y", parts, ["most", "half"], 3, 2, large, carry=["c"], keep="aucs")
        if cells is None:
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Generate" not in plan and "Window" not in plan
        assert out.columns == ["g", "id", "y", "c", *names, "aucs"]
        got = out.collect()
        assert len(got) == 200 and sum(r["aucs"] is not None for r in got) == 3
        for r in got:
            assert r["c"] == r["id"] / 3
            assert all((r[n] is None) == (want[r["id"]][n] is None) and (r[n] is None or abs(r[n] - want[r["id"]][n]) < 1e-9) for n in names)
        assert {(r["g"], r["arm"]) for r in bt.repeat_spread(out, ["g"], "y", names).collect()} == spread.keys()
        for r in bt.repeat_spread(out, ["g"], "y", names).collect():
            assert abs(r["auc_sd"] - spread[r["g"], r["arm"]]) < 1e-9
    assert "repeats" not in bt.cross_validated(rows, ["g"], "id", "y", parts, [], 3, 2, True, keep=None).columns


def test_usable_arrays_like_feature_rows(spark):
    from tidemark.plans.modelling import usable_arrays, usable_long
    from tidemark.plans.registry import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    want = ml.feature_array(usable_long(t), ["cond", "subject"]).collect()
    got = usable_arrays(t).collect()
    assert len(got) > 100 and {(r.cond, r.subject): r.x for r in got} == {(r.cond, r.subject): r.x for r in want}


def test_cohort_scores_keep_no_decisions_and_share_their_columns(spark):
    """Against arms that are arrays of their own; the covariate stays with its row instead of being joined to it."""
    from tidemark.plans.inference import cohort_scores
    from tidemark.plans.modelling import design
    from tidemark.plans.registry import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    g, arms = ["cohort", "cond", "contrast"], ("age_cv", "full", "full_both", "three", "three_both")
    s = cohort_scores(t, False)
    assert s.columns == [*g, "subject", "y", "age", *arms]
    assert "Join" not in s._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    age = F.array(F.col("age") / 25)
    rows = design(t).withColumns({"age_cv": age, "full": F.col("x"), "full_both": F.col("both"), "three": F.slice("x", 1, 3), "three_both": F.concat(F.slice("x", 1, 3), age)})
    key = lambda r: (r.cohort, r.cond, r.contrast, r.subject)
    want = {key(r): r for r in bt.cross_validated(rows, g, "subject", "y", {a: a for a in arms}, large=False).collect()}
    ages = {key(r): r.age for r in rows.collect()}
    got = {key(r): r for r in s.collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for k, r in got.items():
        assert r.age == ages[k] and all(r[a] == want[k][a] for a in arms)
