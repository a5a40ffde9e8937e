import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.draws import poisson_bounds
from tidemark.operators import bootstrap as bs


def weight(seed, sid, replicate):
    text = f"{seed}|{replicate // 4}" + ("" if sid is None else f"|{sid}")
    draw = hashlib.md5(text.encode()).hexdigest()[8 * (replicate % 4):][:8]
    return sum(draw >= b for b in poisson_bounds())


def rows(n=150):
    draw = np.random.default_rng(8)
    return [(draw.choice(["a", None]), int(i), int(draw.integers(0, 2)), float(draw.integers(0, 6)), None if i % 11 == 0 else float(draw.normal())) for i in range(n)]


SCHEMA = "g string, id long, y int, s double, t double"


def brute_auc(some, score, n, seed):
    out = {}
    for g in {r[0] for r in some}:
        own = [r for r in some if r[0] == g and r[score] is not None]
        for b in range(n):
            w = [weight(seed, r[1], b) for r in own]
            p, q = sum(x for x, r in zip(w, own) if r[2] == 1), sum(x for x, r in zip(w, own) if r[2] == 0)
            u = sum(x * v * ((r[score] > o[score]) + 0.5 * (r[score] == o[score])) for x, r in zip(w, own) if r[2] == 1 for v, o in zip(w, own) if o[2] == 0)
            out[g, b] = u / (p * q) if p and q else None
    return out


@pytest.mark.parametrize("digests", [10**9, 40])
def test_aucs_brute_force(spark, monkeypatch, digests):
    """One range, then so many that ties are cut by borders; null keys are a group."""
    monkeypatch.setattr(bs, "DIGESTS", digests)
    monkeypatch.setattr(bs, "BLOCK", 7)
    some = rows()
    got = bs.aucs(spark.createDataFrame(some, SCHEMA), ["g"], "id", "y", ["s", "t"], 10, "seed").collect()
    for arm, at in (("s", 3), ("t", 4)):
        want = brute_auc(some, at, 10, "seed")
        own = {(r["g"], r["replicate"]): r["auc"] for r in got if r["arm"] == arm}
        assert own.keys() == want.keys()
        assert all((own[k] is None) == (v is None) and (v is None or abs(own[k] - v) < 1e-12) for k, v in want.items())


def test_every_row_one_tie(spark, monkeypatch):
    monkeypatch.setattr(bs, "DIGESTS", 30)
    df = spark.range(200).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(1.0).alias("s"))
    assert {r["auc"] for r in bs.aucs(df, [], "id", "y", ["s"], 6, "x").collect()} == {0.5}
    assert bs.aucs(df.where("false"), [], "id", "y", ["s"], 6, "x").collect() == []


def test_parts_chain_in_any_cut():
    draw = np.random.default_rng(4)
    s = np.sort(draw.integers(0, 5, 60)).astype(float)
    s[-4:] = np.nan
    w, y = draw.integers(0, 3, (60, 8)).astype(float), draw.integers(0, 2, 60)[:, None]
    whole = bs.Range(8)
    whole.add(s, w * y, w * (1 - y))
    want = bs.chained([p[1:] for p in whole.parts()])
    for _ in range(30):
        cuts, parts = [0, *sorted(draw.choice(59, 5, replace=False) + 1), 60], []
        for lo, hi in zip(cuts, cuts[1:]):
            own, step = bs.Range(8), int(draw.integers(1, 9))
            for i in range(lo, hi, step):
                c = slice(i, min(hi, i + step))
                own.add(s[c], (w * y)[c], (w * (1 - y))[c])
            parts += [p[1:] for p in own.parts()]
        assert np.allclose(bs.chained(parts), want)


def test_regressions_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bs, "DIGESTS", 60)
    some = rows()
    df = spark.createDataFrame(some, SCHEMA).withColumn("target", F.col("s") + 1e6)
    got = {(r["g"], r["replicate"]): r for r in bs.regressions(df, ["g"], "id", "target", ["t"], 6, "m").collect()}
    for g in ("a", None):
        own = [r for r in some if r[0] == g and r[4] is not None]
        for b in range(6):
            pick = [r for r in own for _ in range(weight("m", r[1], b))]
            y, p = np.array([r[3] for r in pick]) + 1e6, np.array([r[4] for r in pick])
            assert abs(got[g, b]["mae"] - np.abs(p - y).mean()) < 1e-6 and abs(got[g, b]["pcc"] - np.corrcoef(y, p)[0, 1]) < 1e-9


@pytest.mark.parametrize("limits", [{}, {"TASK_COUNTS": 300}, {"ROWS_AT_ONCE": 7}, {"TASK_CELLS": 0}, {"TASK_CELLS": 0, "DIGESTS": 40, "BLOCK": 7}])
def test_scores_of_a_row_share_its_draws(spark, monkeypatch, limits):
    """Nulls, NaN, ties, one class, null labels and null ids; by group and replicates, and by ranges of every score. Draws are made once a row and replicate."""
    for name, value in limits.items():
        monkeypatch.setattr(bs, name, value)
    some = rows(120)
    some = [(g, None if i == 3 else i, None if i == 9 else y, float("nan") if i % 13 == 0 else s, t) for g, i, y, s, t in some] + [("one", 200 + i, 1, 1.0, None) for i in range(4)]
    out = bs.aucs(spark.createDataFrame(some, SCHEMA), ["g"], "id", "y", ["s", "t"], 10, "seed")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("chunk#" in plan) == ("TASK_CELLS" in limits)
    got = out.collect()
    high = [(g, i, y, 1e9 if s is not None and np.isnan(s) else s, t) for g, i, y, s, t in some]
    for arm, at in (("s", 3), ("t", 4)):
        want = {k: v for k, v in brute_auc(high, at, 10, "seed").items() if arm == "s" or k[0] != "one"}
        own = {(r["g"], r["replicate"]): r["auc"] for r in got if r["arm"] == arm}
        assert own.keys() == want.keys()
        assert all((own[k] is None) == (v is None) and (v is None or abs(own[k] - v) < 1e-12) for k, v in want.items())
