import numpy as np
import pytest

from tidemark.operators import matching as mt


def brute(v_case, v_ctrl, caliper):
    """All pairs by (distance, lower control first), greedily; values only."""
    pairs = sorted((abs(a - c), 0 if c <= a else 1, i, j) for i, a in enumerate(v_case)
                   for j, c in enumerate(v_ctrl) if abs(a - c) <= caliper)
    used_a, used_c, out = set(), set(), []
    for d, side, i, j in pairs:
        if i not in used_a and j not in used_c:
            used_a.add(i)
            used_c.add(j)
            out.append((v_case[i], v_ctrl[j]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_values_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 40, 60).astype(float)
    c = rng.integers(10, 50, 50).astype(float)
    v = np.unique(np.r_[a, c])
    got = mt.closest_first(v, np.array([(a == x).sum() for x in v]), np.array([(c == x).sum() for x in v]), 3.0)
    assert sorted((p, q) for p, q, m, _ in got for _ in range(m)) == brute(a, c, 3.0)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(9)
    data = [("a" if i % 2 else "b", i, int(rng.random() < 0.4), float(rng.integers(20, 60))) for i in range(140)]
    return spark.createDataFrame(data, "g string, id int, y int, age double"), data


@pytest.mark.parametrize("large", [False, True])
def test_rows_match_brute_force(frame, large):
    df, data = frame
    out = mt.caliper_match(df, ["g"], "id", "y", "age", 2.0, large=large).collect()
    for g in "ab":
        mine = sorted((r["case_value"], r["control_value"]) for r in out if r["g"] == g)
        assert mine == brute([x for k, _, y, x in data if k == g and y], [x for k, _, y, x in data if k == g and not y], 2.0)
    info = {i: (g, y, x) for g, i, y, x in data}
    for side, col in ((1, "case"), (0, "control")):
        ids = [r[f"{col}_id"] for r in out]
        assert len(ids) == len(set(ids))
        assert all(info[r[f"{col}_id"]] == (r["g"], side, r[f"{col}_value"]) for r in out)


def test_islands_are_matched_on_their_own(spark, small_limits):
    """Two crowded runs and lone values far apart; the limit lets only the crowded ones take rounds."""
    rng = np.random.default_rng(4)
    values = np.r_[rng.integers(0, 12, 50), rng.integers(100, 104, 30), [300, 301, 500, 700]].astype(float)
    data = [("g" if i % 5 else None, i, int(i % 3 == 0), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "g string, id int, y int, age double")
    v = df.selectExpr("g", "age AS v").distinct()
    runs = mt.islands(v, ["g"], 2.0).groupBy("g", "__island").agg({"v": "min"}).count()
    assert runs >= 2 * 2 and mt.islands(v, ["g"], 2.0).count() == v.count()
    out = mt.caliper_match(df.filter("g = 'g'"), ["g"], "id", "y", "age", 2.0).collect()
    assert sorted((r["case_value"], r["control_value"]) for r in out) == brute(
        [x for g, _, y, x in data if g and y], [x for g, _, y, x in data if g and not y], 2.0)


def test_pairs_do_not_depend_on_partitioning(frame):
    df, _ = frame
    key = lambda d: sorted((r["case_id"], r["control_id"]) for r in d.collect())
    assert key(mt.caliper_match(df, ["g"], "id", "y", "age", 2.0)) == key(
        mt.caliper_match(df.repartition(9), ["g"], "id", "y", "age", 2.0, large=True))


def test_no_control_inside_the_caliper(spark):
    df = spark.createDataFrame([("g", 1, 1, 10.0), ("g", 2, 0, 20.0)], "g string, id int, y int, age double")
    for large in (False, True):
        assert mt.caliper_match(df, ["g"], "id", "y", "age", 3.0, large=large).count() == 0
