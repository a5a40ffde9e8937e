import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as od
from tidemark.operators import rankstats as rs
from tidemark.operators.operating import rank_fraction

KEYS = ["g"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else "cold", float(rng.choice([-1e6, 0, 1, 1, 2, 2.5, 7, 1e9, rng.random()])), i)
            for i in range(240)]
    return spark.createDataFrame(data, "g string, v double, id bigint"), data


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_running_sum_and_max(spark, rows, small_limits):
    df, data = rows
    for how in ("sum", "max"):
        hot = od.running(df, KEYS, ["v", "id"], {"c": F.col("id")}, how=how)
        plain = od.running(df, KEYS, ["v", "id"], {"c": F.col("id")}, hot=False, how=how)
        assert got(hot, "g", "id", "c") == got(plain, "g", "id", "c")


def test_row_numbers_without_keys(spark, rows, small_limits):
    df, data = rows
    want = [i for _, i in sorted((v, i) for _, v, i in data)]
    out = sorted(od.row_numbers(df, [], ["v", "id"]).collect(), key=lambda r: r["rn"])
    assert [r["id"] for r in out] == want and out[-1]["rn"] == len(data)


def test_hot_leading_value_is_cut_again(spark, small_limits):
    rng = random.Random(1)
    data = [("g", 7.0 if i % 3 else float(rng.randint(0, 14)), f"id{i}") for i in range(300)]
    df = spark.createDataFrame(data, "g string, v double, id string")
    cut = od._ranges(df, KEYS, ["v", "id"])
    sizes = cut.groupBy("g", "__range").count().agg(F.max("count")).first()[0]
    assert sizes < 60                      # the value 7.0 alone has over 200 rows
    hot = od.row_numbers(df, KEYS, ["v", "id"])
    want = {i: k for k, (_, i) in enumerate(sorted((v, i) for _, v, i in data), 1)}
    assert {r["id"]: r["rn"] for r in hot.collect()} == want


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Null keys, null values, NaN, ties of strings, whole groups of nulls."""
    rng = random.Random(9)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice(["x", "y", "y", None]),
             rng.choice([None, None, float("nan"), 1.0, 2.0, -3.5]), rng.choice([None, 1, 2, 5]), i) for i in range(200)]
    data += [("nulls", None, None, None, 1000 + i) for i in range(30)]
    return spark.createDataFrame(data, "g string, s string, v double, x long, id long")


def plain(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("keys, order", [(["g"], ["s", "id"]), (["g", "s"], ["v", "id"]), ([], ["s", "v", "id"])])
def test_both_ways_give_the_same_rows(odd_rows, small_limits, how, keys, order):
    run = lambda hot: od.running(odd_rows, keys, order, {"c": F.col("x")}, hot, how)
    assert plain(run(None)) == plain(run(True)) == plain(run(False))


def test_both_ways_of_ranks_quantiles_and_neighbours(odd_rows, small_limits):
    known = odd_rows.filter("v is not null")
    for fn in (lambda h: od.midranks(known, ["g"], "v", hot=h), lambda h: od.quantiles(odd_rows.filter("not isnan(v)"), ["g"], "v", {"q": 0.3}, h),
               lambda h: od.neighbours(odd_rows.withColumn("r", (F.col("id") % 3 == 0).cast("int")), ["g"], "x", "r", h)):
        assert plain(fn(True)) == plain(fn(False))


@pytest.mark.parametrize("operator", ["row_numbers", "midranks", "quantiles", "running"])
def test_large_way_evaluates_its_input_twice_at_most(spark, small_limits, operator):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([("g", float(i % 7), i) for i in range(100)], "g string, v double, id long").mapInPandas(count, "g string, v double, id long")
    out = {"row_numbers": lambda: od.row_numbers(df, KEYS, ["v", "id"]), "midranks": lambda: od.midranks(df, KEYS, "v"),
           "quantiles": lambda: od.quantiles(df, KEYS, "v", {"q": 0.5}), "running": lambda: od.running(df, KEYS, ["v", "id"], {"c": F.col("id")})}
    assert out[operator]().count() > 0
    assert seen.value <= 200


def test_midranks_match_brute_force(spark, rows, small_limits):
    df, data = rows
    for hot in (None, False):
        for r in od.midranks(df, KEYS, "v", hot=hot).collect():
            same = [v for g, v, _ in data if g == r["g"]]
            want = sum(v < r["v"] for v in same) + (sum(v == r["v"] for v in same) + 1) / 2
            assert r["midrank"] == want


def test_quantiles_match_numpy(spark, rows, small_limits):
    df, data = rows
    out = od.quantiles(df, KEYS, "v", {"lo": 0.1, "mid": 0.5, "hi": 0.8}).collect()
    for r in out:
        v = [x for g, x, _ in data if g == r["g"]]
        assert np.allclose([r["lo"], r["mid"], r["hi"]], np.quantile(v, [0.1, 0.5, 0.8]))


def test_neighbours(spark, rows, small_limits):
    df, data = rows
    d = df.withColumn("ref", (F.col("id") % 4 == 0).cast("int"))
    for hot in (None, False):
        for r in od.neighbours(d, KEYS, "v", "ref", hot).collect():
            refs = [v for g, v, i in data if g == r["g"] and i % 4 == 0]
            assert r["lo"] == max([v for v in refs if v <= r["v"]], default=None)
            assert r["hi"] == min([v for v in refs if v >= r["v"]], default=None)


def test_hash_draws_do_not_depend_on_partitioning(spark):
    from tidemark.functions.draws import uniform
    ids = spark.range(500)
    a = got(ids.select("id", uniform("s", F.col("id")).alias("u")), "id", "u")
    b = got(ids.repartition(7).select("id", uniform("s", F.col("id")).alias("u")), "id", "u")
    assert a == b and 0.4 < np.mean([u for _, u in a]) < 0.6


def test_crc_seed_is_the_plain_checksum(spark):
    import zlib

    from tidemark.functions.draws import crc_seed
    row = spark.range(1).select(crc_seed("mci", "full", F.lit(40)).alias("s")).first()
    assert row["s"] == zlib.crc32(b"mci|full|40")


def test_neighbours_read_no_frame_from_its_end(spark):
    """A frame that ends at the group's last row costs the square of the group."""
    rows = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") % 20_001).cast("double").alias("v"), (F.col("id") % 7 == 0).cast("int").alias("ref"))
    out = od.neighbours(rows, KEYS, "v", "ref", False)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    want = np.unique([i % 20_001 for i in range(0, 40_000, 7)]).astype(float)
    for r in out.filter("v % 500 = 3").collect():
        assert r.lo == max(want[want <= r.v], default=None) and r.hi == min(want[want >= r.v], default=None)


def test_large_groups_do_not_share_a_task(spark, monkeypatch):
    """Partitions are not merged by their bytes where several sorts of a group are held at once."""
    monkeypatch.setattr(od, "OWN_TASK_ROWS", 100)
    rows = spark.range(6000).select((F.col("id") % 12).alias("g"), F.hash("id").cast("double").alias("s"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    hot, own = od.apart(rows, KEYS)
    places = own.select("g", F.spark_partition_id().alias("p")).distinct().collect()
    assert not hot and len({r.p for r in places}) == len({r.g for r in places}) == len(places) == 12
    rest = rs.delong(rows.withColumn("t", F.hash("s").cast("double")), KEYS, "y", "s", "t")
    tasks = rest.select("g", F.spark_partition_id().alias("p")).collect()
    assert len({r.p for r in tasks}) == 12
    ranked = rank_fraction(rows, KEYS, "s", "f").select("g", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in ranked}) == len(ranked) == 12
