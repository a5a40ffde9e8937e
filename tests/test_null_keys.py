"""A group with a null key is a group like any other: each operator treats it as its twin with a key."""
import pytest
from pyspark.sql import functions as F

from tidemark.operators import covariate as cv
from tidemark.operators import folds as fd
from tidemark.operators import matching as mt
from tidemark.operators import models as ml
from tidemark.operators import operating as op
from tidemark.operators import quality as ql
from tidemark.operators import rankstats as rs
from tidemark.operators import resample as rp


@pytest.fixture(scope="module")
def twins(spark):
    """The same 40 rows under the key 'a' and under null."""
    base = spark.range(40).select("id", ((F.col("id") * 7) % 40 < 16).cast("int").alias("y"), ((F.col("id") * 13) % 17).cast("double").alias("s"),
                                  (F.col("id") % 9 + 40.0).alias("age"), (F.col("id") % 8).alias("grp"))
    base = base.withColumns({"p": 1 / (1 + F.exp(-(F.col("s") - 8) / 4)), "x": F.array("s", "age"), "value": F.col("s") + F.col("age") / 10, "feature": F.lit("f")})
    return base.withColumn("g", F.explode(F.array(F.lit("a"), F.lit(None).cast("string"))))


def same(df, drop=("g",)):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["g"], []).append(tuple(round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items() if k not in drop))
    assert set(rows) == {"a", None}
    assert sorted(rows["a"], key=str) == sorted(rows[None], key=str)
    return rows[None]


def test_models(twins):
    params = ml.fit(twins, ["g"], "y", "x", large=False)
    assert len(same(ml.scored(twins, params, ["g"], "x").select("g", "id", "s"))) == 40
    oof = ml.out_of_fold(twins.select("g", "id", "y", "x"), ["g"], "id", "y", "x", 4, 2, hot=False, large=False)
    assert len(same(oof.select("g", "id", "repeat", "fold", F.round("s", 6).alias("s")))) == 80
    same(ml.calibrated(oof, ["g"], "y", "s", False).select("g", F.round("slope", 5).alias("slope")))
    same(ml.optimum(ml.scored(twins.select("g", "id", "y", "x"), params, ["g"], "x", "d"), params, ["g"], "y", "x", "d"))
    assert len(same(fd.group_stratified(twins.select("g", "id", "grp", "y"), ["g"], "grp", "y", 3, 2, False))) == 80


def test_rank_statistics(twins, spark):
    assert len(same(rs.net_benefit(twins, ["g"], "y", "p", op.threshold_table(spark)))) == 46
    d = rs.delong(twins.withColumn("c", F.col("grp") % 2), ["g", "c"], "y", "s", "age", hot=False)
    same(rs.pool_leave_one_out(d, ["g"], "c", "diff", "se"))
    half = twins.withColumn("held", F.col("id") % 2)
    same(op.interpolated_ranks(half.filter("held = 0"), half.filter("held = 1"), ["g"], "s", "age", hot=False))


def test_resampling_and_matching(twins):
    rows = twins.select("g", "id", "y", "s")
    assert len(same(rp.permuted(rows, ["g"], "id", ["y"], 3, "p", False))) == 120
    quota = rows.groupBy("g", "y").agg(F.lit(5).alias("take"))
    assert len(same(rp.subsampled(rows, ["g"], "id", "y", quota, 2, "q", False))) == 20
    null = rows.groupBy("g").agg(F.avg("s").alias("v"))
    same(rp.permutation_p(null, null, ["g"], "v"))
    for large in (False, True):
        assert same(mt.caliper_match(rows, ["g"], "id", "y", "s", 1.0, large=large, hot=False))


def test_covariates(twins):
    long = twins.select("g", "feature", "id", "y", "age", "value", (F.col("id") % 4).cast("int").alias("fold"), F.lit(0).alias("repeat"))
    fit = cv.quadratic_fit(long, ["g"], "age", "value")
    same(cv.residuals(long, fit, ["g"], "age", "value").select("g", "id", "resid"))
    model = cv.normative_fit(long, ["g"], "age", "value", 10)
    z = cv.deviations(long, model, ["g"], "age", "value").select("g", "id", "z")
    same(z)
    same(cv.site_anchor(z, ["g"], hot=False))
    more = long.withColumn("y", F.lit(0))
    for how, rows in (("residual", long), ("normative", more.unionByName(more.withColumn("id", F.col("id") + 100)))):
        got = cv.crossfitted(rows, ["g"], "id", "y", "age", "value", 4, how)
        n = 160 if how == "residual" else 320
        assert len(same(got.withColumn("x", F.transform("x", lambda v: F.round(v, 6))))) == n
    assert cv.crossfitted(long, ["g"], "id", "y", "age", "value", 4, "normative").collect() == []  # fewer than 30 controls
    same(ql.robust_scaled(twins.select("g", "id", F.col("s").alias("x")), ["g"], False))
