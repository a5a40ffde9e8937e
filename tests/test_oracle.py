"""Every query with a DuckDB statement must equal it; every other query must return rows."""
import pytest

import __spark_entry__ as entry_mod
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry_mod.oracle_sql()
ROWS_ONLY = sorted(set(entry_mod.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    err, _ = compare(entry_mod.queries()[name](spark, SF), con, ORACLES[name])
    assert err is None, err


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(spark, name):
    df = entry_mod.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_mod.queries())


def test_entry_has_rows(spark):
    assert entry_mod.entry(spark).count() > 0


HOT = ["a03_auc", "a09_average_precision", "i02_delong_test", "i03_registered_margins", "j05_caliper_nearest",
       "ml12_site_anchor", "mt01_exact_ties", "r01_midrank", "r05_holm", "r06_rank_interpolation", "w03_reject_fallback"]


@pytest.mark.parametrize("name", HOT)
def test_large_group_way_matches_oracle(spark, con, small_limits, name):
    err, _ = compare(entry_mod.queries()[name](spark, SF), con, ORACLES[name])
    assert err is None, err
