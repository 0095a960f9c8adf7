"""Every query with SQL gives the SQL's rows on the smallest tables; the rest run; plans stay free of Cartesian joins."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from oracle import compare, views
from skeinwork.plans import catalog

SF = "/root/testdata/sf0.001"
CORE, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert compare(CORE[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    df = CORE[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["j13_band", "j23_snowflake", "p2_found", "pr06_filters", "w01_lags_and_rolling"])
def test_plans(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        CORE[name](spark, SF).explain("formatted")
    plan = out.getvalue()
    assert "CartesianProduct" not in plan
    if name == "pr06_filters":
        assert "PushedFilters: [" in plan and "IsNotNull(xp)" in plan
    if name == "w01_lags_and_rolling":
        assert plan.count("(1) Scan") == 1 and "Python" not in plan
