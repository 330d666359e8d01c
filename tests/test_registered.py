"""Every registered query against its SQL on the given tables."""

import pytest

import checks
from checks.compare import compare, connect

ROWS_ONLY = sorted(set(checks.QUERIES) - set(checks.ORACLES))


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("key", sorted(checks.ORACLES))
def test_agrees_with_sql(spark, small, con, key):
    ok, message = compare(spark, con, small, key, checks.QUERIES[key], checks.ORACLES[key])
    assert ok, message


def test_only_fitted_models_lack_sql():
    assert ROWS_ONLY == ["train_baselines"]


def test_entry_points(spark, small):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
