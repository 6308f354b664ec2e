import pathlib

import pytest

import compare
from fundlake import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.oracle(sf_dir)


@pytest.mark.parametrize("key", list(registry.ENTRIES))
def test_query_equals_oracle(spark, con, sf_dir, tmp_path, key):
    assert compare.differences(spark, con, sf_dir, key, str(tmp_path)) == ""


def test_every_query_has_an_oracle():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_entry_runs(spark):
    if not pathlib.Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data")
    import __spark_entry__

    result = __spark_entry__.entry(spark)
    assert result.columns == ["portfolio", "currency", "invested_amount", "market_value", "profit_loss",
                              "annualized_yield"]
    assert result.count() > 0
