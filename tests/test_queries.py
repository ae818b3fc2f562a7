import pytest

from landloom import registry
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    assert same(spark, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, f"{DATA}/sf0.01").count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
