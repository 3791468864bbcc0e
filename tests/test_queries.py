import pytest
from compare import connect, same, same_types

from brindle.plans import queries, workflow  # noqa: F401
from brindle.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    same_types(got.schema, duck.sql(ORACLES[name]))
    same(got.toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    assert len(got.collect()) > 0 or name == "style_scan"


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
