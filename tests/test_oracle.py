import __spark_entry__ as registry
import pytest
from fixtures import TESTDATA
from oracle import connect, from_duckdb, from_spark

QUERIES = registry.own_queries()
ORACLE = registry.own_oracle_sql()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def sf(request):
    sf_dir = f"{TESTDATA}/{request.param}"
    return sf_dir, connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    sf_dir, con = sf
    assert from_spark(QUERIES[name](spark, sf_dir)) == from_duckdb(con, ORACLE[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) | {"sample_bernoulli"}  # which rows are drawn depends on the partitioning
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLE) <= set(registry.oracle_sql())


def test_entry_runs(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) == 10


def test_bernoulli_draws_some_of_the_cleaned_rows(spark):
    sf = f"{TESTDATA}/sf0.01"
    given, drawn = (set(QUERIES[name](spark, sf).collect()) for name in ("clean_positions", "sample_bernoulli"))
    assert drawn < given and abs(len(drawn) / len(given) - 0.1) < 0.02
