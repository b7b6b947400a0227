"""What must hold for any reports."""

import random

import pytest
from fixtures import at
from fixtures import positions as positions_of_fixture
from pyspark.sql import functions as F

import __spark_entry__ as registry
from fixtures import TESTDATA
from oracle import from_spark
from wakeline.operators import aggregate, report, sampling
from wakeline.operators.clean import clean
from wakeline.operators.trajectory import drop_jumps
from wakeline.params import RouteParams
from wakeline.plans import edges, summary, top_routes, totals
from wakeline.schema import POSITION

SF = f"{TESTDATA}/sf0.001"


def near(left, right):
    assert [row[0] for row in left] == [row[0] for row in right]
    for one, other in zip(left, right):
        assert one[1] == pytest.approx(other[1], abs=1e-6) and one[2] == other[2]


def sorted_totals(df):
    return sorted(tuple(row) for row in df.collect())


def some_reports(seed, rows=400):
    draw = random.Random(seed)
    return [
        (n, draw.randrange(8), at(draw.randrange(300)), draw.uniform(50, 51), draw.uniform(5, 6))
        for n in range(rows)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_totals_do_not_depend_on_partitioning_or_input_order(spark, seed):
    rows = some_reports(seed)
    expected = sorted_totals(totals(spark.createDataFrame(rows, POSITION)))
    random.Random(seed).shuffle(rows)
    shuffled = spark.createDataFrame(rows, POSITION)
    for parts in (1, 3, 17):
        near(sorted_totals(totals(shuffled.repartition(parts))), expected)


@pytest.mark.parametrize("seed", range(3))
def test_totals_and_counts_are_in_range(spark, seed):
    positions = spark.createDataFrame(some_reports(seed), POSITION)
    reports = positions.groupBy("mmsi").agg(F.count("*").alias("n"))
    bad = totals(positions).join(reports, "mmsi").where("total_distance_km <= 0 or position_count > n - 1")
    assert bad.count() == 0


def test_shifting_latitudes_keeps_the_totals(spark):
    positions = spark.createDataFrame(some_reports(11), POSITION)
    shifted = positions.withColumn("latitude", F.col("latitude") - 30)
    near(sorted_totals(totals(shifted)), sorted_totals(totals(positions)))


def test_hash_sample(spark):
    cleaned = clean(registry.cleaned(spark, f"{TESTDATA}/sf0.01"))
    counts = {f: sampling.by_hash(cleaned, f).count() for f in (0.0, 0.1, 0.5, 1.0)}
    assert counts == {0.0: 0, 0.1: 1005, 0.5: 4787, 1.0: 9606}
    assert from_spark(sampling.by_hash(cleaned.repartition(5))) == from_spark(sampling.by_hash(cleaned))


def test_bernoulli_sample_is_repeatable_and_about_the_fraction(spark):
    cleaned = clean(registry.cleaned(spark, f"{TESTDATA}/sf0.1"))
    one, two = from_spark(sampling.bernoulli(cleaned)), from_spark(sampling.bernoulli(cleaned))
    assert one == two
    assert 9000 < len(one[1]) < 10300
    assert "Sample 0.0, 0.1, false, 42" in sampling.bernoulli(cleaned)._jdf.queryExecution().toString()


def test_hash_sample_keeps_null_keys_together(spark):
    rows = spark.createDataFrame([(None, n, 1.0) for n in range(50)], "event_id bigint, mmsi bigint, latitude double")
    assert sampling.by_hash(rows, 0.99999).count() == 50
    assert sampling.by_hash(rows, 0.0).count() == 0
    assert 5 < sampling.by_hash(rows.drop("event_id"), 0.5).count() < 45
    assert sampling.by_hash(rows, 0.5, key="mmsi").count() == sampling.by_hash(rows.select("mmsi"), 0.5, key="mmsi").count()


@pytest.mark.parametrize("draw", [lambda df: sampling.by_hash(df, 0.5), sampling.bernoulli])
def test_sampled_routes_in_short_stretches(spark, draw):
    sample = draw(registry.cleaned(spark, f"{TESTDATA}/sf0.01"))
    near(sorted_totals(totals(sample, RouteParams(stretch_seconds=60))), sorted_totals(totals(sample)))


@pytest.mark.parametrize("seconds", [1, 86_400])
def test_summary_holds_the_counts_and_the_totals(spark, seconds):
    positions = clean(positions_of_fixture(spark))
    rows = summary(positions, RouteParams(stretch_seconds=seconds))
    near(sorted_totals(aggregate.moved(rows)), sorted_totals(aggregate.vessel_distance(drop_jumps(edges(positions)))))
    counted = tuple(aggregate.run_counts(rows).collect()[0])
    assert counted == (*aggregate.profile(positions).collect()[0], aggregate.vessels_count(totals(positions)).collect()[0][0])
    assert counted == (21, 8, 3)


def test_empty_input(spark):
    empty = spark.createDataFrame([], POSITION)
    cleaned = clean(empty)
    assert edges(cleaned).count() == 0
    assert totals(cleaned).count() == 0
    assert top_routes(cleaned).count() == 0
    assert sampling.bernoulli(cleaned).count() == 0
    assert sampling.by_hash(cleaned).count() == 0
    assert aggregate.distinct_vessels(cleaned).count() == 0
    assert tuple(aggregate.profile(cleaned).collect()[0]) == (0, 0)
    assert aggregate.vessels_count(totals(cleaned)).collect()[0][0] == 0
    assert tuple(aggregate.run_counts(summary(cleaned)).collect()[0]) == (0, 0, 0)
    assert aggregate.moved(summary(cleaned)).count() == 0
    assert report.answer(top_routes(cleaned)).count() == 0
    assert report.ranking_lines(report.status_rank(top_routes(cleaned))).count() == 0


@pytest.mark.parametrize("name", sorted(registry.own_queries()))
def test_query_has_a_stable_schema(spark, name):
    query = registry.own_queries()[name]
    assert query(spark, SF).schema == query(spark, SF).schema
