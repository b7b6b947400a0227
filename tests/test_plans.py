"""The physical plans are part of the design: they must stay as they are."""

import re
from dataclasses import replace

import pytest

import __spark_entry__ as registry
from fixtures import TESTDATA
from wakeline.operators import aggregate
from wakeline.operators.clean import clean
from wakeline.params import DEFAULTS
from wakeline.plans import edges, steps, summary, top_routes, totals

SF = f"{TESTDATA}/sf0.01"


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def count(plan, operator):
    return len(re.findall(rf"^[\s:|+\-*()\d]*{operator}\b", plan, re.MULTILINE))


@pytest.fixture
def stored(spark, tmp_path):
    """Cleaned positions over a stored table of the position columns and more."""
    path = str(tmp_path / "positions")
    registry.positions_events(spark, SF).selectExpr("*", "'x' as unused").write.parquet(path)
    return clean(spark.read.parquet(path))


@pytest.fixture
def jobs(spark):
    """How many jobs some code runs."""
    tracker, group = spark.sparkContext.statusTracker(), "counted-jobs"

    def counted(work):
        spark.sparkContext.setJobGroup(group, group)
        before = len(tracker.getJobIdsForGroup(group))
        work()
        return len(tracker.getJobIdsForGroup(group)) - before

    yield counted
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_building_a_plan_runs_no_job(jobs, stored):
    for build in (steps, edges, totals, summary, top_routes):
        assert jobs(lambda: build(stored)) == 0


def test_whole_answer_is_one_scan_and_shuffles_the_reports_once(static_plans, stored):
    plan = static_plans(top_routes(stored))
    assert count(plan, "FileScan") == 1
    assert count(plan, "Exchange") == 2  # reports by stretch, one row per stretch
    assert count(plan, "Window") == 2
    assert count(plan, "TakeOrderedAndProject") == 1


def test_copies_can_be_counted_before_the_shuffle(static_plans, stored):
    plan = static_plans(top_routes(stored, replace(DEFAULTS, count_copies_first=True)))
    assert [count(plan, name) for name in ("FileScan", "Exchange", "Window")] == [1, 3, 2]
    assert re.search(r"partial_count\(1\)", plan)


def test_csv_queries_scan_files(static_plans, spark):
    for name in ("scan_positions_csv", "scan_positions_csv_inferred"):
        assert count(static_plans(registry.own_queries()[name](spark, SF)), "FileScan csv") == 1


def test_report_reads_one_row_per_vessel(static_plans, spark):
    plan = static_plans(registry.own_queries()["whole_report"](spark, SF))
    assert "/summary-" in plan and "/events.parquet" not in plan


def test_whole_run_is_one_scan(static_plans, stored):
    plan = static_plans(summary(stored))
    assert [count(plan, name) for name in ("FileScan", "Exchange", "Window")] == [1, 2, 2]


def test_step_rows_shuffle_the_reports_once(static_plans, stored):
    plan = static_plans(steps(stored.drop("unused")))
    assert count(plan, "FileScan") == 1
    assert count(plan, "ReusedExchange") == 1


def test_filters_and_columns_reach_the_scan(static_plans, stored):
    plan = static_plans(top_routes(stored))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    for name in ("mmsi", "timestamp", "latitude", "longitude"):
        assert f"IsNotNull({name})" in pushed
    assert "GreaterThanOrEqual(latitude,-90.0)" in pushed and "LessThanOrEqual(longitude,180.0)" in pushed
    columns = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert columns == "mmsi:bigint,timestamp:timestamp_ntz,latitude:double,longitude:double"


def test_profile_is_one_scan(static_plans, stored):
    plan = static_plans(aggregate.profile(stored))
    assert count(plan, "FileScan") == 1
    assert "partial_count" in plan


def test_no_python_and_no_cross_join_anywhere(spark, static_plans):
    for query in registry.own_queries().values():
        plan = static_plans(query(spark, SF))
        for word in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan
