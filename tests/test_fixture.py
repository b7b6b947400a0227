import datetime as dt

import pytest
from fixtures import EDGES, REPORTS, START, TOTALS, at, positions

from wakeline.operators.clean import clean, in_bounds, not_null
from wakeline.operators.trajectory import drop_jumps
from wakeline.params import RouteParams
from wakeline.plans import edges, totals
from wakeline.schema import EDGE, POSITION, VESSEL


def lengths(df):
    return {(row["mmsi"], (row["timestamp"] - START).seconds): round(row["distance_km"], 6) for row in df.collect()}


def routes(df):
    return {row["mmsi"]: (round(row["total_distance_km"], 6), row["position_count"]) for row in df.collect()}


def types(schema):
    return [(field.name, field.dataType) for field in schema]


def test_cleaning(spark):
    raw = positions(spark)
    assert raw.count() == 24
    assert clean(raw).count() == 21
    assert not_null(raw).count() == 23  # NaN is a value
    assert in_bounds(raw).count() == 21  # NaN and null are in no range


@pytest.mark.parametrize("seconds", [1, 2, 86_400])
def test_edges_and_totals(spark, seconds):
    cleaned, params = clean(positions(spark)), RouteParams(stretch_seconds=seconds)
    assert lengths(edges(cleaned, params)) == EDGES
    assert routes(totals(cleaned, params)) == TOTALS


def test_schemas(spark):
    cleaned = clean(positions(spark))
    assert types(cleaned.schema) == types(POSITION)
    assert types(edges(cleaned).schema) == types(EDGE)
    assert types(totals(cleaned).schema) == types(VESSEL)


def test_missing_required_values(spark):
    rows = [(1, None, at(1), 1.0, 1.0), (2, 5, None, 1.0, 1.0), (3, 5, at(1), 1.0, None), (4, 5, at(1), 1.0, 1.0)]
    df = spark.createDataFrame(rows, POSITION)
    assert [row["event_id"] for row in not_null(df).collect()] == [4]


def test_jump_limit_is_strict(spark):
    exactly = positions(spark, [(1, 1, 0.0, 0.0), (1, 2, 100 / 111, 0.0)])
    below = positions(spark, [(1, 1, 0.0, 0.0), (1, 2, 99.999 / 111, 0.0)])
    assert [row["distance_km"] for row in edges(exactly).collect()] == [100.0]
    assert drop_jumps(edges(exactly)).count() == 0
    assert drop_jumps(edges(below)).count() == 1


def test_range_limits_are_inclusive(spark):
    inside = [(1, 1, 90.0, 180.0), (1, 2, -90.0, -180.0)]
    outside = [(1, 3, 90.0000001, 0.0), (1, 4, -90.0000001, 0.0), (1, 5, 0.0, 180.0000001), (1, 6, 0.0, -180.0000001)]
    assert clean(positions(spark, inside + outside)).count() == 2


def test_thresholds_are_parameters(spark):
    cleaned = clean(positions(spark))
    wide = RouteParams(max_jump_km=1000.0, min_total_km=100.0)
    assert routes(totals(cleaned, wide)) == {3: (2109.0, 3), 6: (458.143367, 4)}
    small = RouteParams(km_per_deg_lat=1.0, km_per_deg_lon=0.0)
    assert routes(totals(cleaned, small))[9] == (0.5, 2)
    narrow = RouteParams(max_latitude=55.0, min_latitude=50.0)
    assert clean(positions(spark), narrow).where("latitude < 50 or latitude > 55").count() == 0


def test_order_is_by_time_not_by_input(spark):
    backwards = positions(spark, REPORTS[::-1])
    assert routes(totals(clean(backwards))) == TOTALS


def test_reports_of_the_same_time_are_ordered_by_place(spark):
    reports = [(1, 1, 50.0, 5.0), (1, 2, 50.3, 5.0), (1, 2, 50.1, 5.0), (1, 2, 50.2, 5.0), (1, 3, 50.4, 5.0)]
    for shuffled in (reports, reports[::-1], reports[2:] + reports[:2]):
        assert routes(totals(positions(spark, shuffled))) == {1: (44.4, 4)}


def test_time_order_across_months(spark):
    rows = [
        (1, 1, dt.datetime(2024, 5, 1), 50.2, 5.0),
        (2, 1, dt.datetime(2024, 4, 30, 23, 59), 50.1, 5.0),
        (3, 1, dt.datetime(2024, 4, 30, 23, 58), 50.0, 5.0),
    ]
    assert routes(totals(spark.createDataFrame(rows, POSITION))) == {1: (22.2, 2)}
