import pytest

from wakeline.operators import report
from wakeline.operators.aggregate import vessels_count
from wakeline.params import RouteParams
from wakeline.schema import VESSEL


def routes(spark, *rows):
    return spark.createDataFrame(list(rows), VESSEL)


def texts(df):
    return [row["line"] for row in df.orderBy(df.columns[0]).collect()]


def test_top_breaks_ties_by_vessel_and_stops_at_n(spark):
    df = routes(spark, (3, 5.0, 1), (2, 5.0, 1), (1, 4.0, 1), (4, 6.0, 1))
    assert [row["mmsi"] for row in report.top(df, RouteParams(top_n=3)).collect()] == [4, 2, 3]
    assert vessels_count(df).collect()[0]["vessels"] == 4


def test_realistic_limit_is_inclusive(spark):
    ranked = report.status_rank(routes(spark, (1, 1000.0, 2), (2, 1000.0000001, 2))).collect()
    assert [(row["rank"], row["status"], row["mmsi"]) for row in ranked] == [(1, "CHECK", 2), (2, "OK", 1)]


def test_answer_prefers_the_plausible(spark):
    mixed = routes(spark, (1, 1500.0, 3), (2, 900.0, 2), (3, 800.0, 1))
    assert tuple(report.answer(mixed).collect()[0]) == (2, 900.0, True)
    assert tuple(report.answer(mixed.where("mmsi = 1")).collect()[0]) == (1, 1500.0, False)
    assert report.longest(mixed).collect()[0]["mmsi"] == 1
    assert [row["mmsi"] for row in report.realistic(mixed).orderBy("mmsi").collect()] == [2, 3]


def test_speed_uses_the_hours(spark):
    row = report.realistic_longest(routes(spark, (2, 960.0, 2)), RouteParams(hours=48.0)).collect()[0]
    assert row["avg_speed_kmh"] == 20.0


def test_plausible_beyond_the_top_is_not_considered(spark):
    df = routes(spark, *[(n, 2000.0 + n, 1) for n in range(10)], (99, 500.0, 1))
    assert report.realistic(report.top(df)).count() == 0
    assert report.answer(report.top(df)).collect()[0]["mmsi"] == 9


def test_ranking_lines(spark):
    ranked = report.status_rank(routes(spark, (219000001, 1234.567, 1234), (219000002, 45.6, 7)))
    assert texts(report.ranking_lines(ranked)) == [
        " 1. CHECK MMSI: 219000001 | Distance: 1234.57 km | Reports: 1,234",
        " 2. OK MMSI: 219000002 | Distance:  45.60 km | Reports:    7",
    ]


def test_headlines_with_a_plausible_route(spark):
    assert texts(report.headlines(routes(spark, (1, 1500.25, 3000), (2, 950.5, 12)))) == [
        "LONGEST ROUTE:",
        "MMSI: 1",
        "Distance: 1500.25 km",
        "Position reports: 3,000",
        "REALISTIC LONGEST ROUTE:",
        "MMSI: 2",
        "Distance: 950.50 km",
        "Position reports: 12",
        "Average speed: 39.6 km/h",
        "ASSIGNMENT ANSWER:",
        "Vessel with longest route: MMSI 2",
        "Total distance traveled: 950.50 km",
    ]


def test_headlines_without_a_plausible_route(spark):
    assert texts(report.headlines(routes(spark, (1, 1500.25, 3000), (2, 1500.25, 1)))) == [
        "LONGEST ROUTE:",
        "MMSI: 1",
        "Distance: 1500.25 km",
        "Position reports: 3,000",
        "All routes contain potential errors. Best result:",
        "MMSI: 1",
        "Distance: 1500.25 km",
    ]


def test_headlines_without_routes(spark):
    assert texts(report.headlines(routes(spark))) == ["No vessel routes found in the sample."]


@pytest.mark.parametrize("km,text", [(1.005, "1.00"), (0.125, "0.12"), (2.675, "2.67"), (999.995, "1000.00"), (999.994, "999.99")])
def test_distances_round_the_exact_value(spark, km, text):
    lines = texts(report.headlines(routes(spark, (1, km, 1))))
    assert f"{km:.2f}" == text and f"Distance: {text} km" in lines
    ranking = texts(report.ranking_lines(report.status_rank(routes(spark, (1, km, 1)))))
    assert f"Distance: {km:6.2f} km" in ranking[0]


def test_speeds_round_the_exact_value(spark):
    assert "Average speed: 0.2 km/h" in texts(report.headlines(routes(spark, (1, 6.0, 1))))


def summary_of(spark, *rows):
    return spark.createDataFrame(list(rows), "mmsi bigint, reports bigint, total_distance_km double, position_count bigint")


def test_whole_report(spark):
    rows = summary_of(spark, (1, 1500, 900.5, 1400), (2, 7, None, 0), (3, 2, 1200.0, 1))
    assert texts(report.whole_report(rows, fraction=0.1)) == [
        "Taking 10.0% sample for processing...",
        "Sample size: 1,509 records",
        "Vessels in sample: 3",
        "Calculated distances for 2 vessels",
        "LONGEST ROUTE:",
        "MMSI: 3",
        "Distance: 1200.00 km",
        "Position reports: 1",
        "REALISTIC LONGEST ROUTE:",
        "MMSI: 1",
        "Distance: 900.50 km",
        "Position reports: 1,400",
        "Average speed: 37.5 km/h",
        "ASSIGNMENT ANSWER:",
        "Vessel with longest route: MMSI 1",
        "Total distance traveled: 900.50 km",
        "TOP 10 VESSELS BY DISTANCE:",
        " 1. CHECK MMSI: 3 | Distance: 1200.00 km | Reports:    1",
        " 2. OK MMSI: 1 | Distance: 900.50 km | Reports: 1,400",
        "Notes:",
        "- OK = Realistic route (under 1000 km/day)",
        "- CHECK = May contain GPS errors",
        "- Analysis based on 10% sample of full dataset",
    ]


def test_whole_report_without_routes(spark):
    assert texts(report.whole_report(summary_of(spark, (2, 7, None, 0)))) == [
        "Sample size: 7 records",
        "Vessels in sample: 1",
        "Calculated distances for 0 vessels",
        "No vessel routes found in the sample.",
    ]


@pytest.mark.parametrize("step", [report.longest, report.realistic, report.realistic_longest, report.answer, report.status_rank])
def test_no_routes_give_no_rows(spark, step):
    assert step(routes(spark)).count() == 0
