import datetime as dt
import pytest
from pyspark.sql import functions as F

from fixtures import TESTDATA
from oracle import from_spark
from wakeline.functions.columns import format_report_time, parse_report_time
from wakeline.operators.clean import clean
from wakeline.plans import edges, totals
from wakeline.sources import columns_of, positions_csv, positions_events, read_raw_csv, write_positions_csv

HEADER = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Speed\n"


@pytest.fixture
def raw_file(tmp_path):
    def write(*lines, header=HEADER):
        path = tmp_path / "day.csv"
        path.write_text(header + "".join(line + "\n" for line in lines))
        return str(path)

    return write


def test_columns_are_found_by_name(spark, raw_file):
    path = raw_file("04/05/2024 00:00:01,Class A,219000001,55.5,10.25,3.5")
    row = positions_csv(spark, path).collect()[0]
    assert tuple(row) == (219000001, dt.datetime(2024, 5, 4, 0, 0, 1), 55.5, 10.25)
    assert read_raw_csv(spark, path).columns == HEADER.strip().split(",")


def test_bad_values_become_null_and_are_cleaned_away(spark, raw_file):
    path = raw_file(
        "04/05/2024 00:00:01,A,219000001,55.5,10.25,",
        "04/05/2024 00:00:02,A,not a number,55.5,10.25,",
        "04/05/2024 00:00:03,A,219000001,north,10.25,",
        "04/05/2024 00:00:04,A,219000001,55.5,,",
        "31/02/2024 00:00:05,A,219000001,55.5,10.25,",
        "2024-05-04 00:00:06,A,219000001,55.5,10.25,",
        ",A,219000001,55.5,10.25,",
    )
    positions = positions_csv(spark, path)
    assert positions.count() == 7
    assert clean(positions).count() == 1
    assert [positions.where(F.col(c).isNull()).count() for c in ("mmsi", "latitude", "longitude", "timestamp")] == [1, 1, 1, 3]


def test_inferred_types_give_the_same_rows(spark, raw_file):
    path = raw_file(
        "04/05/2024 00:00:01,A,219000001,55.5,10.25,1",
        "04/05/2024 00:00:02,A,219000001,55.6,10.25,2",
        "04/05/2024 00:00:02,A,219000002,55.6,,2",
    )
    assert from_spark(positions_csv(spark, path, infer=True)) == from_spark(positions_csv(spark, path))


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "04/05/2024 00:00:01,A,1,55.5,10.25,1\n")
    (tmp_path / "b.csv").write_text("# Timestamp,MMSI,Type of mobile,Latitude,Longitude,Speed\n04/05/2024 00:00:01,1,A,55.5,10.25,1\n")
    with pytest.raises(Exception, match="CSV header"):
        positions_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("derived", [clean, lambda df: edges(clean(df)), lambda df: totals(clean(df))])
def test_cleaning_reaches_the_parser(spark, raw_file, derived):
    path = raw_file("04/05/2024 00:00:01,A,219000001,55.5,10.25,1")
    plan = derived(positions_csv(spark, path))._jdf.queryExecution().executedPlan().toString()
    pushed = [part.split("]")[0] for part in plan.split("PushedFilters: [")[1:]]
    for part in pushed:
        for wanted in ("GreaterThanOrEqual(Latitude,-90.0)", "LessThanOrEqual(Longitude,180.0)", "IsNotNull(# Timestamp)"):
            assert wanted in part
    assert pushed and "monotonically" not in plan


UNTIDY = ["219000001", "219000001.0", " 219000001", "219000001 ", " 219000001.00 "]
MALFORMED = ["", "none", "219000001.5", "2190 00001", "1e400"]


@pytest.mark.parametrize("infer", [False, True])
def test_untidy_numbers_are_kept_and_malformed_ones_dropped(spark, raw_file, infer):
    lines = [f"04/05/2024 00:00:{n:02},A,{mmsi}, 55.5,10.25 ,1" for n, mmsi in enumerate(UNTIDY + MALFORMED)]
    kept = clean(positions_csv(spark, raw_file(*lines), infer=infer)).collect()
    assert [(row["mmsi"], row["latitude"], row["longitude"]) for row in kept] == [(219000001, 55.5, 10.25)] * len(UNTIDY)


@pytest.mark.parametrize("infer", [False, True])
def test_columns_of_whole_doubles_are_numbers(spark, raw_file, infer):
    lines = [f"04/05/2024 00:00:0{n},A,{mmsi},55.5,10.25,1" for n, mmsi in enumerate(["219000001.0", "219000002", "219000003.5"])]
    kept = clean(positions_csv(spark, raw_file(*lines), infer=infer)).collect()
    assert [row["mmsi"] for row in kept] == [219000001, 219000002]


def test_available_columns(spark, raw_file):
    path = raw_file("04/05/2024 00:00:01,A,219000001,55.5,10.25,3.5")
    rows = columns_of(read_raw_csv(spark, path, infer=True)).orderBy("place").collect()
    assert [(row["name"], row["type"]) for row in rows][1:4] == [("Type of mobile", "string"), ("MMSI", "int"), ("Latitude", "double")]


def test_scan_reads_only_the_used_columns(spark, raw_file):
    path = raw_file("04/05/2024 00:00:01,A,219000001,55.5,10.25,1")
    df = clean(positions_csv(spark, path)).select("mmsi", "latitude")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Speed" not in plan and "Type of mobile" not in plan


def test_rows_without_numbers_get_none(spark, raw_file):
    line = "04/05/2024 00:00:01,A,219000001,55.5,10.25,1"
    positions = positions_csv(spark, raw_file(line, line, line))
    assert positions.columns == ["mmsi", "timestamp", "latitude", "longitude"] and positions.count() == 3


def test_months_are_ordered_as_time_not_as_text(spark, raw_file):
    path = raw_file(
        "01/05/2024 00:00:00,A,1,50.2,5,",
        "30/04/2024 23:59:00,A,1,50.1,5,",
        "30/04/2024 23:58:00,A,1,50.0,5,",
    )
    row = totals(clean(positions_csv(spark, path))).collect()[0]
    assert round(row["total_distance_km"], 6) == 22.2


@pytest.mark.parametrize("zone", ["UTC", "Europe/Copenhagen", "America/New_York"])
def test_times_ignore_the_session_zone(spark, zone):
    texts = ["31/03/2024 02:30:00", "27/10/2024 02:30:00.000001", "10/03/2024 02:30:00.5", "01/01/1969 00:00:00"]
    times = [
        dt.datetime(2024, 3, 31, 2, 30),
        dt.datetime(2024, 10, 27, 2, 30, 0, 1),
        dt.datetime(2024, 3, 10, 2, 30, 0, 500000),
        dt.datetime(1969, 1, 1),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(text,) for text in texts], "text string")
        parsed = df.select("text", parse_report_time(F.col("text")).alias("time"))
        back = parsed.select("text", "time", format_report_time(F.col("time")).alias("again")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [row["time"] for row in back] == times
    assert [row["again"] for row in back] == texts


@pytest.mark.parametrize(
    "text",
    ["", "04/05/2024", "04/05/2024 00:00", "4/5/2024 00:00:00", "04-05-2024 00:00:00", "04/13/2024 00:00:00",
     "04/05/2024 24:00:00", "04/05/2024 00:61:00", "04/05/2024 00:00:00 UTC", "04/05/2024 00:00:00.1234567", "xx/yy/zzzz 00:00:00"],
)
def test_malformed_times_are_null(spark, raw_file, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(parse_report_time(F.col("text"))).collect()[0][0] is None
    path = raw_file(f"{text},A,219000001,55.5,10.25,1")
    row = positions_csv(spark, path).collect()[0]
    assert row["timestamp"] is None and row["mmsi"] == 219000001 and row["longitude"] == 10.25


@pytest.mark.parametrize("zone", ["UTC", "Europe/Copenhagen", "America/New_York"])
@pytest.mark.parametrize("infer", [False, True])
def test_file_times_ignore_the_session_zone(spark, raw_file, zone, infer):
    path = raw_file(
        "31/03/2024 02:30:00,A,1,55.5,10.25,1",
        "27/10/2024 02:30:00.000001,A,2,55.5,10.25,1",
        "10/03/2024 02:30:00.5,A,3,55.5,10.25,1",
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = positions_csv(spark, path, infer=infer).orderBy("mmsi").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [row["timestamp"] for row in rows] == [
        dt.datetime(2024, 3, 31, 2, 30),
        dt.datetime(2024, 10, 27, 2, 30, 0, 1),
        dt.datetime(2024, 3, 10, 2, 30, 0, 500000),
    ]


def test_events_counts(spark):
    positions = positions_events(spark, f"{TESTDATA}/sf0.01")
    assert positions.count() == 10000
    assert positions.where("latitude is null or longitude is null").count() == 206
    assert clean(positions).count() == 9606


def test_round_trip_through_files(spark, tmp_path):
    positions = positions_events(spark, f"{TESTDATA}/sf0.001")
    path = str(tmp_path / "trip")
    write_positions_csv(positions, path)
    assert from_spark(positions_csv(spark, path)) == from_spark(positions)
    assert from_spark(positions_csv(spark, path, infer=True)) == from_spark(positions)
