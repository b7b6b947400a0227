"""Position reports in CSV files with a header row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions.columns import format_report_time, parse_report_time, whole_number

# Fixed header names of the raw files, and the form of their times.
RAW_MMSI = "MMSI"
RAW_TIME = "# Timestamp"
RAW_LATITUDE = "Latitude"
RAW_LONGITUDE = "Longitude"
RAW_TIME_FORMAT = "dd/MM/yyyy HH:mm:ss[.SSSSSS]"

# Vessel numbers stay text, as files write some of them with decimals.
RAW_TYPES = {
    RAW_MMSI: T.StringType(),
    RAW_TIME: T.TimestampNTZType(),
    RAW_LATITUDE: T.DoubleType(),
    RAW_LONGITUDE: T.DoubleType(),
    "event_id": T.LongType(),
}


def read_raw_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """All columns of the files, under their header names and in any order.

    Spark reads one line to learn the names and gives the columns used here their
    types, so that each value is parsed once, a malformed one becomes null, and the
    filters of the cleaning reach the parser. Every file must have the same header.
    With ``infer`` Spark finds the types itself, by one more pass over the data;
    it leaves the times as text.
    """
    reader = spark.read.option("header", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(name, RAW_TYPES.get(name, T.StringType())) for name in names])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("timestampNTZFormat", RAW_TIME_FORMAT)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def project_raw(raw: DataFrame) -> DataFrame:
    """The position columns of a raw table, from text or from typed columns.

    Blanks around a value do not matter, and a vessel number may have decimals that are all
    0. A value that cannot be converted becomes null. ``event_id`` is there only if the raw
    table has it.
    """
    time = F.col(f"`{RAW_TIME}`")
    if isinstance(raw.schema[RAW_TIME].dataType, T.StringType):
        time = parse_report_time(F.trim(time))
    else:
        time = time.cast("timestamp_ntz")
    numbers = [whole_number(F.col("event_id")).alias("event_id")] if "event_id" in raw.columns else []
    return raw.select(
        *numbers,
        whole_number(F.col(RAW_MMSI)).alias("mmsi"),
        time.alias("timestamp"),
        F.col(RAW_LATITUDE).try_cast("double").alias("latitude"),
        F.col(RAW_LONGITUDE).try_cast("double").alias("longitude"),
    )


def positions_lines(lines: DataFrame, header: str, infer: bool = False) -> DataFrame:
    """Positions from CSV lines in the one column of ``lines``, whose names the header gives.

    The typed columns are parsed at once; with ``infer`` all columns are read as text and
    converted afterwards. The rows are the same.
    """
    names = header.split(",")
    types = {name: T.StringType() if infer else RAW_TYPES.get(name, T.StringType()) for name in names}
    schema = ", ".join(f"`{name}` {kind.simpleString()}" for name, kind in types.items())
    options = {"timestampNTZFormat": RAW_TIME_FORMAT, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = F.from_csv(F.col(f"`{lines.columns[0]}`"), schema, options)
    return project_raw(lines.select(parsed.alias("raw")).select("raw.*"))


def positions_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    return project_raw(read_raw_csv(spark, path, infer))


def as_raw(positions: DataFrame) -> DataFrame:
    """Positions as the text columns of a raw file."""
    numbers = [F.col("event_id").cast("string").alias("event_id")] if "event_id" in positions.columns else []
    return positions.select(
        format_report_time(F.col("timestamp")).alias(RAW_TIME),
        F.col("mmsi").cast("string").alias(RAW_MMSI),
        F.col("latitude").cast("string").alias(RAW_LATITUDE),
        F.col("longitude").cast("string").alias(RAW_LONGITUDE),
        *numbers,
    )


def write_raw_csv(raw: DataFrame, path: str) -> None:
    """Write a raw table as it is, blanks around values included, one file per partition."""
    writer = raw.write.mode("errorifexists").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path, header=True)


def write_positions_csv(positions: DataFrame, path: str) -> None:
    """Write positions in the raw form, one file per partition."""
    write_raw_csv(as_raw(positions), path)


def columns_of(df: DataFrame) -> DataFrame:
    """The available columns: place, name and type."""
    rows = [(at, field.name, field.dataType.simpleString()) for at, field in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, type string")
