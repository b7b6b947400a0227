"""Schemas of the tables that pass between the steps."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("mmsi", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

STEP = T.StructType(
    POSITION.fields
    + [
        T.StructField("prev_lat", T.DoubleType()),
        T.StructField("prev_lon", T.DoubleType()),
    ]
)

EDGE = T.StructType(
    STEP.fields
    + [
        T.StructField("lat_diff", T.DoubleType()),
        T.StructField("lon_diff", T.DoubleType()),
        T.StructField("distance_km", T.DoubleType()),
    ]
)

# position_count is the number of kept edges, not of reports: the first report
# of a vessel and every dropped jump are missing from it.
VESSEL = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("total_distance_km", T.DoubleType()),
        T.StructField("position_count", T.LongType()),
    ]
)
