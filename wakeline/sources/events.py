"""Position reports derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Given, so that no job has to read file footers to learn it.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def positions_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per event; the users are the vessels.

    With ``k`` the number in ``props``, ``error`` events with a small ``k`` carry the
    codes for "not available" or nulls, and ``signup`` events with a small ``k`` are
    outliers far to the north. Spark repeats these expressions in every filter that
    it moves to the scan, so they are kept short and free of regular expressions.
    """
    number = F.substring_index(F.substring_index("props", ":", -1), "}", 1)
    k = F.col("k")
    error = F.col("event_type") == "error"
    signup = F.col("event_type") == "signup"
    north = F.col("value") / F.lit(1000.0)
    base = F.when(signup & (k < 5), F.lit(57.0)).otherwise(F.lit(54.0))
    latitude = F.when(error & (k < 10), F.when(k < 5, F.lit(91.0))).otherwise(base + north)
    longitude = F.when(error & k.between(10, 19), F.when(k < 15, F.lit(181.0))).otherwise(F.lit(8.0) + k / F.lit(200.0))
    return (
        spark.read.schema(EVENTS)
        .parquet(f"{sf_dir}/events.parquet")
        .withColumn("k", number.try_cast("int"))
        .select(
            F.col("event_id"),
            (F.lit(219000000) + F.col("user_id")).cast("bigint").alias("mmsi"),
            F.col("ts").alias("timestamp"),
            latitude.alias("latitude"),
            longitude.alias("longitude"),
        )
    )
