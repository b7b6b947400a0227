"""Counts and totals. Each combines on the map side before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.params import DEFAULTS, RouteParams


def profile(positions: DataFrame) -> DataFrame:
    """Number of reports and of vessels, in one pass."""
    return positions.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("mmsi").alias("unique_vessels"),
    )


def distinct_vessels(positions: DataFrame) -> DataFrame:
    return positions.select("mmsi").distinct()


def vessel_distance(edges: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Travelled kilometres and number of kept edges of each vessel that moved, from step rows."""
    totals = edges.groupBy("mmsi").agg(
        F.sum("distance_km").alias("total_distance_km"),
        F.count("distance_km").alias("position_count"),
    )
    return totals.where(F.col("total_distance_km") > F.lit(params.min_total_km))


def vessels_count(totals: DataFrame) -> DataFrame:
    return totals.agg(F.count(F.lit(1)).alias("vessels"))


def moved(summary: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """The rows that :func:`vessel_distance` would give."""
    return summary.where(F.col("total_distance_km") > F.lit(params.min_total_km)).drop("reports")


def run_counts(summary: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """:func:`profile` and :func:`vessels_count` side by side."""
    return summary.agg(
        F.coalesce(F.sum("reports"), F.lit(0)).cast("bigint").alias("total_records"),
        F.count(F.lit(1)).alias("unique_vessels"),
        F.count_if(F.col("total_distance_km") > F.lit(params.min_total_km)).alias("vessels"),
    )
