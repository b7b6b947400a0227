"""Removal of reports with missing or impossible values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.params import DEFAULTS, RouteParams

REQUIRED = ("mmsi", "timestamp", "latitude", "longitude")


def not_null(positions: DataFrame) -> DataFrame:
    present = F.lit(True)
    for name in REQUIRED:
        present = present & F.col(name).isNotNull()
    return positions.where(present)


def in_bounds(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Both ends of the ranges are allowed; NaN is not, Spark sorts it last."""
    return positions.where(
        F.col("latitude").between(params.min_latitude, params.max_latitude)
        & F.col("longitude").between(params.min_longitude, params.max_longitude)
    )


def clean(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Both filters; Spark merges them into one and pushes it to the scan."""
    return in_bounds(not_null(positions), params)
