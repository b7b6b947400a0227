"""From cleaned reports to the lengths of the steps between them.

A vessel's history is cut at fixed times into stretches of ``RouteParams.stretch_seconds``.
A window holds one stretch of one vessel, so a vessel that owns a large part of the table is
spread over tasks; the step into a stretch comes from a table with one row per stretch. The
length of the stretches changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.columns import planar_km, stretch_of
from wakeline.params import DEFAULTS, RouteParams

# Reports of one vessel are ordered by time; reports of the same time by place, so that
# neither the partitioning nor the numbering of rows can change a result.
TRAVEL_ORDER = ("timestamp", "latitude", "longitude", "event_id")
STRETCH = ("mmsi", "stretch")


def travel_order(positions: DataFrame) -> list[str]:
    return [name for name in TRAVEL_ORDER if name in positions.columns]


def with_previous(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """The cleaned reports that have a previous one, with its position.

    Both branches read one shuffle of the reports: the windows over stretches, and the
    closing positions, whose rows, one per stretch, are shuffled once more by vessel.
    """
    cut = positions.withColumn("stretch", stretch_of(F.col("timestamp"), params.stretch_seconds))
    inside = Window.partitionBy(*STRETCH).orderBy(*travel_order(positions))
    paired = cut.withColumns(
        {
            "prev_lat": F.lag("latitude").over(inside),
            "prev_lon": F.lag("longitude").over(inside),
            "next_lat": F.lead("latitude").over(inside),
        }
    )
    by_vessel = Window.partitionBy("mmsi").orderBy("stretch")
    entering = (
        paired.where(F.col("next_lat").isNull())
        .select(*STRETCH, F.lag("latitude").over(by_vessel).alias("entry_lat"), F.lag("longitude").over(by_vessel).alias("entry_lon"))
        .where(F.col("entry_lat").isNotNull())
    )
    opens = F.col("prev_lat").isNull()
    joined = paired.join(entering, list(STRETCH), "left").withColumns(
        {
            "prev_lat": F.when(opens, F.col("entry_lat")).otherwise(F.col("prev_lat")),
            "prev_lon": F.when(opens, F.col("entry_lon")).otherwise(F.col("prev_lon")),
        }
    )
    return joined.where(F.col("prev_lat").isNotNull()).select(*positions.columns, "prev_lat", "prev_lon")


def coord_deltas(steps: DataFrame) -> DataFrame:
    """Absolute coordinate differences in degrees; 180 degrees east is not wrapped."""
    return steps.withColumns(
        {
            "lat_diff": F.abs(F.col("latitude") - F.col("prev_lat")),
            "lon_diff": F.abs(F.col("longitude") - F.col("prev_lon")),
        }
    )


def edge_distance(deltas: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    distance = planar_km(F.col("lat_diff"), F.col("lon_diff"), params.km_per_deg_lat, params.km_per_deg_lon)
    return deltas.withColumn("distance_km", distance)


def drop_jumps(edges: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Drop the step, not the report: an outlier costs the steps to and from it."""
    return edges.where(F.col("distance_km") < F.lit(params.max_jump_km))


def kept_km(lat: str, lon: str, from_lat: str, from_lon: str, params: RouteParams) -> Column:
    """Length of a step that is no jump; null for a jump or without a previous position."""
    lat_diff, lon_diff = F.abs(F.col(lat) - F.col(from_lat)), F.abs(F.col(lon) - F.col(from_lon))
    km = planar_km(lat_diff, lon_diff, params.km_per_deg_lat, params.km_per_deg_lon)
    return F.when(km < F.lit(params.max_jump_km), km)


def stretch_summary(positions: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Reports, kept steps and their kilometres inside each stretch, with its first and last position.

    The reports are shuffled once, by vessel and stretch; windows and sums both use that. Copies,
    equal in vessel, time and place, follow each other in a window, which streams and spills. With
    ``count_copies_first`` a shuffle that combines on the map side makes each one row with its
    count; the steps between copies are 0 km long.
    """
    copied = F.when(F.lit(0.0) < F.lit(params.max_jump_km), F.col("copies") - 1).otherwise(F.lit(0))
    stretch = stretch_of(F.col("timestamp"), params.stretch_seconds)
    place = ("mmsi", "timestamp", "latitude", "longitude")
    if params.count_copies_first:
        distinct = positions.groupBy(*place).agg(F.count(F.lit(1)).alias("copies"))
    else:
        distinct = positions.select(*place, F.lit(1).cast("bigint").alias("copies"))
    inside = Window.partitionBy(*STRETCH).orderBy("timestamp", "latitude", "longitude")
    paired = distinct.withColumn("stretch", stretch).withColumns(
        {
            "prev_lat": F.lag("latitude").over(inside),
            "prev_lon": F.lag("longitude").over(inside),
            "next_lat": F.lead("latitude").over(inside),
        }
    )
    measured = paired.withColumn("km", kept_km("latitude", "longitude", "prev_lat", "prev_lon", params))
    first, last = F.col("prev_lat").isNull(), F.col("next_lat").isNull()
    return measured.groupBy(*STRETCH).agg(
        F.sum("copies").alias("reports"),
        F.sum("km").alias("km"),
        F.count("km").alias("moves"),
        F.sum(copied).alias("rests"),
        *[F.max(F.when(first, F.col(name))).alias(f"first_{short}") for name, short in (("latitude", "lat"), ("longitude", "lon"))],
        *[F.max(F.when(last, F.col(name))).alias(f"last_{short}") for name, short in (("latitude", "lat"), ("longitude", "lon"))],
    )


def vessel_summary(stretches: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """Reports, kilometres and kept steps of every vessel, moved or not.

    One row per vessel holds all that the counts and the ranking need. The kilometres of a
    vessel without a kept step are null.
    """
    by_vessel = Window.partitionBy("mmsi").orderBy("stretch")
    entered = stretches.withColumns(
        {"entry_lat": F.lag("last_lat").over(by_vessel), "entry_lon": F.lag("last_lon").over(by_vessel)}
    ).withColumn("entry_km", kept_km("first_lat", "first_lon", "entry_lat", "entry_lon", params))
    steps = F.sum("moves") + F.sum("rests") + F.count("entry_km")
    km = F.coalesce(F.sum("km"), F.lit(0.0)) + F.coalesce(F.sum("entry_km"), F.lit(0.0))
    return entered.groupBy("mmsi").agg(
        F.sum("reports").alias("reports"),
        F.when(steps > 0, km).alias("total_distance_km"),
        steps.alias("position_count"),
    )
