"""The longest routes and the text about them.

All functions but ``top`` take its result, at most ``n`` rows, so the rank over
one window partition and the single-row aggregates below stay small on any input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.functions.columns import fixed_decimals, grouped_digits, ranking_line
from wakeline.operators.aggregate import moved, run_counts
from wakeline.params import DEFAULTS, RouteParams


def by_length() -> list[Column]:
    return [F.col("total_distance_km").desc(), F.col("mmsi").asc()]


def is_realistic(params: RouteParams) -> Column:
    return F.col("total_distance_km") <= F.lit(params.realistic_km)


def top(totals: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    return totals.orderBy(*by_length()).limit(params.top_n)


def longest(top_rows: DataFrame) -> DataFrame:
    return top_rows.orderBy(*by_length()).limit(1)


def realistic(top_rows: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """The plausible ones of the longest routes, not of all routes."""
    return top_rows.where(is_realistic(params))


def realistic_longest(top_rows: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    speed = F.col("total_distance_km") / F.lit(params.hours)
    return longest(realistic(top_rows, params)).withColumn("avg_speed_kmh", speed)


def answer(top_rows: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """The longest plausible route; failing that, the longest; no row without routes."""
    return (
        top_rows.select("mmsi", "total_distance_km", is_realistic(params).alias("is_realistic"))
        .orderBy(F.col("is_realistic").desc(), *by_length())
        .limit(1)
    )


def status_rank(top_rows: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(*by_length())).cast("bigint")
    return top_rows.select(
        rank.alias("rank"),
        F.when(is_realistic(params), F.lit("OK")).otherwise(F.lit("CHECK")).alias("status"),
        "mmsi",
        "total_distance_km",
        "position_count",
    )


def ranking_lines(ranked: DataFrame) -> DataFrame:
    names = ("rank", "status", "mmsi", "total_distance_km", "position_count")
    return ranked.select("rank", ranking_line(*[F.col(name) for name in names]).alias("line"))


def headlines(top_rows: DataFrame, params: RouteParams = DEFAULTS) -> DataFrame:
    """The text above the ranking, one row per line, in the order of ``line_no``."""
    place = F.struct(F.col("total_distance_km"), -F.col("mmsi"))
    route = F.struct("mmsi", "total_distance_km", "position_count")
    picked = top_rows.agg(
        F.max_by(route, place).alias("best"),
        F.max_by(route, F.when(is_realistic(params), place)).alias("good"),
    )
    best, good = F.col("best"), F.col("good")
    speed = good["total_distance_km"] / F.lit(params.hours)

    def text(when: Column, *parts: str | Column) -> Column:
        return F.when(when, F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts]))

    def km(route: Column) -> Column:
        return fixed_decimals(route["total_distance_km"], 2)

    def vessel(route: Column) -> Column:
        return route["mmsi"].cast("string")

    def reports(route: Column) -> Column:
        return grouped_digits(route["position_count"])

    some, plausible = best.isNotNull(), good.isNotNull()
    doubtful = some & good.isNull()
    # Fixed wording and number formats of the report.
    lines = F.array(
        text(some, "LONGEST ROUTE:"),
        text(some, "MMSI: ", vessel(best)),
        text(some, "Distance: ", km(best), " km"),
        text(some, "Position reports: ", reports(best)),
        text(plausible, "REALISTIC LONGEST ROUTE:"),
        text(plausible, "MMSI: ", vessel(good)),
        text(plausible, "Distance: ", km(good), " km"),
        text(plausible, "Position reports: ", reports(good)),
        text(plausible, "Average speed: ", fixed_decimals(speed, 1), " km/h"),
        text(plausible, "ASSIGNMENT ANSWER:"),
        text(plausible, "Vessel with longest route: MMSI ", vessel(good)),
        text(plausible, "Total distance traveled: ", km(good), " km"),
        text(doubtful, "All routes contain potential errors. Best result:"),
        text(doubtful, "MMSI: ", vessel(best)),
        text(doubtful, "Distance: ", km(best), " km"),
        text(best.isNull(), "No vessel routes found in the sample."),
    )
    return picked.select(F.posexplode(F.filter(lines, lambda line: line.isNotNull())).alias("at", "line")).select(
        (F.col("at") + F.lit(1)).cast("bigint").alias("line_no"), "line"
    )


def count_lines(counts: DataFrame, fraction: float | None = None) -> DataFrame:
    """The lines about a run, from the one row of ``run_counts``; the share only of a sample."""
    share = [] if fraction is None else [F.lit(f"Taking {fraction * 100}% sample for processing...")]
    # Fixed wording of the report.
    lines = F.array(
        *share,
        F.concat(F.lit("Sample size: "), grouped_digits(F.col("total_records")), F.lit(" records")),
        F.concat(F.lit("Vessels in sample: "), grouped_digits(F.col("unique_vessels"))),
        F.concat(F.lit("Calculated distances for "), grouped_digits(F.col("vessels")), F.lit(" vessels")),
    )
    return counts.select(F.posexplode(lines).alias("at", "line"))


def notes(top_rows: DataFrame, fraction: float | None = None) -> DataFrame:
    """The lines below the ranking, none if it is empty; the last only of a sample."""
    # Fixed wording of the report.
    lines = ["Notes:", "- OK = Realistic route (under 1000 km/day)", "- CHECK = May contain GPS errors"]
    if fraction is not None:
        lines.append(f"- Analysis based on {fraction * 100:.0f}% sample of full dataset")
    some = top_rows.agg(F.count(F.lit(1)).alias("routes")).where("routes > 0")
    return some.select(F.posexplode(F.lit(lines)).alias("at", "line"))


def whole_report(summary: DataFrame, params: RouteParams = DEFAULTS, fraction: float | None = None) -> DataFrame:
    """Counts, headlines, ranking and notes, one row per line, in the order of ``line_no``.

    Everything comes from the one row per vessel of ``summary``; persist that to compute it
    once. There are at most 27 lines and ``top_n``.
    """
    top_rows = top(moved(summary, params), params)
    heading = top_rows.agg(F.count(F.lit(1)).alias("routes")).where("routes > 0")
    parts = [
        count_lines(run_counts(summary, params), fraction),
        headlines(top_rows, params).select(F.col("line_no").cast("int").alias("at"), "line"),
        heading.select(F.lit(0).alias("at"), F.lit(f"TOP {params.top_n} VESSELS BY DISTANCE:").alias("line")),
        ranking_lines(status_rank(top_rows, params)).select(F.col("rank").cast("int").alias("at"), "line"),
        notes(top_rows, fraction),
    ]
    lines = parts[0].withColumn("part", F.lit(0))
    for number, part in enumerate(parts[1:], 1):
        lines = lines.unionByName(part.withColumn("part", F.lit(number)))
    number = F.row_number().over(Window.orderBy("part", "at")).cast("bigint")
    return lines.select(number.alias("line_no"), "line")
