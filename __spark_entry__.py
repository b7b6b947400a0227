"""

same result in SQL for DuckDB. Sums and roots of doubles differ between the two
engines in the last bits, so computed doubles are rounded to 6 places in both.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wakeline.operators import aggregate, clean, report, sampling, trajectory  # noqa: E402
from wakeline.params import DEFAULTS, RouteParams  # noqa: E402
from wakeline.plans import edges, steps, summary, top_routes, totals  # noqa: E402
from wakeline.sources import (  # noqa: E402
    as_raw,
    columns_of,
    positions_csv,
    positions_events,
    positions_lines,
    project_raw,
    read_raw_csv,
    shared_folder,
    write_raw_csv,
    written,
)

try:  # the corpus operators are an optional part
    import corpus_pipeline
    from wakeline.llm import queries as corpus
except ImportError:
    corpus_pipeline = corpus = None

Query = Callable[[SparkSession, str], DataFrame]

# All top-10 totals at sf0.01 exceed the usual 1000 km; 1320 km gives a mixed list.
MIXED = replace(DEFAULTS, realistic_km=1320.0)
# Half of the reports is enough for the sampled routes to differ from the full ones.
HALF = 0.5


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(positions_events(spark, sf_dir))


# A short stretch cuts the histories of the test tables at many places.
NARROW = replace(DEFAULTS, stretch_seconds=3600)
CSV_HEADER = "# Timestamp,MMSI,Latitude,Longitude,event_id"


def raw_events(spark: SparkSession, sf_dir: str, untidy: bool = False) -> DataFrame:
    """The events as text columns of a raw file, some with blanks and decimals in them."""
    raw = as_raw(positions_events(spark, sf_dir))
    if not untidy:
        return raw
    number = F.col("event_id").cast("bigint") % 4
    mmsi = F.when(number == 1, F.concat("MMSI", F.lit(".0"))).when(number == 2, F.concat(F.lit(" "), "MMSI"))
    bad = F.col("event_id").cast("bigint") % 50 == 7
    return raw.withColumns(
        {
            "MMSI": F.when(bad, F.lit("none")).otherwise(mmsi.when(number == 3, F.concat("MMSI", F.lit(" "))).otherwise(F.col("MMSI"))),
            "Latitude": F.concat(F.lit(" "), "Latitude"),
            "Longitude": F.concat("Longitude", F.lit(" ")),
        }
    )


def csv_folder(spark: SparkSession, sf_dir: str, untidy: bool = False) -> str:
    path = shared_folder(spark, "events-csv")
    write_raw_csv(raw_events(spark, sf_dir, untidy), path)
    return path


def csv_files(infer: bool = False, untidy: bool = False) -> Query:
    """Positions scanned from CSV files that the events are written to, with given or inferred types."""
    return lambda spark, sf_dir: positions_csv(spark, csv_folder(spark, sf_dir, untidy), infer)


def csv_columns(infer: bool) -> Query:
    """The available columns of these files, and their types."""
    return lambda spark, sf_dir: columns_of(read_raw_csv(spark, csv_folder(spark, sf_dir), infer))


def csv_lines(untidy: bool = False) -> Query:
    """Positions parsed from CSV lines made of the events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = raw_events(spark, sf_dir, untidy)
        texts = [F.coalesce(F.col(f"`{name}`"), F.lit("")) for name in CSV_HEADER.split(",")]
        return positions_lines(raw.select(F.concat_ws(",", *texts).alias("line")), CSV_HEADER)

    return run


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned positions with times cut to the hour, so that many share one."""
    return cleaned(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))


def bernoulli_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every Bernoulli sample of the cleaned positions: their number, and a row of truths."""
    positions = cleaned(spark, sf_dir)

    def marked(rows: DataFrame, name: str) -> DataFrame:
        marks = [F.lit(int(name == other)).alias(other) for other in ("given", "drawn", "again")]
        return rows.select("event_id", *marks)

    rows = marked(positions, "given")
    for name in ("drawn", "again"):
        rows = rows.unionByName(marked(sampling.bernoulli(positions), name))
    counts = rows.groupBy("event_id").agg(*[F.sum(name).alias(name) for name in ("given", "drawn", "again")])
    share, fraction = F.sum("drawn") / F.sum("given"), DEFAULTS.sample_fraction
    band = F.lit(5.0) * F.sqrt(F.lit(fraction * (1 - fraction)) / F.sum("given"))
    return counts.agg(
        F.sum("given").alias("positions"),
        (F.abs(share - F.lit(fraction)) <= band).alias("share_in_band"),
        F.bool_and(F.col("drawn") <= F.col("given")).alias("drawn_from_input"),
        (F.max("drawn") <= 1).alias("none_twice"),
        F.bool_and(F.col("drawn") == F.col("again")).alias("same_again"),
    )


def project_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_raw(as_raw(positions_events(spark, sf_dir)))


def coord_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = steps(cleaned(spark, sf_dir))
    return trajectory.coord_deltas(paired).select("event_id", "mmsi", "lat_diff", "lon_diff")


def edge_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(edges(cleaned(spark, sf_dir)).select("event_id", "mmsi", "distance_km"), "distance_km")


def drop_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trajectory.drop_jumps(edges(cleaned(spark, sf_dir)))
    return rounded(kept.select("event_id", "mmsi", "distance_km"), "distance_km")


def vessel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(totals(cleaned(spark, sf_dir)), "total_distance_km")


def vessel_distance_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals with every history cut into many stretches."""
    return rounded(totals(cleaned(spark, sf_dir), NARROW), "total_distance_km")


def vessel_distance_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals from the rows of all steps."""
    kept = trajectory.drop_jumps(edges(cleaned(spark, sf_dir)))
    return rounded(aggregate.vessel_distance(kept), "total_distance_km")


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.run_counts(summary(cleaned(spark, sf_dir)))


def sample_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.run_counts(summary(sampling.by_hash(cleaned(spark, sf_dir))))


def top_vessels_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(top_routes(hourly(spark, sf_dir)), "total_distance_km")


def whole_report(params: RouteParams, fraction: float | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        positions = cleaned(spark, sf_dir)
        sample = positions if fraction is None else sampling.by_hash(positions, fraction)
        return report.whole_report(written(summary(sample, params), "summary"), params, fraction)

    return run


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.moved(summary(cleaned(spark, sf_dir))), "total_distance_km")


def top_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(top_routes(cleaned(spark, sf_dir)), "total_distance_km")


def sampled_top_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sampling.by_hash(cleaned(spark, sf_dir), HALF)
    return rounded(top_routes(sample), "total_distance_km")


def longest_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.longest(top_routes(cleaned(spark, sf_dir))), "total_distance_km")


def realistic_of_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.realistic(top_routes(cleaned(spark, sf_dir)), MIXED), "total_distance_km")


def realistic_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = report.realistic_longest(top_routes(cleaned(spark, sf_dir)), MIXED)
    return rounded(route, "total_distance_km", "avg_speed_kmh")


def route_answer(params: RouteParams) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(report.answer(top_routes(cleaned(spark, sf_dir)), params), "total_distance_km")

    return run


def status_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = report.status_rank(top_routes(cleaned(spark, sf_dir)), MIXED)
    return rounded(ranked, "total_distance_km")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranking_lines(report.status_rank(top_routes(cleaned(spark, sf_dir)), MIXED))


def report_headlines(params: RouteParams) -> Query:
    return lambda spark, sf_dir: report.headlines(top_routes(cleaned(spark, sf_dir)), params)


def entry(spark: SparkSession) -> DataFrame:
    """The ten longest routes of the smallest data set."""
    return top_vessels(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    added = {**corpus.queries(), "pipeline": corpus_pipeline.run} if corpus else {}
    return {**added, **own_queries()}


def own_queries() -> dict[str, Query]:
    return {
        "scan_positions_csv": csv_files(),
        "scan_positions_csv_inferred": csv_files(infer=True),
        "scan_positions_csv_untidy": csv_files(untidy=True),
        "scan_positions_csv_untidy_inferred": csv_files(infer=True, untidy=True),
        "parse_csv_lines": csv_lines(),
        "parse_csv_lines_untidy": csv_lines(untidy=True),
        "csv_columns": csv_columns(infer=False),
        "csv_columns_inferred": csv_columns(infer=True),
        "table_columns": lambda spark, sf: columns_of(spark.read.parquet(f"{sf}/events.parquet")),
        "project_positions": project_positions,
        "filter_not_null": lambda spark, sf: clean.not_null(positions_events(spark, sf)),
        "filter_coord_bounds": lambda spark, sf: clean.in_bounds(positions_events(spark, sf)),
        "clean_positions": cleaned,
        "sample_hash": lambda spark, sf: sampling.by_hash(cleaned(spark, sf)),
        "sample_bernoulli": lambda spark, sf: sampling.bernoulli(cleaned(spark, sf)),
        "sample_bernoulli_checked": bernoulli_checked,
        "sample_profile": lambda spark, sf: aggregate.profile(sampling.by_hash(cleaned(spark, sf))),
        "sample_distinct_vessels": lambda spark, sf: aggregate.distinct_vessels(sampling.by_hash(cleaned(spark, sf))),
        "sample_run_counts": sample_run_counts,
        "profile": lambda spark, sf: aggregate.profile(cleaned(spark, sf)),
        "distinct_vessels": lambda spark, sf: aggregate.distinct_vessels(cleaned(spark, sf)),
        "lag_prev_position": lambda spark, sf: steps(cleaned(spark, sf)),
        "lag_prev_position_cut": lambda spark, sf: steps(cleaned(spark, sf), NARROW),
        "lag_prev_position_ties": lambda spark, sf: steps(hourly(spark, sf), NARROW),
        "coord_deltas": coord_deltas,
        "edge_distance": edge_distance,
        "drop_jumps": drop_jumps,
        "vessel_distance": vessel_distance,
        "vessel_distance_cut": vessel_distance_cut,
        "vessel_distance_steps": vessel_distance_steps,
        "vessels_count": lambda spark, sf: aggregate.vessels_count(totals(cleaned(spark, sf))),
        "run_counts": run_counts,
        "run_totals": run_totals,
        "top_vessels": top_vessels,
        "top_vessels_ties": top_vessels_ties,
        "sampled_top_vessels": sampled_top_vessels,
        "longest_route": longest_route,
        "realistic_of_top": realistic_of_top,
        "realistic_longest": realistic_longest,
        "route_answer": route_answer(DEFAULTS),
        "route_answer_mixed": route_answer(MIXED),
        "status_rank": status_rank,
        "report_lines": report_lines,
        "report_headlines": report_headlines(DEFAULTS),
        "report_headlines_mixed": report_headlines(MIXED),
        "whole_report": whole_report(DEFAULTS),
        "whole_report_mixed": whole_report(MIXED),
        "whole_report_sampled": whole_report(DEFAULTS, HALF),
    }


# Common table expressions of the oracle, each resting on the ones above it.
WITH_POSITIONS = """
WITH keyed AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
), positions AS (
  SELECT event_id, CAST(219000000 + user_id AS BIGINT) AS mmsi, ts AS "timestamp",
    CASE WHEN event_type = 'error' AND k < 5 THEN CAST(91 AS DOUBLE)
         WHEN event_type = 'error' AND k BETWEEN 5 AND 9 THEN NULL
         WHEN event_type = 'signup' AND k < 5 THEN CAST(57 AS DOUBLE) + value / CAST(1000 AS DOUBLE)
         ELSE CAST(54 AS DOUBLE) + value / CAST(1000 AS DOUBLE) END AS latitude,
    CASE WHEN event_type = 'error' AND k BETWEEN 10 AND 14 THEN CAST(181 AS DOUBLE)
         WHEN event_type = 'error' AND k BETWEEN 15 AND 19 THEN NULL
         ELSE CAST(8 AS DOUBLE) + k / CAST(200 AS DOUBLE) END AS longitude
  FROM keyed
)"""
PRESENT = 'mmsi IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND "timestamp" IS NOT NULL'
IN_BOUNDS = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"


def with_clean(threshold: str | None = None, time: str = '"timestamp"') -> str:
    sampled = f" AND substring(md5(CAST(event_id AS VARCHAR)), 1, 8) < '{threshold}'" if threshold else ""
    return f"""{WITH_POSITIONS}, cleaned AS (
  SELECT event_id, mmsi, {time} AS "timestamp", latitude, longitude
  FROM positions WHERE {PRESENT} AND {IN_BOUNDS}{sampled}
)"""


def with_steps(threshold: str | None = None, time: str = '"timestamp"') -> str:
    return f"""{with_clean(threshold, time)}, paired AS (
  SELECT *, lag(latitude) OVER w AS prev_lat, lag(longitude) OVER w AS prev_lon FROM cleaned
  WINDOW w AS (PARTITION BY mmsi ORDER BY "timestamp", latitude, longitude, event_id)
), steps AS (
  SELECT * FROM paired WHERE prev_lat IS NOT NULL
), deltas AS (
  SELECT *, abs(latitude - prev_lat) AS lat_diff, abs(longitude - prev_lon) AS lon_diff FROM steps
), edges AS (
  SELECT *, sqrt(pow(lat_diff * CAST(111 AS DOUBLE), 2) + pow(lon_diff * CAST(85 AS DOUBLE), 2)) AS distance_km
  FROM deltas
), kept AS (
  SELECT * FROM edges WHERE distance_km < 100
), totals AS (
  SELECT mmsi, sum(distance_km) AS total_distance_km, count(distance_km) AS position_count
  FROM kept GROUP BY mmsi HAVING sum(distance_km) > 0
), top AS (
  SELECT * FROM totals ORDER BY total_distance_km DESC, mmsi LIMIT 10
)"""


def with_ranked(km: int, threshold: str | None = None) -> str:
    return f"""{with_steps(threshold)}, ranked AS (
  SELECT row_number() OVER (ORDER BY total_distance_km DESC, mmsi) AS rank,
    CASE WHEN total_distance_km <= {km} THEN 'OK' ELSE 'CHECK' END AS status,
    mmsi, total_distance_km, position_count
  FROM top
)"""


def answer_sql(km: int) -> str:
    return f"""{with_steps()}
SELECT mmsi, round(total_distance_km, 6) AS total_distance_km, total_distance_km <= {km} AS is_realistic
FROM top ORDER BY total_distance_km <= {km} DESC, total_distance_km DESC, mmsi LIMIT 1"""


def with_headlines(km: int, threshold: str | None = None) -> str:
    return f"""{with_ranked(km, threshold)}, best AS (
  SELECT * FROM ranked WHERE rank = 1
), good AS (
  SELECT * FROM ranked WHERE status = 'OK' ORDER BY rank LIMIT 1
), doubtful AS (
  SELECT * FROM best WHERE NOT EXISTS (SELECT * FROM good)
), lines AS (
  SELECT 1 AS place, 'LONGEST ROUTE:' AS line FROM best
  UNION ALL SELECT 2, printf('MMSI: %d', mmsi) FROM best
  UNION ALL SELECT 3, printf('Distance: %.2f km', total_distance_km) FROM best
  UNION ALL SELECT 4, 'Position reports: ' || format('{{:,}}', position_count) FROM best
  UNION ALL SELECT 5, 'REALISTIC LONGEST ROUTE:' FROM good
  UNION ALL SELECT 6, printf('MMSI: %d', mmsi) FROM good
  UNION ALL SELECT 7, printf('Distance: %.2f km', total_distance_km) FROM good
  UNION ALL SELECT 8, 'Position reports: ' || format('{{:,}}', position_count) FROM good
  UNION ALL SELECT 9, printf('Average speed: %.1f km/h', total_distance_km / CAST(24 AS DOUBLE)) FROM good
  UNION ALL SELECT 10, 'ASSIGNMENT ANSWER:' FROM good
  UNION ALL SELECT 11, printf('Vessel with longest route: MMSI %d', mmsi) FROM good
  UNION ALL SELECT 12, printf('Total distance traveled: %.2f km', total_distance_km) FROM good
  UNION ALL SELECT 13, 'All routes contain potential errors. Best result:' FROM doubtful
  UNION ALL SELECT 14, printf('MMSI: %d', mmsi) FROM doubtful
  UNION ALL SELECT 15, printf('Distance: %.2f km', total_distance_km) FROM doubtful
  UNION ALL SELECT 16, 'No vessel routes found in the sample.' WHERE NOT EXISTS (SELECT * FROM best)
)"""


def headlines_sql(km: int) -> str:
    return f"{with_headlines(km)} SELECT row_number() OVER (ORDER BY place) AS line_no, line FROM lines"


RANKING_SQL = """printf('%2d. %s MMSI: %d | Distance: %6.2f km | Reports: ', rank, status, mmsi, total_distance_km)
  || repeat(' ', greatest(0, 4 - length(format('{:,}', position_count)))) || format('{:,}', position_count)"""


def whole_report_sql(km: int, threshold: str | None = None, percent: int | None = None) -> str:
    sampled = "FALSE" if percent is None else "TRUE"
    return f"""{with_headlines(km, threshold)}, all_lines AS (
  SELECT 0 AS part, 0 AS place, 'Taking {percent}.0% sample for processing...' AS line WHERE {sampled}
  UNION ALL SELECT 0, 1, 'Sample size: ' || format('{{:,}}', count(*)) || ' records' FROM cleaned
  UNION ALL SELECT 0, 2, 'Vessels in sample: ' || format('{{:,}}', count(DISTINCT mmsi)) FROM cleaned
  UNION ALL SELECT 0, 3, 'Calculated distances for ' || format('{{:,}}', count(*)) || ' vessels' FROM totals
  UNION ALL SELECT 1, place, line FROM lines
  UNION ALL SELECT 2, 0, 'TOP 10 VESSELS BY DISTANCE:' FROM best
  UNION ALL SELECT 3, rank, {RANKING_SQL} FROM ranked
  UNION ALL SELECT 4, 0, 'Notes:' FROM best
  UNION ALL SELECT 4, 1, '- OK = Realistic route (under 1000 km/day)' FROM best
  UNION ALL SELECT 4, 2, '- CHECK = May contain GPS errors' FROM best
  UNION ALL SELECT 4, 3, '- Analysis based on {percent}% sample of full dataset' FROM best WHERE {sampled}
)
SELECT row_number() OVER (ORDER BY part, place) AS line_no, line FROM all_lines"""


def counts_sql(threshold: str | None = None) -> str:
    return f"""{with_steps(threshold)}
SELECT (SELECT count(*) FROM cleaned) AS total_records,
  (SELECT count(DISTINCT mmsi) FROM cleaned) AS unique_vessels,
  (SELECT count(*) FROM totals) AS vessels"""


# The types of both engines, by name.
TYPE_SQL = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"
TABLE_COLUMNS_SQL = f"""SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS place, column_name AS name, {TYPE_SQL} AS type
FROM (DESCRIBE SELECT * FROM events)"""


def columns_sql(types: tuple[str, str, str]) -> str:
    """Columns of the CSV files of the events: types of the vessel number, the time and the coordinates."""
    mmsi, time, degrees = types
    event_id = "int" if mmsi == "int" else "bigint"
    return f"""
SELECT CAST(place AS INTEGER) AS place, name, CASE WHEN name = 'event_id' AND (SELECT max(event_id) FROM events) > 2147483647 THEN 'bigint' ELSE type END AS type
FROM (VALUES (0, '# Timestamp', '{time}'), (1, 'MMSI', '{mmsi}'), (2, 'Latitude', '{degrees}'), (3, 'Longitude', '{degrees}'),
  (4, 'event_id', '{event_id}')) AS c(place, name, type)"""


def oracle_sql() -> dict[str, str]:
    added = corpus.oracle_sql() if corpus else {}
    if corpus and corpus_pipeline.ORACLE_SQL:
        added["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**added, **own_oracle_sql()}


def own_oracle_sql() -> dict[str, str]:
    position = 'event_id, mmsi, "timestamp", latitude, longitude'
    route = "mmsi, round(total_distance_km, 6) AS total_distance_km, position_count"
    positions = f"{WITH_POSITIONS} SELECT {position} FROM positions"
    untidy = f"""{WITH_POSITIONS}
SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN mmsi END AS mmsi, "timestamp", latitude, longitude FROM positions"""
    hour = """date_trunc('hour', "timestamp")"""
    vessel_totals = f"{with_steps()} SELECT {route} FROM totals"
    return {
        "scan_positions_csv": positions,
        "scan_positions_csv_inferred": positions,
        "scan_positions_csv_untidy": untidy,
        "scan_positions_csv_untidy_inferred": untidy,
        "parse_csv_lines": positions,
        "parse_csv_lines_untidy": untidy,
        "csv_columns": columns_sql(("string", "timestamp_ntz", "double")),
        "csv_columns_inferred": columns_sql(("int", "string", "double")),
        "table_columns": TABLE_COLUMNS_SQL,
        "project_positions": positions,
        "filter_not_null": f"{positions} WHERE {PRESENT}",
        "filter_coord_bounds": f"{positions} WHERE {IN_BOUNDS}",
        "clean_positions": f"{with_clean()} SELECT {position} FROM cleaned",
        "sample_hash": f"{with_clean('19999999')} SELECT {position} FROM cleaned",
        "sample_profile": f"""{with_clean('19999999')}
SELECT count(*) AS total_records, count(DISTINCT mmsi) AS unique_vessels FROM cleaned""",
        "sample_bernoulli_checked": f"""{with_clean()}
SELECT CAST(count(*) AS BIGINT) AS positions, TRUE AS share_in_band, TRUE AS drawn_from_input, TRUE AS none_twice, TRUE AS same_again FROM cleaned""",
        "sample_distinct_vessels": f"{with_clean('19999999')} SELECT DISTINCT mmsi FROM cleaned",
        "profile": f"{with_clean()} SELECT count(*) AS total_records, count(DISTINCT mmsi) AS unique_vessels FROM cleaned",
        "distinct_vessels": f"{with_clean()} SELECT DISTINCT mmsi FROM cleaned",
        "lag_prev_position": f"{with_steps()} SELECT {position}, prev_lat, prev_lon FROM steps",
        "lag_prev_position_cut": f"{with_steps()} SELECT {position}, prev_lat, prev_lon FROM steps",
        "lag_prev_position_ties": f"{with_steps(time=hour)} SELECT {position}, prev_lat, prev_lon FROM steps",
        "coord_deltas": f"{with_steps()} SELECT event_id, mmsi, lat_diff, lon_diff FROM deltas",
        "edge_distance": f"""{with_steps()}
SELECT event_id, mmsi, round(distance_km, 6) AS distance_km FROM edges""",
        "drop_jumps": f"""{with_steps()}
SELECT event_id, mmsi, round(distance_km, 6) AS distance_km FROM kept""",
        "vessel_distance": vessel_totals,
        "vessel_distance_cut": vessel_totals,
        "vessel_distance_steps": vessel_totals,
        "vessels_count": f"{with_steps()} SELECT count(*) AS vessels FROM totals",
        "run_counts": counts_sql(),
        "sample_run_counts": counts_sql("19999999"),
        "run_totals": vessel_totals,
        "top_vessels": f"{with_steps()} SELECT {route} FROM top",
        "top_vessels_ties": f"{with_steps(time=hour)} SELECT {route} FROM top",
        "sampled_top_vessels": f"{with_steps('80000000')} SELECT {route} FROM top",
        "longest_route": f"{with_steps()} SELECT {route} FROM top ORDER BY top.total_distance_km DESC, mmsi LIMIT 1",
        "realistic_of_top": f"{with_steps()} SELECT {route} FROM top WHERE top.total_distance_km <= 1320",
        "realistic_longest": f"""{with_steps()}
SELECT {route}, round(total_distance_km / CAST(24 AS DOUBLE), 6) AS avg_speed_kmh
FROM top WHERE top.total_distance_km <= 1320 ORDER BY top.total_distance_km DESC, mmsi LIMIT 1""",
        "route_answer": answer_sql(1000),
        "route_answer_mixed": answer_sql(1320),
        "status_rank": f"""{with_ranked(1320)}
SELECT rank, status, mmsi, round(total_distance_km, 6) AS total_distance_km, position_count FROM ranked""",
        "report_lines": f"{with_ranked(1320)} SELECT rank, {RANKING_SQL} AS line FROM ranked",
        "report_headlines": headlines_sql(1000),
        "report_headlines_mixed": headlines_sql(1320),
        "whole_report": whole_report_sql(1000),
        "whole_report_mixed": whole_report_sql(1320),
        "whole_report_sampled": whole_report_sql(1000, "80000000", 50),
    }
