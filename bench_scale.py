"""Times the flagship on generated positions: even, with a hot vessel, with copies.

``SCALE_ROWS`` reports (20 million by default) go to Parquet once for each shape; then
``top_routes`` and a plain window per vessel run on ``local[BENCH_CPUS]``. One JSON line for
each shape has the seconds of the second runs, and whether the results are the same.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.window import Window  # noqa: E402

from wakeline.operators.aggregate import vessel_distance  # noqa: E402
from wakeline.operators.clean import clean  # noqa: E402
from wakeline.operators.report import top  # noqa: E402
from wakeline.operators.trajectory import coord_deltas, drop_jumps, edge_distance  # noqa: E402
from wakeline.plans import top_routes  # noqa: E402

ROWS = int(os.environ.get("SCALE_ROWS", "20000000"))
CPUS = os.environ.get("BENCH_CPUS", "8")
SHAPES = ("even", "hot", "copies")
VESSELS = 5000


def positions(spark: SparkSession, shape: str) -> DataFrame:
    """Thirty days of reports; ``hot`` gives one vessel a third, ``copies`` makes these one report."""
    n = F.col("id")
    hot = (n % 3 == 0) & F.lit(shape != "even")
    same = hot & F.lit(shape == "copies")
    vessel = F.when(hot, F.lit(7)).otherwise(100 + F.pmod(F.xxhash64(n), F.lit(VESSELS)))
    second = F.when(same, F.lit(1000)).otherwise(F.pmod(F.xxhash64(n, F.lit(1)), F.lit(30 * 86_400)))
    place = F.when(same, F.lit(0)).otherwise(F.pmod(F.xxhash64(n, F.lit(2)), F.lit(1000)))
    return spark.range(0, ROWS, numPartitions=64).select(
        vessel.cast("bigint").alias("mmsi"),
        F.timestamp_seconds(F.lit(1_714_780_800) + second).cast("timestamp_ntz").alias("timestamp"),
        (F.lit(54.0) + place / F.lit(2000.0)).alias("latitude"),
        (F.lit(8.0) + place / F.lit(3000.0)).alias("longitude"),
    )


def plain_window(rows: DataFrame) -> DataFrame:
    """The same routes with one window partition for each vessel."""
    by_vessel = Window.partitionBy("mmsi").orderBy("timestamp", "latitude", "longitude")
    paired = rows.withColumns({"prev_lat": F.lag("latitude").over(by_vessel), "prev_lon": F.lag("longitude").over(by_vessel)})
    steps = paired.where("prev_lat is not null")
    return top(vessel_distance(drop_jumps(edge_distance(coord_deltas(steps)))))


def timed(work) -> tuple[float, list]:
    work()
    start = time.perf_counter()
    rows = [(row["mmsi"], round(row["total_distance_km"], 3), row["position_count"]) for row in work()]
    return round(time.perf_counter() - start, 2), rows


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", "64")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="scale-") as folder:
        for shape in SHAPES:
            path = f"{folder}/{shape}"
            positions(spark, shape).write.parquet(path)
            rows = clean(spark.read.parquet(path))
            cut, found = timed(lambda: top_routes(rows).collect())
            plain, expected = timed(lambda: plain_window(rows).collect())
            print(json.dumps({"shape": shape, "rows": ROWS, "stretches_s": cut, "plain_window_s": plain, "same": found == expected}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
