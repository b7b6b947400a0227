"""Column expressions shared by the operators. All are Spark built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def stretch_of(time: Column, seconds: int) -> Column:
    """The number of the stretch of so many seconds that a time without zone falls into."""
    of_day = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    since = F.unix_date(time.cast("date")).cast("bigint") * SECONDS_PER_DAY + of_day
    return F.floor(since / F.lit(seconds))


def whole_number(value: Column) -> Column:
    """A number, or a text of one, as 64-bit integer; null if it is none or has a fraction."""
    number = value.try_cast("double")
    fits = (number == F.floor(number)) & (F.abs(number) < F.lit(2.0**53))
    digits = value.cast("string").try_cast("bigint")
    return F.coalesce(digits, F.when(fits, number.try_cast("bigint")))


def fixed_decimals(value: Column, decimals: int, width: int = 0) -> Column:
    """Fixed decimals, rounded from the exact binary value, padded on the left."""
    text = F.call_function("format_number", value, F.lit(f"0.{'0' * decimals}"))
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def grouped_digits(value: Column, width: int = 0) -> Column:
    """A whole number with commas between thousands, padded on the left."""
    text = F.format_number(value, 0)
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def parse_report_time(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss[.SSSSSS]`` to a time without zone; null if malformed.

    Putting the date in ISO order and casting takes no session time zone into
    account, so no local time can be shifted.
    """
    iso = F.concat(
        F.substring(text, 7, 4),
        F.lit("-"),
        F.substring(text, 4, 2),
        F.lit("-"),
        F.substring(text, 1, 2),
        F.substring(text, 11, 16),
    )
    marks = F.concat(*[F.substring(text, at, 1) for at in (3, 6, 11, 14, 17, 20)])
    whole = (marks == "// ::") & (F.length(text) == 19)
    split = (marks == "// ::.") & F.length(text).between(21, 26)
    return F.when(whole | split, iso.try_cast("timestamp_ntz"))


def format_report_time(time: Column) -> Column:
    """The inverse of :func:`parse_report_time`."""
    iso = time.cast("string")
    return F.concat(
        F.substring(iso, 9, 2),
        F.lit("/"),
        F.substring(iso, 6, 2),
        F.lit("/"),
        F.substring(iso, 1, 4),
        F.substring(iso, 11, 16),
    )


def planar_km(lat_diff: Column, lon_diff: Column, km_per_deg_lat: float, km_per_deg_lon: float) -> Column:
    """Length of a coordinate difference in kilometres on a flat grid."""
    return F.sqrt(F.pow(lat_diff * F.lit(km_per_deg_lat), F.lit(2.0)) + F.pow(lon_diff * F.lit(km_per_deg_lon), F.lit(2.0)))


def hash_below(key: Column, fraction: float) -> Column:
    """True for a fixed share of keys, the same ones on any partitioning."""
    if fraction >= 1:
        return F.lit(True)
    threshold = format(int(max(fraction, 0.0) * 2**32), "08x")
    return F.substring(F.md5(key), 1, 8) < F.lit(threshold)


def ranking_line(rank: Column, status: Column, mmsi: Column, total_km: Column, reports: Column) -> Column:
    # Fixed output format of one line of the ranking.
    return F.concat(
        F.format_string("%2d. %s MMSI: %d | Distance: ", rank, status, mmsi),
        fixed_decimals(total_km, 2, 6),
        F.lit(" km | Reports: "),
        grouped_digits(reports, 4),
    )
