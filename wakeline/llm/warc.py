"""Not-modified revisits of a crawl, resolved against the full response they confirm.

A revisit is joined as of its time to the latest earlier full response of the same canonical
URL, its validators are checked against that response's, and its permitted headers replace
those of the response. Windows hold one URL and one stretch of time; what the stretches
before held last comes from a table with one row for each of them, so a URL that owns a
large part of the crawl is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Parameters that do not change the page, and headers that a 304 may not replace.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
NOT_REPLACED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical(url: Column) -> Column:
    """Host, path and sorted parameters; scheme, ``www.``/``m.``, default port, fragment and tracking go.

    A text that is no absolute URL is its own canonical form, without blanks around it.
    """
    part = [F.regexp_extract(url, PARTS, at) for at in range(5)]
    host = F.regexp_replace(F.regexp_replace(F.lower(part[2]), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.when(part[3] == "", F.lit("/")).otherwise(part[3])
    wanted = F.filter(F.split(F.substring(part[4], 2, 2**30), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    query = F.array_join(F.array_sort(wanted), "&")
    whole = F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(part[1] == "", F.trim(url)).otherwise(whole)


def entries(headers: Column) -> Column:
    """Headers as a sorted array of lower-case names and values."""
    pairs = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    return F.array_sort(F.transform(pairs, lambda pair: F.struct(F.lower(pair["key"]).alias("name"), pair["value"].alias("value"))))


def header(pairs: Column, name: str) -> Column:
    """The first value of a header, null if it is not there."""
    return F.get(F.filter(pairs, lambda pair: pair["name"] == name), F.lit(0))["value"]


def merged(full: Column, later: Column) -> Column:
    """The response's headers with those of the revisit that may replace them."""
    new = F.filter(later, lambda pair: ~pair["name"].isin(*NOT_REPLACED))
    names = F.transform(new, lambda pair: pair["name"])
    return F.array_sort(F.concat(F.filter(full, lambda pair: ~F.array_contains(names, pair["name"])), new))


def verdict(full: Column, later: Column) -> Column:
    """How validators agree: by entity tag (compared weakly), else by date of change."""

    def tag(pairs: Column) -> Column:
        return F.regexp_replace(header(pairs, "etag"), "^W/", "")

    both_tags = tag(full).isNotNull() & tag(later).isNotNull()
    both_dates = header(full, "last-modified").isNotNull() & header(later, "last-modified").isNotNull()
    return (
        F.when(both_tags, F.when(tag(full) == tag(later), F.lit("etag")).otherwise(F.lit("mismatch")))
        .when(both_dates, F.when(header(full, "last-modified") == header(later, "last-modified"), F.lit("last-modified")).otherwise(F.lit("mismatch")))
        .otherwise(F.lit("unvalidated"))
    )


def resolved(records: DataFrame, stretch_seconds: int = 86_400) -> DataFrame:
    """One row for each not-modified revisit, with the full response that it stands for.

    ``records`` has ``record_id bigint, url, at timestamp, kind, status int, headers map,
    digest``. Full responses are ``kind = 'response'`` with status 200, revisits are
    ``kind = 'revisit'`` with status 304; other records, and further columns, play no part.
    Result: ``record_id, canonical_url, at, response_id, validation, headers, digest``.
    ``validation`` is ``etag`` or ``last-modified`` if these agree, ``mismatch`` if not,
    ``unvalidated`` if the two have no validator in common, ``no response`` if there is no
    earlier one, or if URL or time are null. Headers and digest are given in the first two
    cases only. Of responses of one time the one with the greatest number counts; a response
    of the revisit's own time is not earlier. Repeated rows stay. ``stretch_seconds`` changes
    no result; a stretch of one URL is the most that meets in a task.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    revisit = (F.col("kind") == "revisit") & (F.col("status") == 304)
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    base = records.where(full | revisit).select(
        "record_id",
        canonical(F.col("url")).alias("canonical_url"),
        micros.alias("micros"),
        F.floor(micros / F.lit(stretch_seconds * 1_000_000)).alias("stretch"),
        F.col("at"),
        F.coalesce(revisit, F.lit(False)).alias("is_revisit"),
        entries(F.col("headers")).alias("pairs"),
        "digest",
    )
    whole = F.struct("micros", "record_id", "pairs", "digest")
    base = base.withColumn("full", F.when(~F.col("is_revisit"), whole))
    place = ["canonical_url", "stretch"]
    known = base.where("canonical_url is not null and micros is not null")

    earlier = Window.partitionBy(*place).orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    inside = known.withColumn("inside", F.max("full").over(earlier)).where("is_revisit")

    before = Window.partitionBy("canonical_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    last = known.groupBy(*place).agg(F.max("full").alias("last"))
    carried = last.select(*place, F.max("last").over(before).alias("carried"))
    joined = inside.join(carried, place, "left").withColumn("found", F.coalesce("inside", "carried"))
    lost = base.where("is_revisit and (canonical_url is null or micros is null)")
    rows = joined.select("record_id", "canonical_url", "at", "pairs", "found").unionByName(
        lost.select("record_id", "canonical_url", "at", "pairs", F.col("full").alias("found"))
    )
    found = F.col("found")
    checked = rows.withColumn(
        "validation", F.when(found.isNull(), F.lit("no response")).otherwise(verdict(found["pairs"], F.col("pairs")))
    )
    good = F.col("validation").isin("etag", "last-modified")
    return checked.select(
        "record_id",
        "canonical_url",
        "at",
        found["record_id"].alias("response_id"),
        "validation",
        F.when(good, merged(found["pairs"], F.col("pairs"))).alias("headers"),
        F.when(good, found["digest"]).alias("digest"),
    )
