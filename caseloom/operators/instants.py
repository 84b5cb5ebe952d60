"""Timestamps of mixed notation and zone into one unambiguous UTC instant.

Clock readings without a zone are matched as-of against the exploded intervals during which a zone kept one
offset: two intervals hold an ambiguous reading, none a skipped one, one gives the offset. The intervals are
kept per zone and local year as an array of a handful, so the match is one bounded broadcast lookup and the
large tables are never shuffled.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small

FIRST_YEAR, LAST_YEAR = 1990, 2034
_LOW_S = 631_152_000  # 1990-01-01T00:00Z
_HIGH_S = 2_051_222_400  # 2035-01-01T00:00Z
#: Fixed value: seconds from 1601 to 1970.
_TICK_EPOCH_S = 11_644_473_600
_EPOCH = dt.datetime(1970, 1, 1)

_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_ZONE = r"(Z|UTC|GMT|UT|(?:UTC|GMT)?[+-][0-9]{1,2}(?::?[0-9]{2})?)?"
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?"
#: Each notation as (pattern, order of its groups as year|month|day|hour|minute|second|fraction|half|zone|region).
_NOTATIONS = {
    "iso": (rf"(?i)^([0-9]{{4}})[-:/.]([0-9]{{1,2}})[-:/.]([0-9]{{1,2}})(?:T|\s+){_CLOCK}\s*{_ZONE}(?:\[([A-Za-z0-9_+/-]+)\])?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    "basic": (rf"(?i)^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})T([0-9]{{2}})([0-9]{{2}})(?:([0-9]{{2}})(?:[.,]([0-9]+))?)?\s*{_ZONE}(?:\[([A-Za-z0-9_+/-]+)\])?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    "slash": (rf"(?i)^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}),?\s+{_CLOCK}\s*(AM|PM)?\s*\(?{_ZONE}\)?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    "mail": (rf"(?i)^(?:[a-z]{{3,9}},?\s+)?([0-9]{{1,2}})\s+({_MONTHS})[a-z]*\.?,?\s+([0-9]{{4}}),?\s+{_CLOCK}\s*(AM|PM)?\s*\(?{_ZONE}\)?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    "words": (rf"(?i)^(?:[a-z]{{3,9}},\s+)?({_MONTHS})[a-z]*\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}}),?\s+{_CLOCK}\s*(AM|PM)?\s*\(?{_ZONE}\)?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
}
_DOTNET = r"(?i)^\\?/Date\((-?[0-9]{1,17})(?:[+-][0-9]{4})?\)\\?/$"
_BARE = r"^[0-9]{1,18}(?:\.[0-9]+)?$"


@lru_cache(maxsize=1024)
def _stretches(name: str) -> tuple[tuple[int, int, int], ...]:
    """(utc_from, utc_to, offset) of every stretch of one offset, 1989 to 2036; transitions found by bisection."""
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return ()
    offset = lambda s: int(dt.datetime.fromtimestamp(s, zone).utcoffset().total_seconds())
    start = int((dt.datetime(FIRST_YEAR - 1, 1, 1) - _EPOCH).total_seconds())
    end = int((dt.datetime(LAST_YEAR + 2, 1, 1) - _EPOCH).total_seconds())
    rows, since, now = [], start, offset(start)
    for s in range(start, end, 14 * 86_400):  # no zone changes twice within a fortnight
        lo, hi = s, s + 14 * 86_400
        if offset(hi) == now:
            continue
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
        rows.append((since, hi, now))
        since, now = hi, offset(hi)
    return (*rows, (since, end, now))


def zone_intervals(zones: list[str]) -> list[tuple[str, int, int, int]]:
    """(zone, utc_from, utc_to, offset) of the known ones among ``zones``, in seconds."""
    return [(name, *stretch) for name in sorted(set(zones)) for stretch in _stretches(name)]


def interval_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    """Zone intervals exploded to the local years they touch, one row per (zone, year)."""
    rows = spark.createDataFrame(zone_intervals(zones) or [("UTC", -(2**40), 2**40, 0)], "zone string, utc_from long, utc_to long, offset long")
    years = lambda s: F.year(F.timestamp_seconds(s))
    local_from, local_to = F.col("utc_from") + F.col("offset"), F.col("utc_to") + F.col("offset")
    # A reading skipped at the very turn of a year still needs the interval before it: hence a day of slack.
    touched = F.sequence(years(F.greatest(local_from - 86_400, F.lit(_LOW_S - 2 * 366 * 86_400))), years(F.least(local_to + 86_400, F.lit(_HIGH_S + 2 * 366 * 86_400))))
    return (
        rows.select("zone", local_from.alias("from"), local_to.alias("to"), "offset", F.explode(touched).alias("year"))
        .groupBy("zone", "year")
        .agg(F.array_sort(F.collect_list(F.struct("from", "to", "offset"))).alias("intervals"))
    )


def known_zones(names: DataFrame, name: str) -> list[str]:
    """Zones of the zone database among the texts of a column; the database bounds their number."""
    return [r[0] for r in names.select(F.col(name).alias("z")).where(F.col("z").isin(sorted(available_timezones()))).distinct().collect()]


def zones_named_in(values: DataFrame, value: str = "value") -> list[str]:
    """Zones that readings without an offset name in brackets."""
    zone = F.regexp_extract(value, r"[0-9]\s*\[([A-Za-z0-9_+/-]{1,40})\]\s*$", 1)
    bare = values.where(F.col(value).rlike(r"[0-9]\[") & ~F.col(value).rlike(r"(?i)(?:Z|[+-][0-9]{1,2}:?[0-9]{2})\["))
    return known_zones(bare.select(zone.alias("zone")), "zone")


def parse_parts(v: Column) -> Column:
    """The ten parts of a written time, split at bars, or null where no notation fits."""
    parts = F
    for pattern, order in _NOTATIONS.values():
        parts = parts.when(v.rlike(pattern), F.split(F.regexp_replace(v, pattern, order), r"\|", -1))
    return parts.otherwise(F.lit(None).cast("array<string>"))


def bare_instant_ms(v: Column) -> Column:
    """Milliseconds of a bare number or a /Date(n)/ text, or null."""
    dotnet = F.when(v.rlike(_DOTNET), F.regexp_extract(v, _DOTNET, 1).try_cast("long"))
    number = F.when(v.rlike(_BARE), v.try_cast("decimal(38,9)"))
    within = lambda n, scale: number.isNotNull() & (n >= _LOW_S * scale) & (n < _HIGH_S * scale)
    ticks = number - F.lit(_TICK_EPOCH_S * 10_000_000).cast("decimal(20,0)")
    return F.coalesce(
        dotnet,
        F.when(within(number, 1), F.floor(number * 1000).cast("long")),
        F.when(within(number, 1000), F.floor(number).cast("long")),
        F.when(within(ticks, 10_000_000), F.floor(ticks / F.lit(10_000).cast("decimal(6,0)")).cast("long")),
    )


def _zone_offset_s(zone: Column) -> Column:
    """Seconds east of Greenwich of a written offset; null if none is written or it is impossible."""
    sign = F.when(zone.contains("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.when(F.length(digits) <= 2, digits).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 2))
    minutes = F.when(F.length(digits) > 2, F.substring(digits, -2, 2)).otherwise("0")
    s = sign * (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60)
    return F.when(zone == "", None).when(digits == "", F.lit(0)).when((hours.try_cast("int") <= 18) & (minutes.try_cast("int") < 60), s)


def to_instants(values: DataFrame, intervals: DataFrame, value: str = "value", zone: str = "zone") -> DataFrame:
    """Rows of ``values`` that name an instant, with ``epoch_ms`` added: the UTC instant each ``value`` names.

    ``zone`` is the IANA zone for readings without one; null or unknown means UTC. A stated offset or zone
    holds. Ambiguous readings are the earlier instant; skipped ones count on with the offset before the
    change. Instants outside 1990 to 2034, impossible dates and values without a time of day give no row, nor do
    null, blank and placeholder values. Digits finer than milliseconds are cut off. A given
    column ``epoch_ms`` is replaced, all others are kept.
    """
    # The given columns travel packed, so that none of their names can clash with those used here.
    given = [c for c in values.columns if c != "epoch_ms"]
    v = F.regexp_replace(F.col(value), r"^[\s\x00]+|[\s\x00]+$", "")
    df = values.select(F.struct(*given).alias("_row"), v.alias("_v"), F.col(zone).alias("_given_zone")).withColumns({"_ms": bare_instant_ms(F.col("_v")), "_p": parse_parts(F.col("_v"))})
    p = lambda i: F.col("_p")[i]
    number = lambda i: p(i).try_cast("int")
    month = F.coalesce(number(1), F.ceil((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(p(1), 1, 3))) + 2) / F.lit(3)).cast("int"))
    half, hour = F.upper(p(7)), number(3)
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), F.when(half == "AM", hour % 12).otherwise(hour % 12 + 12))
    second = F.when(p(5) == "", 0).otherwise(number(5))
    df = df.withColumns({"_y": number(0), "_mo": month, "_d": number(2), "_h": hour24, "_mi": number(4), "_s": second})
    possible = F.col("_y").between(FIRST_YEAR - 1, LAST_YEAR + 1) & F.col("_mo").between(1, 12) & F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    first = F.when(possible, F.make_date("_y", "_mo", F.lit(1)))
    date = F.when(F.col("_d").between(1, F.day(F.last_day(first))), F.unix_date(first) + F.col("_d") - 1)
    stated = F.upper(p(8))
    df = df.withColumns({
        "_local": date.cast("long") * 86_400 + F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s"),
        "_frac": F.rpad(F.substring(p(6), 1, 3), 3, "0").try_cast("int"),
        "_off": _zone_offset_s(stated),
        "_zone": F.when(p(8) != "", None).otherwise(F.coalesce(F.nullif(p(9), F.lit("")), F.col("_given_zone"), F.lit("UTC"))),
    })
    df = df.withColumn("_year", F.year(F.timestamp_seconds("_local")))
    known = small(intervals.select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), "intervals"), 200_000)
    df = df.join(known, ["_zone", "_year"], "left")
    local = F.col("_local")
    at = F.filter("intervals", lambda i: (local >= i["from"]) & (local < i["to"]))
    before = F.filter("intervals", lambda i: i["to"] <= local)
    offset = (
        F.when(F.col("intervals").isNull(), F.lit(0).cast("long"))  # no zone known: UTC
        .when(F.size(at) >= 1, F.array_max(F.transform(at, lambda i: i["offset"])))  # the larger offset is the earlier instant
        .otherwise(F.array_max(F.transform(before, lambda i: F.struct(i["to"].alias("to"), i["offset"].alias("offset"))))["offset"])
    )
    written = F.when(p(8) != "", F.col("_off").cast("long")).otherwise(offset)
    df = df.withColumn("_written", written)
    df = df.withColumn("_found", F.coalesce(F.col("_ms"), (local - F.col("_written")) * 1000 + F.coalesce(F.col("_frac"), F.lit(0))))
    kept = F.when((F.col("_found") >= _LOW_S * 1000) & (F.col("_found") < _HIGH_S * 1000), F.col("_found"))
    # Exploding the one value drops nulls without a filter, which would be pushed down and parse everything twice.
    return df.select("_row.*", F.explode(F.array_compact(F.array(kept))).alias("epoch_ms"))
