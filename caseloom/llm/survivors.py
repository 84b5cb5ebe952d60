"""Best representative of each duplicate group, chosen field by field.

One aggregation per group takes, for every attribute, the maximum of a composite struct (filled, source
priority, time, smaller id, value). Maxima combine before the shuffle, so a content with a third of all
files leaves each map task as one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import usable_position
from ..functions.text import hex_digits, is_blank, slashed, tidy

#: Fixed value: MD5 of empty input, which names no content.
EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
#: Trust in where a file came from.
ORIGIN_PRIORITY = {"walk": 3, "deleted": 2, "carve": 1}


@dataclass(frozen=True)
class Field:
    """One attribute of the surviving record: its name, value and condition of being filled."""

    name: str
    value: Column
    filled: Column


def _text_field(name: str) -> Field:
    c = F.col(name)
    return Field(name, c, ~(is_blank(c) | F.coalesce(tidy(c).startswith("0000"), F.lit(False))))


def default_fields() -> list[Field]:
    position = usable_position(F.col("gps_lat"), F.col("gps_lon"))
    return [
        _text_field("path"),
        _text_field("created_dt"),
        _text_field("camera"),
        Field("gps", F.format_string("%s,%s", F.col("gps_lat"), F.col("gps_lon")), position),
    ]


_USED = ("id", "path", "created_dt", "camera", "gps_lat", "gps_lon", "origin", "ingested_at")


def content_members(files: DataFrame) -> DataFrame:
    """Files keyed by content: those of one usable MD5, and those without one whose path such a file lists."""
    md5 = hex_digits(F.col("md5"), 32)
    keyed = files.where(F.col("id").isNotNull()).withColumn("content", F.when(md5 != EMPTY_MD5, md5))
    own = keyed.where(F.col("content").isNotNull())
    lists = own.where(F.ltrim(F.col("alt_paths")).startswith("[")).select("content", F.explode(F.from_json("alt_paths", "array<string>")).alias("listed"))
    listed = lists.where(F.col("listed").isNotNull()).select("content", slashed(F.col("listed")).alias("at")).distinct()
    loose = keyed.where(F.col("content").isNull() & F.col("path").isNotNull()).select(*_USED, slashed(F.col("path")).alias("at"))
    return own.select("content", *_USED).unionByName(loose.join(listed, "at").select("content", *_USED))


def surviving_records(files: DataFrame, fields: list[Field] | None = None) -> DataFrame:
    """One record per content of two or more files: (md5, and per field a struct of from_id and value).

    Files rank by origin, then later ``ingested_at`` (null and NaN last), then smaller id; a field comes from
    the first file in rank whose value is filled, and is null if there is none. Malformed or missing MD5s and
    that of empty input form no content; ``alt_paths`` that are not a JSON list name nothing; repeated rows
    count once; rows with a null id are left out; extra columns are ignored; no rows give no rows.
    """
    fields = fields or default_fields()
    priority = F.coalesce(*[F.when(F.col("origin") == k, F.lit(v)) for k, v in ORIGIN_PRIORITY.items()], F.lit(0))
    late = F.when(F.isnan("ingested_at"), None).otherwise(F.col("ingested_at"))
    rank = [F.lit(True).alias("filled"), priority.alias("priority"), F.coalesce(late, F.lit(float("-inf"))).alias("late"), (-F.col("id")).alias("minus_id")]
    best = [F.max(F.when(f.filled, F.struct(*rank, f.value.alias("value")))).alias(f.name) for f in fields]
    groups = content_members(files).groupBy("content").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"), *best)
    chosen = [F.when(F.col(f.name).isNotNull(), F.struct((-F.col(f"{f.name}.minus_id")).alias("from_id"), F.col(f"{f.name}.value").alias("value"))).alias(f.name) for f in fields]
    return groups.where(F.col("_lo") != F.col("_hi")).select(F.col("content").alias("md5"), *chosen)


def origins_of_fields(records: DataFrame, names: list[str]) -> DataFrame:
    """(md5, field, from_id) of every field that some file of the group could fill."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}.from_id").alias("from_id")) for n in names])
    return records.select("md5", F.explode(cells).alias("c")).select("md5", "c.field", "c.from_id").where(F.col("from_id").isNotNull())
