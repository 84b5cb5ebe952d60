"""Report rows and artifact tables of a case, as DataFrames; writers only put them into files."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S

#: Labels of categories in the default scheme.
CATEGORY_LABELS = {
    0: "Non-pertinent",
    1: "CAM (Child Abuse Material)",
    2: "Child Exploitative / Age Difficult",
    3: "CGI / Animation (Child Exploitative)",
    4: "Comparison Images (Non-pertinent)",
    5: "Uncategorized",
}


def category_label(code: Column) -> Column:
    """Label of a category code; null is uncategorized, an unknown code names itself."""
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(code, F.lit(schema.UNCATEGORIZED))), F.concat(F.lit("Category "), code.cast("string")))


def report_rows(files: DataFrame, where: str = "true", zone: str = "UTC") -> DataFrame:
    """Rows of a report: media only, unless the condition itself speaks of kinds."""
    media = F.lit(True) if "kind" in where else F.col("kind").isin("image", "video")
    return files.where(media & F.expr(where)).select(
        "id", "kind", "source", "rel_path", S.size_text(F.col("size")).alias("size_text"), S.duration_text(F.col("duration")).alias("duration_text"),
        S.epoch_text(F.col("mtime"), zone).alias("modified"), category_label(F.col("category")).alias("category_label"), "md5",
        F.coalesce("origin", F.lit("")).alias("origin"),
    )


def md5_list(files: DataFrame) -> DataFrame:
    """Distinct non-empty MD5s of files that are no archives."""
    return files.where((F.col("kind") != "archive") & F.col("md5").isNotNull() & (F.col("md5") != "")).select("md5").distinct()


def location_points(files: DataFrame) -> DataFrame:
    """Geolocated files as map points."""
    c = S.valid_coordinates(F.col("gps_lat"), F.col("gps_lon"))
    return files.select("id", "rel_path", c.alias("c")).where(F.col("c").isNotNull()).select("id", "rel_path", "c.lat", "c.lon")


def location_tally(files: DataFrame) -> DataFrame:
    """How many media files can be put on a map, and why the others can not."""
    c = S.valid_coordinates(F.col("gps_lat"), F.col("gps_lon"))
    reason = F.when(F.col("gps_lat").isNull() | F.col("gps_lon").isNull(), "no position").when(c.isNull(), "unusable position").otherwise("mapped")
    return files.where(F.col("kind").isin("image", "video")).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_stacks(files: DataFrame) -> DataFrame:
    """One row per exact stack of two or more: copies, sources, bytes each and in all.

    Names are not gathered into one row, as a stack has no bound; ``duplicate_members`` lists them.
    """
    g = files.where(F.col("stack_id").isNotNull()).groupBy("stack_id").agg(
        F.count(F.lit(1)).alias("copies"), F.max("size").alias("bytes_each"), F.sum("size").alias("bytes_total"), F.array_sort(F.collect_set("source")).alias("sources")
    )
    return g.where(F.col("copies") > 1).select("stack_id", "copies", "bytes_each", "bytes_total", F.array_join("sources", ", ").alias("sources"))


def duplicate_members(files: DataFrame) -> DataFrame:
    several = files.where(F.col("stack_id").isNotNull()).groupBy("stack_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("stack_id")
    return files.join(several, "stack_id", "left_semi").select("stack_id", "id", "path")


def visual_groups(files: DataFrame) -> DataFrame:
    """One row per visual stack of two or more files, with the number of different contents."""
    g = files.where(F.col("vstack_id").isNotNull()).groupBy("vstack_id").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("md5").alias("contents"))
    return g.where(F.col("files") > 1)


def cluster_rows(files: DataFrame) -> DataFrame:
    g = files.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("vstack_id").alias("visual_groups"))
    return g.where(F.col("files") > 1)


def category_summary(files: DataFrame) -> DataFrame:
    """Sections of the report: label, kind and count; uncategorized is the last position."""
    code = F.coalesce("category", F.lit(schema.UNCATEGORIZED))
    g = files.where(F.col("kind").isin("image", "video")).groupBy(code.alias("code"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return g.select("code", category_label(F.col("code")).alias("label"), "kind", "n", F.when(F.col("code") == schema.UNCATEGORIZED, 1).otherwise(0).alias("last"))


def audit_log(events: DataFrame, most: int = 500) -> DataFrame:
    """The newest entries first, ties by id."""
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def as_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns if c not in ("path", "rel_path")])).alias("line"))


def round_trip(media: DataFrame, files: DataFrame) -> DataFrame:
    """Categories written back to imported records: by MediaID first, else by MD5; uncategorized is null.

    ``media`` has media_id and md5. The file of the smallest id decides where several share a key.
    """
    pick = lambda key: files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("id", "category")).getField("category").alias(f"by_{key}"))
    known = files.where(F.col("media_id").isNotNull()).select("media_id").distinct().withColumn("_known", F.lit(True))
    rows = media.join(pick("media_id"), "media_id", "left").join(known, "media_id", "left").join(pick("md5"), "md5", "left")
    code = F.when(F.col("_known"), F.col("by_media_id")).otherwise(F.col("by_md5"))
    return rows.select("media_id", "md5", F.when(code != schema.UNCATEGORIZED, code).alias("category"))


# --- writers ------------------------------------------------------------------------------------------

def write_csv(rows: DataFrame, folder: str) -> None:
    """CSV parts with headers; sorted writing and one file are left to the caller, as both cost a shuffle."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def write_project(tables: dict[str, DataFrame], folder: str, keep_empty: Iterable[str] = ()) -> list[str]:
    """One Parquet table per artifact and a manifest; empty artifacts are dropped unless asked for."""
    written = []
    for name, df in tables.items():
        if name in set(keep_empty) or df.head(1):
            clean = "".join(c if c.isalnum() else "_" for c in name.lower()).strip("_")
            df.write.mode("overwrite").parquet(f"{folder}/{clean}")
            written.append({"name": name, "table": clean, "columns": [{"name": n, "type": t} for n, t in df.dtypes]})
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(written),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return [w["name"] for w in written]


def write_kmz(points: DataFrame, path: str) -> int:
    """A KMZ of map points, streamed to the driver a partition at a time."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("doc.kml", "w") as out:
        out.write(b'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>')
        for r in points.select("rel_path", "lat", "lon").toLocalIterator():
            out.write(f"<Placemark><name>{escape(r['rel_path'] or '')}</name><Point><coordinates>{r['lon']},{r['lat']},0</coordinates></Point></Placemark>".encode())
            n += 1
        out.write(b"</Document></kml>")
    Path(path).touch()
    return n
