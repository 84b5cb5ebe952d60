"""Report artifacts: one typed table each, over whole tables; writers only choose the format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import details as D
from ..functions import scalars as S
from . import reports

#: The flags a record may carry, by the bits of its packed form.
RECORD_FLAGS = ("victim_identified", "offender_identified", "is_distributed", "is_suspected", "self_generated")


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").when(~c, "No").otherwise("")


def media_columns() -> list[Column]:
    """What every artifact says of a file: name and path shown, size, kind, times, digests and category."""
    t = lambda c: S.epoch_text(F.col(c)).alias(f"{c}_text")
    return [
        S.display_name(F.col("orig_name"), F.col("rel_path"), F.col("media_id")).alias("name"), "path", "kind", "size", S.size_text(F.col("size")).alias("size_text"), t("mtime"), t("ctime"), t("atime"),
        "md5", "sha1", "width", "height", S.duration_text(F.col("duration")).alias("duration_text"), "camera", reports.category_label(F.col("category")).alias("category_label"), F.coalesce("origin", F.lit("")).alias("origin"),
    ]


def media_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("kind") != "archive").select("id", *media_columns())


def credentials(files: DataFrame, manifests: DataFrame, statements: DataFrame) -> DataFrame:
    """One row per manifest of a file's store and per statement of a source type.

    ``manifests`` has file_id, n, title, generator and ai; ``statements`` file_id, source_type and ai. The last
    manifest of several is the active one.
    """
    named = files.select(F.col("id").alias("file_id"), S.display_name(F.col("orig_name"), F.col("rel_path"), F.col("media_id")).alias("name"))
    total = manifests.groupBy("file_id").agg(F.max("n").alias("of"))
    state = F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.when((F.col("n") == F.col("of")) & (F.col("of") > 1), " (active)").otherwise(""))
    own = manifests.join(total, "file_id").select("file_id", state.alias("manifest"), yes_no(F.col("ai")).alias("ai_declared"), "generator", F.lit("C2PA").alias("metadata_source"))
    said = statements.select("file_id", F.lit("").alias("manifest"), yes_no(F.col("ai")).alias("ai_declared"), F.col("source_type").alias("generator"), F.lit("XMP").alias("metadata_source"))
    return own.unionByName(said).join(named, "file_id")


def offset_text(s: Column) -> Column:
    """Seconds into a video as h:mm:ss."""
    whole = F.floor(s).cast("long")
    return F.when(s.isNotNull(), F.format_string("%d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60))


def key_frames(files: DataFrame, frames: DataFrame) -> DataFrame:
    """Key frames (file_id, ts, phash) of the files of a report with their offsets."""
    own = files.select(F.col("id").alias("file_id"), "path", "md5", S.duration_text(F.col("duration")).alias("duration_text"), reports.category_label(F.col("category")).alias("category_label"))
    return frames.join(own, "file_id").select("file_id", "path", offset_text(F.col("ts")).alias("offset"), F.col("ts").cast("double").alias("offset_s"), F.coalesce("phash", F.lit("")).alias("phash"), "duration_text", "md5", "category_label")


def _flags(packed: Column) -> list[Column]:
    return [yes_no(D.unpack_flag(packed, i)).alias(f) for i, f in enumerate(RECORD_FLAGS)]


def record_rows(records: DataFrame) -> DataFrame:
    """Imported records with the flags they carried; ``records`` has media_id, orig_name, orig_path, category, md5, sha1, mime, size and packed flags."""
    return records.where(F.col("media_id").isNotNull()).select(
        "media_id", F.coalesce("orig_name", F.lit("")).alias("name"), F.coalesce("orig_path", F.lit("")).alias("device_path"), reports.category_label(F.col("category")).alias("category_label"),
        *_flags(F.col("flags")), *[F.coalesce(c, F.lit("")).alias(c) for c in ("md5", "sha1", "mime")], "size",
    )


def set_matches(files: DataFrame, hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits by a record of a set: the set, what the record asserts, and the file it names.

    A hit is (id, set_name, value, category); a record (md5, media_id, flags). Of several records of a digest the
    smallest media_id speaks.
    """
    first = records.where(F.col("md5").isNotNull() & F.col("media_id").isNotNull()).groupBy(F.lower(F.trim("md5")).alias("value")).agg(F.min(F.struct("media_id", "flags")).alias("r"))
    own = files.select("id", "path", reports.category_label(F.col("category")).alias("case_category"))
    rows = hits.join(first, "value").join(own, "id")
    return rows.select("id", "set_name", F.col("r.media_id").alias("vic_media_id"), F.col("category").alias("asserted"), *_flags(F.col("r.flags")), "path", "value", "case_category")


def stack_rows(files: DataFrame) -> DataFrame:
    """Stacks of two or more: copies, first name, distinct sources and bytes; lists are read from ``reports.duplicate_members``."""
    g = files.where(F.col("stack_id").isNotNull()).groupBy("stack_id")
    first = F.min(F.struct("id", S.base_name(F.col("path")).alias("name"), "path")).alias("f")
    rows = g.agg(F.count(F.lit(1)).alias("copies"), first, F.countDistinct("source").alias("sources"), F.max("size").alias("bytes_each"), F.sum("size").alias("bytes_total")).where(F.col("copies") > 1)
    return rows.select("stack_id", "copies", F.col("f.name").alias("name"), F.col("f.path").alias("path"), "sources", "bytes_each", "bytes_total")


def category_counts(categories: DataFrame, files: DataFrame) -> DataFrame:
    """Every category with the number of its files, none included."""
    n = files.where(F.col("category").isNotNull()).groupBy(F.col("category").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return categories.select("code", "name").join(F.broadcast(n), "code", "left").select("code", "name", F.coalesce("n", F.lit(0)).alias("n"))


def decorated(page: DataFrame, flags: DataFrame, frames: DataFrame) -> DataFrame:
    """A page of rows with label, flags and whether key frames are held; the page is bounded, so lookups are by its ids."""
    ids = F.broadcast(page.select(F.col("id").alias("file_id")).distinct())
    own = flags.join(ids, "file_id", "left_semi").groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    framed = frames.join(ids, "file_id", "left_semi").select(F.col("file_id").alias("id"), F.lit(True).alias("_framed")).distinct()
    rows = page.join(own, "id", "left").join(framed, "id", "left")
    return rows.withColumns({"category_label": reports.category_label(F.col("category")), "flags": F.array_join(F.coalesce("flags", F.array().cast("array<string>")), ","), "has_keyframes": F.coalesce("_framed", F.lit(False))}).drop("_framed")


def audit_view(events: DataFrame, view: str) -> DataFrame:
    """The audit history as runs, edits or failures; another view is everything."""
    runs = F.col("action").isin("ingest", "process", "report", "export")
    failed = F.coalesce(F.col("detail").ilike("%failed%"), F.lit(False))
    return {"runs": events.where(runs), "edits": events.where(~runs), "failed": events.where(failed)}.get(view, events)


def covered_points(points: DataFrame, tiles: DataFrame, zoom: int) -> DataFrame:
    """Points (id, lat, lon) for which a map has the tile of a zoom (x, y)."""
    px, py = S.mercator_pixel(F.col("lat"), F.col("lon"), zoom)
    at = points.withColumns({"x": F.floor(px / 256).cast("int"), "y": F.floor(py / 256).cast("int")})
    return at.join(tiles.select("x", "y").distinct(), ["x", "y"], "left_semi").select("id", "x", "y")


def stage_outcomes(runs: DataFrame) -> DataFrame:
    """Per stage of ``runs`` (stage, file_id, error, seconds): files done, failed, and time."""
    return runs.groupBy("stage").agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.round(F.sum("seconds"), 3).alias("seconds"))


def case_overview(files: DataFrame) -> DataFrame:
    """One row per source for the list of cases: files, bytes, share categorized and the last change."""
    done = F.count_if(F.col("category").isNotNull() & (F.col("category") != schema.UNCATEGORIZED))
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), done.alias("categorized"), F.max("ingested_at").alias("latest"))


#: Formats of a report and how each is written.
WRITERS: dict[str, Callable[[DataFrame, str], object]] = {
    "csv": reports.write_csv,
    "json": lambda rows, folder: reports.as_json_lines(rows).write.mode("overwrite").text(folder),
    "parquet": lambda rows, folder: rows.write.mode("overwrite").parquet(folder),
    "md5": lambda rows, folder: reports.md5_list(rows).orderBy("md5").write.mode("overwrite").text(folder),
    "stash": lambda rows, folder: rows.select("md5", "category", "source", "region").write.mode("overwrite").option("header", True).csv(folder),
    "kmz": lambda rows, folder: reports.write_kmz(reports.location_points(rows), folder),
    "project": lambda rows, folder: reports.write_project({"Media Files": media_files(rows)}, folder),
}


def write_report(rows: DataFrame, format: str, target: str) -> None:
    """Write the rows of a report in one of WRITERS; an unknown format is an error before anything is written."""
    if format not in WRITERS:
        raise ValueError(f"no such report format: {format}")
    WRITERS[format](rows, target)
