"""Containers and their members, storage views, byte extents and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.text import slashed
from ..session import cut

#: Storage views of one folder, the best first: (storage class, pattern, group of the user's number).
STORAGE_VIEWS = (
    ("ce", r"(^|/)data/data/", 0),
    ("de", r"(^|/)data/user_de/([0-9]+)/", 2),
    ("ce", r"(^|/)data/user/([0-9]+)/", 2),
    ("ce", r"(^|/)data_mirror/data_ce/[^/]+/([0-9]+)/", 2),
    ("de", r"(^|/)data_mirror/data_de/[^/]+/([0-9]+)/", 2),
    ("media", r"(^|/)data/media/([0-9]+)/", 2),
    ("media", r"(^|/)storage/emulated/([0-9]+)/", 2),
    ("media", r"(^|/)mnt/user/([0-9]+)/emulated/[0-9]+/", 2),
    ("media", r"(^|/)sdcard/", 0),
)


def canonical_views(names: DataFrame, name: str = "name") -> DataFrame:
    """Add ``view_key`` and ``view_rank``: one key for all spellings of a file, null outside every view."""
    c = slashed(F.col(name))
    split = lambda v: F.array(F.concat(*(F.regexp_extract(c, f"^(.*?){v[1]}(.*)$", k) for k in (1, 2))), F.lit(v[0]), (F.regexp_extract(c, v[1], v[2]) if v[2] else F.lit("0")), F.regexp_extract(c, f"^(.*?){v[1]}(.*)$", 3 if v[2] == 0 else 4))
    parts = reduce(lambda e, v: e.when(c.rlike(v[1]), F.concat_ws("\x00", split(v))), STORAGE_VIEWS, F)
    rank = reduce(lambda e, iv: e.when(c.rlike(iv[1][1]), F.lit(iv[0])), enumerate(STORAGE_VIEWS), F)
    return names.withColumns({"view_key": parts, "view_rank": rank})


def collapse_views(members: DataFrame) -> DataFrame:
    """One row per (source, file): the best view kept, the other paths beside it.

    ``members`` has source, name, size and crc. Views of one name are one file only if there are two or more
    names of one size with at most one known checksum; otherwise all of them are kept.
    """
    rows = canonical_views(members.select("source", "name", "size", "crc").distinct())
    seen = rows.where(F.col("view_key").isNotNull())
    key = ["source", "view_key"]
    # A file has a handful of views, which bounds the list.
    groups = seen.groupBy(*key).agg(F.countDistinct("name").alias("n"), F.countDistinct(F.coalesce("size", F.lit(-1))).alias("sizes"), F.countDistinct("crc").alias("crcs"), F.array_sort(F.collect_set(F.struct("view_rank", "name"))).alias("views"))
    one = (F.col("n") >= 2) & (F.col("sizes") == 1) & (F.col("crcs") <= 1)
    merged = groups.where(one).select("source", F.col("views")[0]["name"].alias("name"), F.transform(F.slice("views", 2, F.size("views")), lambda v: v["name"]).alias("alt_paths"))
    apart = groups.where(~one).select("source", F.explode("views").alias("v")).select("source", F.col("v.name").alias("name"), F.array().cast("array<string>").alias("alt_paths"))
    plain = rows.where(F.col("view_key").isNull()).select("source", "name", F.array().cast("array<string>").alias("alt_paths"))
    return merged.unionByName(apart).unionByName(plain)


def descendants(files: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(root, id, depth): every file under every top container, however deep; ``most_depth`` stops earlier.

    Each level is one join with the parent links and is cut before the next, so plans stay one join long. A
    container is under a top container once only: files that (wrongly) contain each other hang under no top.
    """
    child = files.where(F.col("container_id").isNotNull()).select("id", F.col("container_id").alias("parent")).distinct()
    boxes = files.select(F.col("id").alias("parent")).where(F.col("parent").isNotNull()).distinct()
    tops = boxes.join(child.select(F.col("id").alias("parent")), "parent", "left_anti").join(child.select("parent").distinct(), "parent", "left_semi")
    level = tops.select(F.col("parent").alias("root"), F.col("parent").alias("id"))
    out = []
    while most_depth is None or len(out) < most_depth:
        level = cut(level.withColumnRenamed("id", "parent").join(child, "parent").select("root", "id"))
        if not level.head(1):
            break
        out.append(level.select("root", "id", F.lit(len(out) + 1).alias("depth")))
    return reduce(DataFrame.unionByName, out or [level.select("root", "id", F.lit(0).alias("depth"))]).distinct()


def member_counts(files: DataFrame) -> DataFrame:
    """Per container how many members of each kind it gave."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return files.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.count(F.lit(1)).alias("n"), n("image"), n("video"), n("other"), n("archive"))


def container_census(files: DataFrame) -> DataFrame:
    """One row: archives, those opened, their members and the most members of one."""
    kids = files.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.count(F.lit(1)).alias("kids")).withColumnRenamed("container_id", "id")
    boxes = files.where(F.col("kind") == "archive").join(kids, "id", "left")
    return boxes.agg(F.count(F.lit(1)).alias("archives"), F.count_if(F.col("kids") > 0).alias("opened"), F.coalesce(F.sum("kids"), F.lit(0)).alias("items"), F.coalesce(F.max("kids"), F.lit(0)).alias("most"))


def unsettled_containers(files: DataFrame, need: int = 3) -> DataFrame:
    """Containers that still have to be opened: no members yet and not all wanted passes noted in ``expanded``."""
    boxes = files.where((F.col("kind") == "archive") & (F.coalesce("expanded", F.lit(0)).bitwiseAND(F.lit(need)) != need))
    kids = files.where(F.col("container_id").isNotNull()).select(F.col("container_id").alias("id"))
    return boxes.join(kids, "id", "left_anti").select("id")


def merged_extents(extents: DataFrame) -> DataFrame:
    """(volume, start, end): overlapping and touching runs of (volume, start, len) as one."""
    w = Window.partitionBy("volume").orderBy("start", "end")
    rows = extents.where(F.col("len") > 0).select("volume", "start", (F.col("start") + F.col("len")).alias("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_g", island).groupBy("volume", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def free_extents(extents: DataFrame, least: int = 1) -> DataFrame:
    """(volume, start, end): the gaps between the used runs of each volume, from 0 on."""
    w = Window.partitionBy("volume").orderBy("start")
    used = merged_extents(extents).withColumn("_from", F.coalesce(F.lag("end").over(w), F.lit(0)))
    return used.where(F.col("start") - F.col("_from") >= least).select("volume", F.col("_from").alias("start"), F.col("start").alias("end"))


def contiguous_run(pieces: DataFrame) -> DataFrame:
    """(item, pieces, bytes): how far the pieces (item, position, size) of each item go on without a gap."""
    w = Window.partitionBy("item").orderBy("position")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.groupBy("item", "position").agg(F.max("size").alias("size")).withColumn("_ok", before == F.col("position"))
    good = rows.withColumn("_bad", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return good.where(F.col("_bad") == 0).groupBy("item").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("bytes"))


def prune_snapshots(snapshots: DataFrame, keep: int = 20) -> DataFrame:
    """Automatic snapshots beyond the newest ``keep`` of each case; manual ones are never named."""
    w = Window.partitionBy("case").orderBy(F.desc("taken_at"), F.desc("name"))
    return snapshots.where(F.col("automatic")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > keep).select("case", "name")


def evict_over_budget(entries: DataFrame, budget: int) -> DataFrame:
    """Oldest cache entries to drop until each cache fits its budget."""
    w = Window.partitionBy("cache").orderBy(F.desc("used_at"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_sum", F.sum("size").over(w)).where(F.col("_sum") > budget).select("cache", "name")


def middle_frames(frames: DataFrame) -> DataFrame:
    """(file_id, ts) of the middle key frame of each video."""
    w = Window.partitionBy("file_id")
    rows = frames.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy("ts")) - 1)
    return rows.where(F.col("_i") == F.floor(F.col("_n") / 2)).select("file_id", "ts")


def thumbnail_names(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Names of cached thumbnails: the hexadecimal id in ``entry_<n>_<id>.`` looked up in a search index.

    Later rows of the index win; without a name the last part of the path stands in.
    """
    key = F.conv(F.regexp_extract("name", r"entry_[0-9]+_([0-9a-fA-F]{16})\.", 1), 16, -10).cast("long")
    last = index.groupBy("thumb_id").agg(F.max(F.struct("seq", "item_name", "item_path")).alias("x"))
    named = entries.withColumn("thumb_id", key).where(F.col("thumb_id").isNotNull()).join(last, "thumb_id")
    return named.select("id", F.coalesce(F.nullif(F.col("x.item_name"), F.lit("")), S.base_name(F.col("x.item_path"))).alias("found_name"), F.col("x.item_path").alias("found_path"))


def relink_problems(recorded: DataFrame, listing: DataFrame) -> DataFrame:
    """(rel_path, problem) of files missing from a new folder or differing in size; no row means it fits."""
    new = listing.select("rel_path", F.col("size").alias("_size"), F.lit(True).alias("_here"))
    rows = recorded.select("rel_path", "size").distinct().join(new, "rel_path", "left")
    problem = F.when(F.col("_here").isNull(), "missing").when(F.col("_size") != F.col("size"), "size")
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("rel_path", "problem")


def wrapper_folder(names: DataFrame, devices: tuple[str, ...] = ("data", "private", "Users", "storage")) -> DataFrame:
    """(archive, wrapper): the one folder all names of an archive lie in, unless it is a device's own root."""
    first = F.split(slashed(F.col("name")), "/")[0]
    nested = F.contains(slashed(F.col("name")), F.lit("/"))
    g = names.groupBy("archive").agg(F.countDistinct(first).alias("n"), F.min(first).alias("wrapper"), F.bool_and(nested).alias("all"))
    return g.where((F.col("n") == 1) & F.col("all") & ~F.col("wrapper").isin(*devices)).select("archive", "wrapper")
