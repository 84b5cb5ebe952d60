"""Edits of a case as pure transformations: each gives the new state of a table, and most an audit row.

Nothing is changed in place. A caller writes the result beside the old version and swaps them; audit rows are
appended. Joins are on keys, edits are reduced to one per key first, so a key edited very often is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S

AUDIT = ("ts", "action", "file_id", "detail")


def upsert_files(files: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Files after an ingest: a row of a known path takes what the incoming row fills, a new path gets a new id.

    ``incoming`` has path and any columns of ``files``; of several rows of one path the last by ``seq`` counts.
    New files are uncategorized unless they say otherwise; ``ingested_at`` is kept where it was set before. New ids are
    larger than all others and unique; which path gets which is settled when the result is written.
    """
    known = [c for c in files.columns if c not in ("id", "path", "ingested_at")]
    given = [c for c in known if c in incoming.columns]
    last = incoming.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(F.struct(*given), "seq").alias("_new"))
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    both = files.join(last, "path", "full_outer").join(F.broadcast(top))
    # Ids of new paths follow the largest one without a window over the whole table.
    value = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in given else F.col(c)
    fresh = F.col("_top") + 1 + F.monotonically_increasing_id()
    category = F.coalesce(value("category"), F.lit(schema.UNCATEGORIZED)) if "category" in known else None
    columns = [F.coalesce("id", fresh).alias("id"), "path", *[(category if c == "category" else value(c)).alias(c) for c in known]]
    return both.select(*columns, F.coalesce(F.col("ingested_at"), now).alias("ingested_at"))


def _last_edits(edits: DataFrame, fields: list[str]) -> DataFrame:
    """One row per file of ``edits`` (file_id, seq, and fields): of each field the last filled value."""
    return edits.groupBy("file_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields])


def apply_edits(files: DataFrame, edits: DataFrame, fields: tuple[str, ...] = ("category", "triage", "notes")) -> DataFrame:
    """Files after the edits (file_id, seq and any of ``fields``) in the order of seq; nulls leave a field alone."""
    used = [f for f in fields if f in edits.columns]
    last = _last_edits(edits, used).withColumnRenamed("file_id", "id")
    kept = [F.coalesce(f"_{f}", f).alias(f) if f in used else F.col(f) for f in files.columns]
    return files.join(last, "id", "left").select(*kept)


def audit_of(edits: DataFrame, fields: tuple[str, ...] = ("category", "triage", "notes")) -> DataFrame:
    """The audit rows (ts, action, file_id, detail) of edits that carry ``ts``: one for each field set."""
    cells = F.array(*[F.struct(F.lit(f).alias("action"), F.col(f).cast("string").alias("detail")) for f in fields if f in edits.columns])
    return edits.select("ts", "file_id", F.explode(cells).alias("c")).where(F.col("c.detail").isNotNull()).select("ts", "c.action", "file_id", "c.detail")


def change_flags(flags: DataFrame, changes: DataFrame) -> DataFrame:
    """Flags (file_id, flag) after ``changes`` (file_id, flag, seq, add): the last change of each flag of a file holds."""
    last = changes.groupBy("file_id", "flag").agg(F.max_by("add", "seq").alias("_add"))
    both = flags.distinct().withColumn("_has", F.lit(True)).join(last, ["file_id", "flag"], "full_outer")
    return both.where(F.coalesce("_add", "_has")).select("file_id", "flag")


def delete_category(files: DataFrame, categories: DataFrame, code: int, to: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, categories) after a category is deleted: its files go to ``to``, or it stays, hidden, while in use.

    ``categories`` has code, name, locked and hidden. A locked one is not deleted.
    """
    locked = categories.where((F.col("code") == code) & F.col("locked")).select(F.lit(True).alias("_locked"))
    if to is not None:
        moved = files.join(F.broadcast(locked), how="left") if locked.head(1) else files.withColumn("_locked", F.lit(None).cast("boolean"))
        files = moved.withColumn("category", F.when((F.col("category") == code) & F.col("_locked").isNull(), to).otherwise(F.col("category"))).drop("_locked")
    used = files.where(F.col("category") == code).select(F.lit(code).alias("code")).limit(1).withColumn("_used", F.lit(True))
    rows = categories.join(F.broadcast(used), "code", "left")
    gone = (F.col("code") == code) & ~F.col("locked") & F.col("_used").isNull()
    hide = (F.col("code") == code) & ~F.col("locked")
    return files, rows.where(~gone).withColumn("hidden", F.when(hide, True).otherwise(F.col("hidden"))).drop("_used")


def seed_categories(scheme: DataFrame, files: DataFrame) -> DataFrame:
    """(code, name, position): the scheme's categories, and a placeholder for every other code files use."""
    top = scheme.agg(F.max("position").alias("_top"))
    used = files.where(F.col("category").isNotNull()).select(F.col("category").alias("code")).distinct().join(F.broadcast(scheme.select("code")), "code", "left_anti")
    placed = used.join(F.broadcast(top)).select("code", F.concat(F.lit("Category "), F.col("code").cast("string")).alias("name"), (F.col("_top") + 1 + F.col("code")).alias("position"))
    return scheme.select("code", "name", "position").unionByName(placed)


def swap_codes(files: DataFrame, a: int = 0, b: int = schema.UNCATEGORIZED) -> DataFrame:
    """Categories of a case of the older numbering, in which two codes had each other's meaning."""
    c = F.col("category")
    return files.withColumn("category", F.when(c == a, b).when(c == b, a).otherwise(c))


def tags_to_flags(tags: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags (file_id, flag) with older tags (file_id, tag) among them, blank ones left out, each once."""
    old = tags.select("file_id", F.trim("tag").alias("flag")).where(F.col("flag") != "")
    return flags.select("file_id", "flag").unionByName(old).distinct()


def add_to_set(entries: DataFrame, incoming: DataFrame, set_name: str) -> DataFrame:
    """A hash set after an import: usable digests only, those of empty input dropped, the first entry of each kept.

    ``entries`` has set_name, algo, value and category; ``incoming`` value, category and seq.
    """
    value = S.normal_hash(F.col("value"))
    rows = incoming.select(value.alias("value"), "category", "seq").where(F.col("value").isNotNull() & ~F.col("value").isin(*schema.EMPTY_HASHES))
    first = rows.groupBy("value").agg(F.min_by("category", "seq").alias("category"))
    new = first.select(F.lit(set_name).alias("set_name"), S.algorithm_of(F.col("value")).alias("algo"), "value", "category")
    held = entries.where(F.col("set_name") == set_name).select("algo", "value")
    return entries.select("set_name", "algo", "value", "category").unionByName(new.join(held, ["algo", "value"], "left_anti"))


def delete_set(hits: DataFrame, set_name: str) -> DataFrame:
    """Hits after a set is deleted: its own are cleared; categories adopted from it stay with the files."""
    return hits.where(F.col("set_name") != set_name)


def build_global_set(sets: DataFrame, name: str, entries: DataFrame) -> DataFrame:
    """The set catalogue (name, status, entries) after an import: an older set of the name is replaced, the count read back.

    An import without entries leaves the set marked ``failed``.
    """
    new = entries.agg(F.countDistinct("algo", "value").alias("entries")).select(F.lit(name).alias("name"), F.when(F.col("entries") > 0, "ready").otherwise("failed").alias("status"), "entries")
    return sets.where(F.col("name") != name).select("name", "status", "entries").unionByName(new)


def stale_readings(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Ids of files whose cached metadata (file_id, version) is missing or of another version."""
    return files.select("id").join(cache.where(F.col("version") == version).select(F.col("file_id").alias("id")), "id", "left_anti")


def restore(snapshots: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """A table as the snapshot ``name`` (name, ts) saw it, from rows that carry valid_from and valid_to."""
    at = snapshots.where(F.col("name") == name).agg(F.max("ts").alias("_at"))
    return table.join(F.broadcast(at)).where((F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_at")))).drop("_at", "valid_from", "valid_to")


def rebase_paths(files: DataFrame, old: str, new: str) -> DataFrame:
    """Paths of files under one folder moved under another; other files keep theirs."""
    root = old.rstrip("/") + "/"
    moved = F.concat(F.lit(new.rstrip("/") + "/"), F.substring("path", len(root) + 1, 1_000_000))
    return files.withColumn("path", F.when(F.col("path").startswith(root), moved).otherwise(F.col("path")))


def reorder_categories(categories: DataFrame, order: DataFrame) -> DataFrame:
    """Categories (code, name, locked, position) in a new ``order`` (code, position): locked ones stay in front as they were."""
    rows = categories.join(F.broadcast(order.select("code", F.col("position").alias("_to"))), "code", "left")
    w = Window.orderBy(F.desc("locked"), F.when(F.col("locked"), F.col("position")).otherwise(F.coalesce("_to", F.lit(1 << 30))), "position", "code")  # a handful of rows
    return rows.withColumn("position", F.row_number().over(w) - 1).drop("_to")
