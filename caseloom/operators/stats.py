"""Counts and censuses of a case, each one pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S


def case_stats(files: DataFrame) -> DataFrame:
    """One row of totals. Archives and rows without a kind are left out of ``total`` only."""
    return files.agg(
        F.count_if(F.col("kind") != "archive").alias("total"),
        F.count_if(F.col("kind") == "image").alias("images"),
        F.count_if(F.col("kind") == "video").alias("videos"),
        F.count_if(F.col("kind") == "other").alias("others"),
        F.count_if(F.col("category").isNotNull() & (F.col("category") != schema.UNCATEGORIZED)).alias("categorized"),
        F.count_if(S.group_key() != F.col("id")).alias("collapsed"),
        F.countDistinct("stack_id").alias("stacks"),
        F.countDistinct("vstack_id").alias("vstacks"),
        F.countDistinct("cluster_id").alias("clusters"),
        F.count_if(F.col("stack_id").isNotNull() & (F.col("stack_id") != F.col("id"))).alias("redundant"),
    )


def by_category(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("category", F.lit(schema.UNCATEGORIZED)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def by_category_share(files: DataFrame) -> DataFrame:
    """Category counts with their percentage of all files."""
    g = by_category(files)
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))


def origin_counts(files: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("origin") == k).alias(k)
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[n(k) for k in schema.ORIGINS], F.count_if(F.col("origin").isNull()).alias("unknown"))


def largest_clusters(files: DataFrame, most: int = 200) -> DataFrame:
    """The report of the largest clusters; ties go to the smaller cluster id."""
    return files.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").limit(most)


def screening_totals(files: DataFrame) -> DataFrame:
    """Totals of the context panel in one conditional pass."""
    return files.agg(
        F.count_if(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()).alias("with_gps"),
        F.count_if((F.col("kind") == "image") & F.col("phash").isNull()).alias("unhashed_images"),
        F.count_if((F.col("kind") == "video") & F.col("duration").isNull()).alias("unread_videos"),
        F.count_if(F.col("kind") == "archive").alias("archives"),
        F.count_if(F.col("size") == 0).alias("empty_files"),
        F.countDistinct("source").alias("sources"),
    )


def credentials_census(files: DataFrame, credentials: DataFrame) -> DataFrame:
    """Files by credentials status and AI reading; a file nobody read is ``unread``, not ``none``."""
    rows = files.where(F.col("kind").isin("image", "video")).select("id").join(credentials, "id", "left")
    return rows.groupBy(F.coalesce("status", F.lit("unread")).alias("status"), F.coalesce("ai", F.lit("")).alias("ai")).agg(F.count(F.lit(1)).alias("n"))


def ai_verdict(statements: DataFrame) -> DataFrame:
    """Per file: yes if any statement says so, else no if any denies it, else unknown if any speaks of it."""
    return statements.groupBy("id").agg(
        F.when(F.coalesce(F.bool_or("generated"), F.lit(False)), "yes").when(F.coalesce(F.bool_or(~F.col("generated")), F.lit(False)), "no").when(F.bool_or("stated"), "unknown").alias("ai")
    )


def stash_summary(stash: DataFrame) -> DataFrame:
    """Counts by region and category with subtotals of each region and the grand total."""
    return stash.rollup("region", "category").agg(F.count(F.lit(1)).alias("n"), F.max("added_at").alias("latest"))
