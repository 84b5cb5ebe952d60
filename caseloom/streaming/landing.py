"""Incremental ingest as a stream. An extension: the case engine itself only ever works in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import scalars as S


def watch_folder(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_files(rows: DataFrame, event_time: str, lateness: str = "1 day") -> DataFrame:
    """Each path once within the lateness allowed, with its kind; state is bounded by the watermark."""
    once = rows.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["path"])
    return once.withColumn("kind", S.kind_by_extension(S.suffix(F.col("path"))))


def windowed_activity(events: DataFrame, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Audit entries by action and time window."""
    g = events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def append_to(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived so far and stop; run again to go on where it stopped."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
