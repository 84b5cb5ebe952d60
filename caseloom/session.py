"""What every operator shares: table loading, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one Parquet table of a case folder (a file or a directory of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _checkpoint_ready(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; choose one only where none is set and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = Path(tempfile.mkdtemp(prefix="caseloom-")).as_uri()
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses nothing."""
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most_rows: int, most_mb: int = 64) -> DataFrame:
    """Hint a broadcast of ``df`` only if it has at most ``most_rows`` rows and ``most_mb`` MB of text form.

    Rows and bytes are counted in one aggregate that looks no further than the bound; nothing but the two
    numbers reaches the driver. A larger side comes back unhinted and is joined by shuffle instead.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, mb = df.limit(most_rows + 1).select(size.alias("s")).agg(F.count(F.lit(1)), F.coalesce(F.sum("s"), F.lit(0)) / 1e6).head()
    return F.broadcast(df) if n <= most_rows and mb <= most_mb else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give a plain scan at least ``per_core`` partitions for every core of the cluster.

    Work that costs much more than reading (Python over whole texts) should not depend on how few files or
    row groups a table happens to have. Scans that are split finely enough already are left alone.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
