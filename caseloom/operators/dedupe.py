"""Exact stacks, visual stacks and near clusters of a case."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..functions.text import hex_digits, hex_to_long
from ..session import cut
from .components import connected_components, union_find


def exact_stacks(files: DataFrame) -> DataFrame:
    """(id, stack_id): the smallest id with the same content hash; null without a hash.

    A file known by MD5 only never joins one with a SHA-256. The minimum combines before the shuffle and the
    head is joined back, so a content with very many copies is no single task.
    """
    keyed = files.select("id", S.stack_key().alias("key"))
    heads = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("stack_id"))
    return keyed.join(heads, "key", "left").select("id", "stack_id")


def hash_bands(rows: DataFrame) -> DataFrame:
    """One row per byte of the hash ``h``: (id, h, d, band, key)."""
    keys = F.array(*[F.shiftrightunsigned("h", 56 - 8 * i).bitwiseAND(F.lit(255)) for i in range(8)])
    return rows.select("id", "h", "d", F.posexplode(keys).alias("band", "key"))


#: Buckets of more files are compared in blocks instead of by a join; either way is exact.
HOT_BUCKET = 512
_BLOCK = 2048
_STRIP = 64


def _block_pairs(pdf: pd.DataFrame, bits: int, forest: bool) -> pd.DataFrame:
    """Pairs (a < b) within one pair of blocks of a hot bucket, or only a spanning forest of them."""
    side, ids, h, d, known = (pdf[c].to_numpy() for c in ("side", "id", "h", "d", "known"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    a: list[np.ndarray] = [np.empty(0, "int64")]
    b: list[np.ndarray] = [np.empty(0, "int64")]
    for s in range(0, len(left), _STRIP):
        x, y = left[s : s + _STRIP], right[s:] if alone else right
        i, j = np.nonzero(np.bitwise_count((h[x, None] ^ h[None, y]).view("uint64")) <= bits)
        i, j = x[i], y[j]
        near = (ids[i] != ids[j]) & (~(known[i] & known[j]) | (np.bitwise_count((d[i] ^ d[j]).view("uint64")) <= bits + 2))
        if alone:
            near &= i < j
        a.append(np.minimum(ids[i[near]], ids[j[near]]))
        b.append(np.maximum(ids[i[near]], ids[j[near]]))
    a, b = np.concatenate(a), np.concatenate(b)
    if forest:
        node, root = union_find(a, b)
        a, b = root[node != root], node[node != root]
    return pd.DataFrame({"a": a, "b": b})


def perceptual_pairs(rows: DataFrame, bits: int, cap: int | None = None, forest: bool = False) -> DataFrame:
    """Pairs (a < b) that share a byte of the hash and differ in at most ``bits``.

    Where both second hashes are known they may differ in ``bits + 2``. Bytes shared by very many files are cut
    into blocks compared pair by pair in tasks of their own; with ``forest`` these give only pairs that join the
    same files. With a ``cap`` bytes shared by more files are passed over, as the case application does with
    ``schema.BAND_CAP``. ``rows`` has id, h and d; featureless hashes must have been left out.
    """
    banded = hash_bands(cut(rows.select("id", "h", "d")))
    counts = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, cap) if cap is not None else F.col("n") >= 2)
    counts = cut(counts)  # at most 8 x 256 rows
    kept = banded.join(F.broadcast(counts.where(F.col("n") <= HOT_BUCKET).select("band", "key")), ["band", "key"], "left_semi")
    other = kept.select("band", "key", F.col("id").alias("b"), F.col("h").alias("hb"), F.col("d").alias("db"))
    near = kept.withColumnRenamed("id", "a").join(other, ["band", "key"]).where(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("h").bitwiseXOR(F.col("hb"))) <= bits)
        & (F.col("d").isNull() | F.col("db").isNull() | (F.bit_count(F.col("d").bitwiseXOR(F.col("db"))) <= bits + 2))
    )
    pairs = near.select("a", "b")
    hot = counts.where(F.col("n") > HOT_BUCKET).select("band", "key", F.ceil(F.col("n") / _BLOCK).cast("int").alias("blocks"))
    if hot.head(1):
        warm = banded.join(F.broadcast(hot), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        # A file goes to every pair of blocks that has its own; the pair (i, i) gets it on one side only.
        units = warm.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "band", "key", "id", "h", F.coalesce("d", F.lit(0).cast("long")).alias("d"), F.col("d").isNotNull().alias("known"),
            F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"),
        )
        pairs = pairs.unionByName(units.groupBy("band", "key", "i", "j").applyInPandas(lambda pdf: _block_pairs(pdf, bits, forest), "a long, b long"))
    return pairs.distinct()


def perceptual_groups(files: DataFrame, bits: int) -> DataFrame:
    """(id, group_id) over stack heads and unstacked files; files alike to none get no row."""
    rows = files.where(F.col("stack_id").isNull() | (F.col("stack_id") == F.col("id"))).select(
        "id", hex_to_long(hex_digits(F.col("phash"), 16)).alias("h"), hex_to_long(hex_digits(F.col("dhash"), 16)).alias("d")
    )
    pairs = perceptual_pairs(rows.where(S.meaningful_hash(F.col("h"))), bits, forest=True)
    return connected_components(pairs).select("id", F.col("head").alias("group_id"))


def near_clusters(files: DataFrame, bits: int = schema.CLUSTER_BITS) -> DataFrame:
    """(id, cluster_id) of every file: its group, or that of the head of its exact stack; null if alone."""
    groups = perceptual_groups(files, bits)
    head = F.coalesce("stack_id", "id")
    return files.select("id", head.alias("_head")).join(groups.select(F.col("id").alias("_head"), F.col("group_id").alias("cluster_id")), "_head", "left").select("id", "cluster_id")


def visual_stacks(files: DataFrame, bits: int = schema.VISUAL_BITS) -> DataFrame:
    """(id, vstack_id): near clusters at the stricter threshold of visual copies."""
    return near_clusters(files, bits).withColumnRenamed("cluster_id", "vstack_id")
