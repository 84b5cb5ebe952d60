"""Consolidating pairwise matches into groups, over any number of pairs.

``connected_groups`` runs union-find within partitions of the edges, keeps only the spanning forests, and
merges them through partitions of bounded size, gathered by either end of the edges in turn. A node all of whose
edges ended up under one root leaves the work at once; only nodes that still join different roots go on. Nothing is
collected: each round is a shuffle of what is left, and labels are resolved backwards through the rounds.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hex_digits, hex_to_long
from ..operators.components import local_forest, union_find
from ..session import cut, small

#: Edges that one merging partition gets on average.
EDGES_PER_PARTITION = 1_000_000


def connected_groups(edges: DataFrame, per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """(node, group) for every node of ``edges`` (a, b); group is the smallest node reached.

    Edges with a null end or from a node to itself join nothing, repeated and reversed edges count once.
    Nodes without an edge do not appear; no edges give no rows. Ids are 64-bit integers.
    """
    left = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where(F.col("a") != F.col("b"))
    settled: list[DataFrame] = []
    width, before = None, None
    while True:
        stars = left.mapInPandas(local_forest, "node long, root long")
        # A node has at most one root per partition, so its set of roots is bounded by their number.
        roots = cut(stars.groupBy("node").agg(F.collect_set("root").alias("roots")))
        settled.append(roots.where((F.size("roots") == 1) & (F.col("roots")[0] != F.col("node"))).select("node", F.col("roots")[0].alias("group")))
        open_ = roots.where(F.size("roots") > 1).select(F.col("node").alias("a"), F.explode("roots").alias("b")).where(F.col("a") != F.col("b"))
        n = open_.count()
        if not n:
            break
        # As many partitions as keep each within the bound, while every round leaves half of the edges or fewer;
        # a round that leaves more is followed by one with half as many partitions.
        most = width or roots.rdd.getNumPartitions()
        width = max(1, min(math.ceil(n / per_partition), most if before is not None and 2 * n <= before else most // 2))
        left, before = open_.repartition(width, "ab"[len(settled) % 2]), n
    final = settled[-1]
    for earlier in settled[-2::-1]:
        above = final.select(F.col("node").alias("group"), F.col("group").alias("top"))
        final = final.unionByName(earlier.join(above, "group", "left").select("node", F.coalesce("top", "group").alias("group")))
    final = cut(final) if len(settled) > 1 else final
    return final.unionByName(final.select(F.col("group").alias("node"), "group").distinct())


# --- pairs of alike perceptual hashes ------------------------------------------------------------------

PHASH_BITS, DHASH_BITS, LONE_PHASH_BITS = 6, 8, 2
#: Buckets believed to hold more codes than this are compared in blocks instead of by a join.
HOT_BUCKET = 512
#: One code in so many is looked at to find hot buckets; either way of comparing is exact.
_SEEN = 8
_BLOCK = 1024


def _bands(h: Column, blocks: int, chosen: int) -> Column:
    """Keys of all choices of ``chosen`` among ``blocks`` equal blocks of a 64-bit hash.

    Two hashes that differ in at most ``blocks - chosen`` bits share one of them.
    """
    bits = 64 // blocks
    mask = (1 << bits) - 1
    block = [F.shiftrightunsigned(h, bits * i).bitwiseAND(F.lit(mask)) for i in range(blocks)]
    keys = []
    for k, choice in enumerate(combinations(range(blocks), chosen)):
        value = F.lit(k).cast("long")
        for i in choice:
            value = F.shiftleft(value, bits).bitwiseOR(block[i])
        keys.append(value)
    return F.explode(F.array(*keys))


def _differ(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges of the links within one pair of blocks of a hot bucket."""
    side = pdf["side"].to_numpy()
    ids, h, d = (pdf[c].to_numpy() for c in ("cid", "h", "d"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for i in left:
        near = right[(np.bitwise_count((h[right] ^ h[i]).view("uint64")) <= PHASH_BITS) & (np.bitwise_count((d[right] ^ d[i]).view("uint64")) <= DHASH_BITS)]
        a.append(np.full(len(near), ids[i]))
        b.append(ids[near])
    if not a:
        return pd.DataFrame({"a": np.empty(0, "int64"), "b": np.empty(0, "int64")})
    node, root = union_find(np.concatenate(a), np.concatenate(b))
    keep = node != root
    return pd.DataFrame({"a": node[keep], "b": root[keep]})


def alike_codes(codes: DataFrame) -> DataFrame:
    """Links (a, b) between codes (cid, h, d): hashes differ in few bits.

    With both ``d`` present, ``h`` may differ in 6 bits and ``d`` in 8; else ``h`` in 2. Candidates share two
    of eight (two of four) blocks, which loses no pair. Buckets that hold very many codes are cut into blocks
    compared pair by pair in tasks of their own, each giving only a spanning forest of its links.
    """
    full = codes.where(F.col("d").isNotNull())
    banded = full.select("cid", "h", "d", _bands(F.col("h"), 8, 2).alias("key"))
    seen = full.where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(_SEEN)) == 0).select(_bands(F.col("h"), 8, 2).alias("key"))
    hot = cut(seen.groupBy("key").count().where(F.col("count") >= HOT_BUCKET // _SEEN).select("key", F.ceil(F.col("count") * _SEEN / _BLOCK).cast("int").alias("blocks")))
    any_hot = bool(hot.head(1))
    cool = banded.join(small(hot.select("key"), 500_000), "key", "left_anti") if any_hot else banded
    other = cool.select("key", F.col("cid").alias("cid2"), F.col("h").alias("h2"), F.col("d").alias("d2"))
    links = cool.join(other, "key").where((F.col("cid") < F.col("cid2")) & (_differ("h", "h2") <= PHASH_BITS) & (_differ("d", "d2") <= DHASH_BITS)).select(F.col("cid").alias("a"), F.col("cid2").alias("b"))
    if any_hot:
        warm = banded.join(small(hot, 500_000), "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        # A code goes to every pair of blocks that has its own; the pair (i, i) gets it on one side only.
        units = warm.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "key", "cid", "h", "d", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side")
        )
        links = links.unionByName(units.groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long"))
    return links.unionByName(_lone_links(codes))


def _lone_block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges of the links between a block of lone codes and a block of all codes of a hot bucket."""
    side, ids, h, whole = (pdf[c].to_numpy() for c in ("side", "cid", "h", "whole"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a: list[np.ndarray] = [np.empty(0, "int64")]
    b: list[np.ndarray] = [np.empty(0, "int64")]
    for i in left:
        near = right[(np.bitwise_count((h[right] ^ h[i]).view("uint64")) <= LONE_PHASH_BITS) & (ids[right] != ids[i]) & (whole[right] | (ids[right] > ids[i]))]
        a.append(np.full(len(near), ids[i]))
        b.append(ids[near])
    node, root = union_find(np.concatenate(a), np.concatenate(b))
    keep = node != root
    return pd.DataFrame({"a": node[keep], "b": root[keep]})


def _lone_links(codes: DataFrame) -> DataFrame:
    """Links of codes without a second hash: candidates share two of four blocks; hot buckets go in pairs of blocks."""
    lone = codes.where(F.col("d").isNull()).select("cid", "h", _bands(F.col("h"), 4, 2).alias("key"))
    every = codes.select("cid", "h", F.col("d").isNotNull().alias("whole"), _bands(F.col("h"), 4, 2).alias("key"))
    few = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) * _SEEN / _BLOCK)).cast("int")
    seen = every.where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(_SEEN)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("whole")).alias("m"))
    hot = cut(seen.where(F.col("n") >= HOT_BUCKET // _SEEN).select("key", few("n").alias("blocks"), few("m").alias("lone_blocks")))
    any_hot = bool(hot.head(1))
    cool = lone.join(small(hot.select("key"), 500_000), "key", "left_anti") if any_hot else lone
    other = every.select("key", F.col("cid").alias("b"), F.col("h").alias("hb"), "whole")
    near = cool.join(other, "key").where((_differ("h", "hb") <= LONE_PHASH_BITS) & (F.col("cid") != F.col("b")) & (F.col("whole") | (F.col("cid") < F.col("b"))))
    links = near.select(F.col("cid").alias("a"), "b")
    if any_hot:
        at = lambda blocks: F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")
        to = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
        known = small(hot, 500_000)
        left = lone.join(known, "key").withColumns({"i": at("lone_blocks")}).withColumn("j", to("blocks")).select("key", "i", "j", "cid", "h", F.lit(False).alias("whole"), F.lit(0).alias("side"))
        right = every.join(known, "key").withColumns({"j": at("blocks")}).withColumn("i", to("lone_blocks")).select("key", "i", "j", "cid", "h", "whole", F.lit(1).alias("side"))
        links = links.unionByName(left.unionByName(right).groupBy("key", "i", "j").applyInPandas(_lone_block_links, "a long, b long"))
    return links


#: Ids that are only named, not in ``files``, are moved above all others, so that no group is named after one.
_GONE = 1 << 62


def file_links(files: DataFrame) -> DataFrame:
    """All links (a, b) of files: stored stacks, stored visual stacks and alike perceptual hashes."""
    rows = files.where(F.col("id").isNotNull())
    stored = rows.select("id", F.explode(F.array("stack_id", "vstack_id")).alias("to")).where(F.col("to").isNotNull() & (F.col("to") != F.col("id"))).distinct()
    known = rows.select(F.col("id").alias("to"), F.lit(True).alias("here")).distinct()
    stored = stored.join(known, "to", "left").select(F.col("id").alias("a"), F.when(F.col("here"), F.col("to")).otherwise(F.col("to") + F.lit(_GONE)).alias("b"))
    h = hex_to_long(hex_digits(F.col("phash"), 16))
    hashed = rows.select("id", h.alias("h"), hex_to_long(hex_digits(F.col("dhash"), 16)).alias("d")).where(F.col("h").isNotNull() & F.bit_count("h").between(12, 52))
    codes = cut(hashed.groupBy("h", "d").agg(F.min("id").alias("cid"), F.max("id").alias("last")))
    # Copies of one code hang on its smallest id; only codes of several files are joined back.
    several = codes.where(F.col("cid") != F.col("last")).select("h", F.col("d").alias("dd"), F.col("cid").alias("b"))
    copies = hashed.join(several, (hashed["h"] == several["h"]) & hashed["d"].eqNullSafe(several["dd"])).where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b")
    return stored.unionByName(copies).unionByName(alike_codes(codes.select("cid", "h", "d")))


def file_groups(files: DataFrame) -> DataFrame:
    """(file_id, group_id) of every file linked, directly or not, to another file.

    A stored id links also if no file has it any more; two files naming it are then linked through it.
    Hashes that are not 16 hexadecimal digits, or have fewer than 12 or more than 52 bits set, link nothing.
    ``group_id`` is the smallest id in ``files`` of the group. Repeated rows count once, rows with a null id
    are left out, extra columns are ignored; no rows give no rows.
    """
    groups = connected_groups(file_links(files)).where((F.col("node") < _GONE) & (F.col("group") < _GONE))
    others = groups.where(F.col("node") != F.col("group"))
    heads = others.select(F.col("group").alias("node"), "group").distinct()
    return others.unionByName(heads).select(F.col("node").alias("file_id"), F.col("group").alias("group_id"))
