"""Known-hash matching with ranked provenance, and what follows from the hits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..functions.text import hex_digits, hex_to_long

#: Order in which digests and stores are asked.
ALGORITHM_RANK = {"sha256": 0, "sha1": 1, "md5": 2}
STORE_RANK = {"case": 0, "stash": 1, "global": 2}


def _ranked(values: dict[str, int], c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()], F.lit(9))


def file_digests(files: DataFrame) -> DataFrame:
    """(id, algo, value) of every usable digest; those of empty input match nothing."""
    digests = F.explode(F.array(*[F.struct(F.lit(a).alias("algo"), S.normal_hash(F.col(a)).alias("value")) for a in ALGORITHM_RANK]))
    rows = files.select("id", digests.alias("x")).select("id", "x.algo", "x.value")
    return rows.where(F.col("value").isNotNull() & (S.algorithm_of(F.col("value")) == F.col("algo")))


def match_known(files: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per file and set with the strongest hit: by digest, then store, then smallest category.

    ``entries`` has algo, value, set_name, store, kind, vic and category. Entries are first reduced to the
    strongest of each digest and set, so a digest that a set lists very often meets its files once.
    """
    rank = F.struct(_ranked(STORE_RANK, F.col("store")).alias("s"), F.coalesce("category", F.lit(9999)).alias("c"), "store", "kind", "vic", "category")
    listed = entries.groupBy("algo", "value", "set_name").agg(F.min(rank).alias("e"))
    hits = file_digests(files).join(listed, ["algo", "value"])
    best = F.min(F.struct(_ranked(ALGORITHM_RANK, F.col("algo")).alias("a"), "e.s", "e.c", "algo", "e.store", "e.kind", "e.vic", "e.category", "value"))
    return hits.groupBy("id", "set_name").agg(best.alias("b")).select("id", "set_name", "b.algo", "b.store", "b.kind", "b.vic", "b.category", "b.value")


def match_perceptual(files: DataFrame, entries: DataFrame, exact: DataFrame, bits: int = schema.MATCH_BITS) -> DataFrame:
    """For files without an exact hit, the nearest listed perceptual hash within ``bits``.

    With at most six differing bits two of the eight bytes are equal, so equality in a pair of bytes is a lossless
    candidate test (up to seven bits: in one byte). Equal hashes are compared once, on either side. Ties go to the
    smaller set name, then the smaller value.
    """
    if bits > 7:
        raise ValueError("hashes that differ in more than seven bits may share no byte")
    unmatched = files.join(exact.select("id").distinct(), "id", "left_anti").select("id", hex_to_long(hex_digits(F.col("phash"), 16)).alias("h")).where(F.col("h").isNotNull())
    byte = lambda i: F.shiftrightunsigned("h", 8 * i).bitwiseAND(F.lit(255))
    keys = [byte(i) * 256 + byte(k) for i, k in combinations(range(8), 2)] if bits <= 6 else [byte(i) for i in range(8)]
    banded = lambda df, *keep: df.select(*keep, F.posexplode(F.array(*keys)).alias("band", "key"))
    listed = entries.select("set_name", "value", hex_to_long(hex_digits(F.col("value"), 16)).alias("h")).where(F.col("h").isNotNull())
    listed = listed.groupBy("h").agg(F.min(F.struct("set_name", "value")).alias("x"))
    other = banded(listed, F.col("h").alias("e"), "x")
    d = F.bit_count(F.col("h").bitwiseXOR(F.col("e")))
    near = banded(unmatched.select("h").distinct(), "h").join(other, ["band", "key"]).withColumn("d", d).where(F.col("d") <= bits)
    best = near.groupBy("h").agg(F.min(F.struct("d", "x")).alias("b"))
    return unmatched.join(best, "h").select("id", "b.x.set_name", "b.x.value", F.col("b.d").alias("distance"))


def source_bit() -> Column:
    return (
        F.when(F.col("store") == "stash", schema.MASK_STASH).when(F.col("vic"), schema.MASK_VIC).when(F.col("kind") == "known-good", schema.MASK_GOOD).otherwise(schema.MASK_OTHER)
    )


def summarise_hits(hits: DataFrame, region: str = "US") -> DataFrame:
    """Per file: mask of sources, asserted category and the ordered list of set names.

    The category is the lowest code asserted by a known set, non-pertinent last, uncategorized ignored. Names
    come in the order vic, stash, other, good, then by name.
    """
    non_pertinent = schema.NON_PERTINENT.get(region, -1)
    asserted = F.when((F.col("kind") == "known") & F.col("category").isNotNull() & (F.col("category") != schema.UNCATEGORIZED), F.struct((F.col("category") == non_pertinent).alias("late"), F.col("category").alias("code")))
    order = F.when(source_bit() == schema.MASK_VIC, 0).when(source_bit() == schema.MASK_STASH, 1).when(source_bit() == schema.MASK_OTHER, 2).otherwise(3)
    return hits.groupBy("id").agg(
        F.bit_or(source_bit()).cast("int").alias("hashset_mask"),
        F.min(asserted).getField("code").alias("asserted"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "set_name"))).alias("l"),
    ).select("id", "hashset_mask", "asserted", F.array_join(F.transform("l", lambda x: x["set_name"]), ",").alias("sets"))


def rematch(files: DataFrame, hits: DataFrame, region: str = "US") -> DataFrame:
    """Files with their hit columns set or cleared, and categories adopted where none was given.

    A file without a category takes the asserted one; one hit only by known-good sets becomes non-pertinent
    if the region has such a code.
    """
    found = summarise_hits(hits, region)
    good = F.lit(schema.NON_PERTINENT.get(region)).cast("int")
    unset = F.col("category").isNull() | (F.col("category") == schema.UNCATEGORIZED)
    only_good = F.col("hashset_mask") == schema.MASK_GOOD
    adopted = F.when(unset & F.col("asserted").isNotNull(), F.col("asserted")).when(unset & only_good & good.isNotNull(), good).otherwise(F.col("category"))
    return files.join(found, "id", "left").select("id", adopted.alias("category"), F.coalesce("hashset_mask", F.lit(0)).alias("hashset_mask"), F.coalesce("sets", F.lit("")).alias("sets"))


def drop_source(hits: DataFrame, bit: int) -> DataFrame:
    """Hits left when one kind of source is turned off."""
    return hits.where(source_bit() != bit)


# --- the stash: notable hashes carried from case to case ------------------------------------------------

def stash_merge(stash: DataFrame, added: DataFrame) -> DataFrame:
    """Union by (md5, region): the smallest category is kept, and the source that came first."""
    rows = stash.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    rows = rows.withColumn("md5", hex_digits(F.col("md5"), 32)).where(F.col("md5").isNotNull() & ~F.col("md5").isin(*schema.EMPTY_HASHES))
    return rows.groupBy("md5", "region").agg(F.min("category").alias("category"), F.min(F.struct("_new", "added_at", "source")).alias("f")).select("md5", "region", "category", F.col("f.added_at").alias("added_at"), F.col("f.source").alias("source"))


def stash_candidates(files: DataFrame, notable: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Distinct usable MD5s of files in a notable category."""
    return files.where(F.col("category").isin(*notable)).select(hex_digits(F.col("md5"), 32).alias("md5"), "category").where(F.col("md5").isNotNull() & ~F.col("md5").isin(*schema.EMPTY_HASHES)).groupBy("md5").agg(F.min("category").alias("category"))


def set_summary(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per set: distinct entries and files matched, sets without a match included."""
    n = entries.groupBy("set_name").agg(F.countDistinct("algo", "value").alias("entries"))
    m = hits.groupBy("set_name").agg(F.countDistinct("id").alias("matched"))
    return n.join(m, "set_name", "left").select("set_name", "entries", F.coalesce("matched", F.lit(0)).alias("matched"))


def first_by(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Of rows with one key the first by ``seq``, as an insert that ignores repeats would keep."""
    w = Window.partitionBy(*key).orderBy(seq)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
