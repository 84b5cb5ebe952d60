"""Known-hash lists out of text, CSV, TSV and JSON, with counts of what was read and skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S

#: Members of a JSON record that may hold its category, the first one present counting.
CATEGORY_MEMBERS = ("category", "mediacategory", "vicscategory")
HASH_MEMBERS = ("md5", "sha1", "sha256")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of a list in UTF-8, or UTF-16 told by its byte-order mark.

    Files are read whole to see their mark, so a single list should not exceed what one task can hold.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    head = F.hex(F.substring("content", 1, 3))
    text = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode("content", "UTF-16")).when(head == "EFBBBF", F.decode(F.expr("substring(content, 4)"), "UTF-8")).otherwise(F.decode("content", "UTF-8"))
    return raw.select("path", F.posexplode(F.split(text, r"\r?\n")).alias("line", "value"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, status, algo, hash, category) of every line (line, value).

    A line holds a digest and perhaps, after a comma, semicolon or tab, a category of digits only. Status is
    ``read``, ``skipped`` (no digest), ``empty`` (the digest of empty input) or ``blank``.
    """
    parts = F.split(F.trim(F.regexp_replace("value", '"', "")), r"[,;\t]")
    first, second = F.lower(F.trim(parts[0])), F.trim(F.get(parts, F.lit(1)))
    digest = first.rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")
    status = F.when(F.trim("value") == "", "blank").when(~digest, "skipped").when(first.isin(*schema.EMPTY_HASHES), "empty").otherwise("read")
    rows = lines.where(F.col("value").isNotNull()).select("line", status.alias("status"), first.alias("_h"), F.when(second.rlike("^[0-9]{1,9}$"), second.try_cast("int")).alias("category"))
    good = F.col("status") == "read"
    return rows.select("line", "status", F.when(good, S.algorithm_of(F.col("_h"))).alias("algo"), F.when(good, F.col("_h")).alias("hash"), F.when(good, F.col("category")).alias("category"))


def list_counts(parsed: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return parsed.agg(n("read"), n("skipped"), n("empty"))


def refuse_without_hashes(parsed: DataFrame) -> DataFrame:
    """The parsed lines, or an error when run if not one of them holds a digest."""
    check = parsed.agg(F.count_if(F.col("status") == "read").alias("n")).select(F.assert_true(F.col("n") > 0, F.lit("the list holds no usable hash")).alias("ok"))
    return parsed.join(F.broadcast(check)).where(F.col("ok").isNull()).drop("ok")


def category_of(record: Column) -> Column:
    """Category of a record given as a map of lower-case member names to texts.

    The first member that is present and not blank decides, even if it is no number (then null).
    """
    present = [F.nullif(F.trim(F.try_element_at(record, F.lit(m))), F.lit("")) for m in CATEGORY_MEMBERS]
    return F.coalesce(*present).try_cast("int")


def record_entries(records: DataFrame) -> DataFrame:
    """(rec, algo, value, category) of JSON records (rec, body), member names in any letter case."""
    m = F.from_json("body", "map<string,string>")
    low = F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))))
    rows = records.select("rec", low.alias("m")).where(F.col("m").isNotNull())
    digests = F.explode(F.array(*[F.struct(F.lit(a).alias("algo"), S.normal_hash(F.try_element_at("m", F.lit(a))).alias("value")) for a in HASH_MEMBERS]))
    rows = rows.select("rec", category_of(F.col("m")).alias("category"), digests.alias("x")).select("rec", "x.algo", "x.value", "category")
    return rows.where(F.col("value").isNotNull() & (S.algorithm_of(F.col("value")) == F.col("algo")))
