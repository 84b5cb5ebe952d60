"""Attribute-value rows into one typed row per entity.

The grid of entities and attributes is completed first, the values are left-joined to it, each entity's
cells are collected in the order of the attribute positions, and fixed array indices are projected through
casts of the attribute's own type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDERS, tidy
from ..session import small

#: Exif wordings of the four plain orientations.
ORIENTATION_WORDS = {
    "horizontal (normal)": "1", "horizontal": "1", "normal": "1", "top-left": "1",
    "rotate 180": "3", "rotated 180": "3", "bottom-right": "3",
    "rotate 90 cw": "6", "rotated 90 cw": "6", "right-top": "6",
    "rotate 270 cw": "8", "rotated 270 cw": "8", "left-bottom": "8",
}
#: Wordings of a flash that fired or did not.
FLASH_FIRED = ("true", "yes", "on", "fired", "flash fired", "on, fired", "y")
FLASH_QUIET = ("false", "no", "off", "did not fire", "flash did not fire", "off, did not fire", "not fired", "no flash", "n")

_WHOLE = r"(?i)^(?:[a-z]{1,12}[\s:=]*)?\+?([0-9]{1,3}(?:[,'\s\u00a0\u202f_][0-9]{3})+|[0-9]+)(?:\.0+)?\s*(?:[a-z]{1,12}\.?)?$"
_RATIO = r"(?i)^(?:{prefix})?\s*\+?([0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)(?:\s*/\s*([0-9]+(?:[.,][0-9]+)?))?\s*({unit})?\.?$"
_F_NUMBER = _RATIO.format(prefix=r"f\s*/?\s*|ƒ\s*/?\s*", unit=r"[a-z]{1,10}")
_EXPOSURE = _RATIO.format(prefix=r"[a-z]{1,12}[\s:=]+", unit=r"ms|msec|milliseconds?|s|sec|secs|seconds?|us|µs|″|\"")


@dataclass(frozen=True)
class Attribute:
    """One column of the wide table: its field name, Spark type and reader of a raw text."""

    field: str
    type: str
    read: str


MEDIA_ATTRIBUTES = (
    Attribute("make", "string", "text"),
    Attribute("model", "string", "text"),
    Attribute("software", "string", "text"),
    Attribute("orientation", "int", "orientation"),
    Attribute("width", "int", "whole"),
    Attribute("height", "int", "whole"),
    Attribute("iso", "int", "whole"),
    Attribute("flash", "boolean", "flash"),
    Attribute("f_number", "decimal(6,1)", "f_number"),
    Attribute("exposure_us", "int", "exposure"),
)


def _ratio(top: str, bottom: str) -> Column:
    """Two written numbers as an exact decimal ratio; null if the lower one is zero or either is unreadable."""
    number = lambda c: F.translate(F.col(c), ",", ".").try_cast("decimal(20,9)")
    under = F.when(F.col(bottom) == "", F.lit(1).cast("decimal(20,9)")).otherwise(number(bottom))
    return F.try_divide(number(top).cast("decimal(24,9)"), F.nullif(under, F.lit(0).cast("decimal(20,9)")))


def with_read_value(rows: DataFrame, attribute: str, raw: str, attributes: tuple[Attribute, ...] = MEDIA_ATTRIBUTES) -> DataFrame:
    """Add ``val``: the text form of column ``raw`` as the type of the row's attribute, null if unreadable.

    The work is staged over several projections, so that each pattern is matched once per row and the
    generated code stays small.
    """
    of = {k: F.col(attribute).isin(*[a.field for a in attributes if a.read == k] or [""]) for k in ("text", "whole", "orientation", "flash", "f_number", "exposure")}
    # A pattern that matches leaves its groups behind a mark, so that every text is matched once only.
    taken = lambda pattern, groups: F.regexp_replace("_text", pattern, "\x01" + groups)
    staged = rows.withColumn("_text", tidy(F.col(raw)))
    staged = staged.withColumn("_low", F.when(of["orientation"] | of["flash"], F.regexp_replace(F.lower("_text"), r"\s+", " ")).when(of["text"], F.lower("_text")))
    marked = (
        F.when(of["whole"], F.when(F.col("_text").rlike("^[0-9]{1,9}$"), F.concat(F.lit("\x01"), "_text")).otherwise(taken(_WHOLE, "$1")))
        .when(of["f_number"], taken(_F_NUMBER, "$1|$2|$3"))
        .when(of["exposure"], taken(_EXPOSURE, "$1|$2|$3"))
        .when(of["orientation"], F.concat(F.lit("\x01"), F.regexp_extract("_low", r"^([1-8])(?:\.0+)?(?:\s*\(.*\))?$", 1)))
        .when(of["flash"] & F.col("_low").rlike(r"^[0-9]{1,3}$"), F.concat(F.lit("\x01"), "_low"))
    )
    staged = staged.withColumn("_marked", marked)
    staged = staged.withColumn("_parts", F.when(F.col("_marked").startswith("\x01"), F.split(F.expr("substring(_marked, 2)"), r"\|", -1)))
    staged = staged.select("*", F.get("_parts", F.lit(0)).alias("_top"), F.get("_parts", F.lit(1)).alias("_bottom"), F.lower(F.get("_parts", F.lit(2))).alias("_unit"))
    staged = staged.withColumn("_ratio", F.when(of["f_number"] | of["exposure"], _ratio("_top", "_bottom")))
    scale = F.when(F.col("_unit").isin("us", "\u00b5s"), F.lit(1)).when(F.col("_unit").startswith("m"), F.lit(1000)).otherwise(F.lit(1_000_000))
    n = (
        F.when(of["whole"], F.regexp_replace("_top", "[^0-9]", "").try_cast("int"))
        .when(of["exposure"], F.round(F.col("_ratio") * scale.cast("decimal(8,0)"), 0).try_cast("int"))
        .when(of["flash"], F.col("_top").try_cast("int"))
    )
    staged = staged.withColumn("_n", n)
    words = F.create_map(*[F.lit(x) for kv in ORIENTATION_WORDS.items() for x in kv])
    fired = F.col("_low").isin(*FLASH_FIRED) | F.col("_low").startswith("on, fired") | F.col("_low").startswith("auto, fired") | F.col("_low").startswith("fired,")
    quiet = F.col("_low").isin(*FLASH_QUIET) | F.col("_low").startswith("off, did not fire") | F.col("_low").startswith("auto, did not fire")
    val = (
        F.when(of["text"], F.when(~F.col("_low").isin(*PLACEHOLDERS), F.col("_text")))
        .when(of["whole"] | of["exposure"], F.when(F.col("_n") > 0, F.col("_n").cast("string")))
        .when(of["f_number"], F.when(F.col("_ratio") > 0, F.round("_ratio", 1).try_cast("decimal(6,1)").cast("string")))
        .when(of["orientation"], F.coalesce(F.nullif(F.col("_top"), F.lit("")), F.try_element_at(words, F.col("_low"))))
        .when(of["flash"], F.when(fired, "true").when(quiet, "false").when(F.col("_n").between(0, 127), F.when(F.col("_n") % 2 == 1, "true").otherwise("false")))
    )
    return staged.withColumn("val", val).drop("_text", "_low", "_marked", "_parts", "_top", "_bottom", "_unit", "_ratio", "_n")


def pivot_attributes(
    rows: DataFrame, names: DataFrame, entity: tuple[str, ...] = ("hashset_id", "media_id"), attributes: tuple[Attribute, ...] = MEDIA_ATTRIBUTES
) -> DataFrame:
    """One row per entity with one typed column per attribute.

    ``rows`` has the entity columns, ``name_id``, ``seq`` and ``value``; ``names`` has ``id`` and ``field``.
    A cell holds the first value by ``seq`` (nulls last, then the smaller text) that can be read as the
    attribute's type, over all names of the field. Entities none of whose values can be read still get a row,
    all null; rows with a null entity column name no entity and are left out, unknown names count for nothing,
    repeated rows count once. Extra columns of either input are ignored. Empty inputs give an empty table.
    """
    rows = rows.select(*entity, "name_id", "seq", "value").dropna(subset=list(entity))
    names = names.select(F.col("id").alias("name_id"), "field").where(F.col("field").isin(*[a.field for a in attributes])).distinct()
    position = F.create_map(*[x for i, a in enumerate(attributes) for x in (F.lit(a.field), F.lit(i))])
    names = names.withColumn("pos", F.element_at(position, F.col("field")))
    named = rows.join(small(names, 100_000), "name_id")
    read = with_read_value(named, "field", "value", attributes).withColumn("seq", F.coalesce("seq", F.lit(2**31 - 1)))
    # The partial aggregate runs before the shuffle: an entity with a third of all rows leaves each map task as
    # at most one row per attribute. Unreadable values are dropped inside the aggregate, as a filter on them
    # would be pushed down through the staged projections and repeat their work.
    first = read.groupBy(*entity, "pos").agg(F.min(F.when(F.col("val").isNotNull(), F.struct("seq", "val"))).alias("first"))
    values = first.select(*entity, "pos", F.col("first.val").alias("val"))
    grid = rows.select(*entity).distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(len(attributes) - 1))))
    cells = grid.join(values, [*entity, "pos"], "left").groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("cells"))
    return cells.select(*entity, *[F.col("cells")[i]["val"].try_cast(a.type).alias(a.field) for i, a in enumerate(attributes)])


def unpivot_filled(wide: DataFrame, entity: tuple[str, ...] = ("hashset_id", "media_id"), attributes: tuple[Attribute, ...] = MEDIA_ATTRIBUTES) -> DataFrame:
    """The filled cells of the wide table as (entity, field, val) text rows."""
    cells = F.array(*[F.struct(F.lit(a.field).alias("field"), F.col(a.field).cast("string").alias("val")) for a in attributes])
    return wide.select(*entity, F.explode(cells).alias("c")).select(*entity, "c.field", "c.val").where(F.col("val").isNotNull())
