"""Column builders for text values; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value" in the case tables.
PLACEHOLDERS = ("", "unknown", "n/a", "none", "null", "-")

_EDGES = " \t\n\x0b\f\r\x00"


def tidy(c: Column) -> Column:
    """The text without surrounding white space and NUL characters."""
    return F.btrim(c.cast("string"), F.lit(_EDGES))


def is_blank(c: Column) -> Column:
    """True for null and, after trimming and ignoring case, placeholder texts."""
    return c.isNull() | F.lower(tidy(c)).isin(*PLACEHOLDERS)


def filled_text(c: Column) -> Column:
    """The tidied text, or null if it is blank or a placeholder."""
    return F.when(~is_blank(c), tidy(c))


def hex_digits(c: Column, digits: int) -> Column:
    """The lower-case hexadecimal text of exactly ``digits`` digits, or null."""
    t = F.lower(F.trim(c))
    return F.when(t.rlike(f"^[0-9a-f]{{{digits}}}$"), t)


def hex_to_long(c: Column) -> Column:
    """Sixteen hexadecimal digits as a signed 64-bit integer."""
    return F.conv(c, 16, -10).cast("long")


def slashed(c: Column) -> Column:
    return F.translate(c, "\\", "/")
