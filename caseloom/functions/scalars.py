"""Scalar column functions of the case engine: hashes, likes, paths, times, coordinates and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def like_escape(text: str, mark: str = "\\") -> str:
    """Escape the wildcards of a LIKE pattern with ``mark``."""
    for c in (mark, "%", "_"):
        text = text.replace(c, mark + c)
    return text


def contains_ci(c: Column, text: str) -> Column:
    """Case-insensitive substring test in which wildcards in ``text`` are plain characters."""
    return c.cast("string").ilike(f"%{like_escape(text)}%")


def algorithm_of(value: Column) -> Column:
    """Which hash a value is, by its length."""
    n = F.length(value)
    return F.when(n == 32, "md5").when(n == 40, "sha1").when(n == 64, "sha256")


def normal_hash(value: Column) -> Column:
    """Lower-case hexadecimal digest of one of the three lengths, not that of empty input; else null."""
    t = F.lower(F.trim(value))
    return F.when(t.rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") & ~t.isin(*schema.EMPTY_HASHES), t)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ; 999 if one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def meaningful_hash(h: Column) -> Column:
    """True for perceptual hashes with 12 to 52 bits set; featureless pictures have fewer or more."""
    return F.coalesce(F.bit_count(h).between(12, 52), F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def suffix(path: Column) -> Column:
    """Extension with its dot in lower case, empty without one; a leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def display_name(orig_name: Column, rel_path: Column, media_id: Column) -> Column:
    return F.coalesce(F.nullif(orig_name, F.lit("")), F.when(media_id.isNull(), rel_path))


def group_key() -> Column:
    return F.coalesce("vstack_id", "stack_id", "id")


def stack_key() -> Column:
    """What exact copies share: SHA-256, else MD5, the two never mixed."""
    return F.coalesce(F.nullif(F.col("sha256"), F.lit("")), F.concat(F.lit("md5:"), F.nullif(F.col("md5"), F.lit(""))))


def epoch_text(epoch: Column, zone: str = "UTC") -> Column:
    """Seconds since 1970 as text in a zone; empty for null and zero."""
    at = F.from_utc_timestamp(F.timestamp_seconds(F.floor(epoch)), zone)
    return F.when(epoch.isNull() | (epoch == 0), "").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """(lat, lon) rounded to seven digits, or null unless both are numbers in range and not both zero."""
    from .geo import usable_position

    return F.when(usable_position(lat, lon), F.struct(F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon")))


def leading_number(text: Column) -> Column:
    """The number a text begins with, 0 if it begins with none, null for null."""
    digits = F.regexp_extract(text, r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?", 0)
    return F.when(text.isNotNull(), F.coalesce(F.trim(digits).try_cast("double"), F.lit(0.0)))


def iso6709(text: Column) -> Column:
    """(lat, lon) of a location string: degrees, degrees and minutes, or degrees, minutes and seconds."""
    pattern = r"^\s*([+-])([0-9]+)(\.[0-9]+)?([+-])([0-9]+)(\.[0-9]+)?"

    def degrees(k: int, n: int) -> Column:
        sign, whole, part = (F.regexp_extract(text, pattern, k + i) for i in range(3))
        extra = F.length(whole) - n
        number = lambda at, size: F.substring(whole, F.lit(at), F.lit(size)).try_cast("double")
        last = lambda at: F.concat(F.substring(whole, at, 20), part).try_cast("double")
        v = F.when(extra == 0, last(1)).when(extra == 2, number(1, n) + last(n + 1) / 60).when(extra == 4, number(1, n) + number(n + 1, 2) / 60 + last(n + 3) / 3600)
        return F.when(sign == "-", -v).otherwise(v)

    return valid_coordinates(degrees(1, 2), degrees(4, 3))


def dms_degrees(text: Column, ref: Column) -> Column:
    """Signed degrees of up to three numbers and a compass direction; null without a valid direction."""
    n = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1)
    part = lambda k: F.coalesce(F.get(n, F.lit(k)).try_cast("double"), F.lit(0.0))
    low = F.lower(F.trim(ref))
    sign = F.when(low.isin("n", "north", "e", "east"), 1).when(low.isin("s", "south", "w", "west"), -1)
    return F.when(F.size(n) > 0, sign * F.abs(part(0) + part(1) / 60 + part(2) / 3600))


def mercator_pixel(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Pixel on the Web-Mercator world of 256-pixel tiles."""
    world = 256.0 * 2**zoom
    s = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.sin(F.radians(lat))))
    return (lon + 180.0) / 360.0 * world, (0.5 - F.ln((1 + s) / (1 - s)) / (4 * F.pi())) * world


def size_text(n: Column) -> Column:
    """Megabytes with one decimal above a million bytes, else whole kilobytes; empty for null and zero."""
    shown = lambda x, digits: F.format_string(f"%.{digits}f", F.bround(x, digits))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(n > 1e6, F.concat(shown(n / 1048576.0, 1), F.lit(" MB"))).otherwise(F.concat(shown(n / 1024.0, 0), F.lit(" KB")))


def duration_text(s: Column) -> Column:
    """Minutes and seconds; empty for null and zero."""
    whole = F.floor(s).cast("long")
    return F.when(F.coalesce(s, F.lit(0.0)) == 0, "").otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")))


def identifier(text: Column) -> Column:
    """Lower-case name of a table: signs dropped, white space to underscores, never beginning with a digit."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)[^\w\s]", "")), r"(?U)\s+", "_")
    return F.lower(F.when(bare.rlike("^[A-Za-z_]"), bare).otherwise(F.concat(F.lit("_"), bare)))


def kind_by_extension(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(*schema.IMAGE_EXTS), "image").when(e.isin(*schema.VIDEO_EXTS), "video").when(e.isin(*schema.ARCHIVE_EXTS), "archive").otherwise("other")


#: Leading bytes in hexadecimal of archives and of pictures.
ARCHIVE_HEADS = ("4C5A4300", "434D4D4D", "504B0304", "504B0506", "1F8B", "425A68", "FD377A585A00", "377ABCAF271C", "52617221")
PICTURE_HEADS = ("FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "424D", "49492A00", "4D4D002A", "0000000C6A5020200D0A870A", "FF4FFF51")
VIDEO_HEADS = ("1A45DFA3", "464C56")
#: Major brands of ISO media registered for sound.
SOUND_BRANDS = (
    "M4A ", "M4B ", "M4P ", "caaa", "caac", "cama", "camc", "casu", "ca4m", "ca4s", "ca4e", "ceac",
    "cmh1", "cmh2", "cmhm", "cmhs", "cabl", "dts1", "dts2", "dts3", "oa2d", "oabl", "ifaa", "iamf",
)


def kind_by_magic(head: Column) -> Column:
    """Kind of a file by its first 16 bytes; null for null."""
    digits = F.hex(head)
    brand = F.decode(F.substring(head, 9, 4), "ISO-8859-1")
    begins = lambda heads: reduce(Column.__or__, [digits.startswith(h) for h in heads])
    container = F.substring(digits, 17, 8)
    riff = F.when(container == "57454250", "image").when(container.isin("41564920", "41564900"), "video").otherwise("other")
    iso = F.when(F.substring(brand, 1, 2).isin("he", "mi", "ms") | brand.isin("avif", "avis"), "image").when(brand.isin(*SOUND_BRANDS), "other").otherwise("video")
    return (
        F.when(digits.isNull(), None)
        .when(begins(ARCHIVE_HEADS), "archive")
        .when(begins(PICTURE_HEADS), "image")
        .when(digits.startswith("52494646"), riff)
        .when(F.substring(digits, 9, 8) == "66747970", iso)
        .when(begins(VIDEO_HEADS), "video")
        .otherwise("other")
    )
