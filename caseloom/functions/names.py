"""Column builders for file names, media types, free text of records and content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: Media types and the extension a file of each gets.
MIME_EXTENSIONS = {
    "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/bmp": ".bmp", "image/webp": ".webp", "image/tiff": ".tif", "image/heic": ".heic", "image/heif": ".heif",
    "image/avif": ".avif", "image/jp2": ".jp2", "video/mp4": ".mp4", "video/quicktime": ".mov", "video/x-msvideo": ".avi", "video/x-matroska": ".mkv", "video/webm": ".webm", "video/3gpp": ".3gp",
    "video/mpeg": ".mpg", "application/pdf": ".pdf", "application/zip": ".zip",
}
#: Media types that say nothing.
VAGUE_MIMES = ("image/unknown", "application/octet-stream", "")
#: Members of an object that stand for it, the first filled one counting.
_NAMES = ("Name", "name", "Title", "title")
#: Bytes from either end that a weak identity looks at.
EDGE = 1 << 20


def mime_extension(mime: Column) -> Column:
    """The extension of a media type, parameters and case ignored; null for an unknown one."""
    plain = F.lower(F.trim(F.split(mime, ";")[0]))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv]), plain)


def kind_from_mime(mime: Column, path: Column) -> Column:
    """The kind an extension gives, else that of a media type which is not vague, else ``other``."""
    by_ext, low = S.kind_by_extension(S.suffix(path)), F.lower(F.coalesce(mime, F.lit("")))
    named = F.when(low.isin(*VAGUE_MIMES), "other").when(low.startswith("video/"), "video").when(low.startswith("image/"), "image").otherwise("other")
    return F.when(by_ext != "other", by_ext).otherwise(named)


def slug(text: Column) -> Column:
    """At most 60 letters, digits, dots, dashes and underscores; other runs become one dash."""
    dashed = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.substring(F.btrim(dashed, F.lit("-")), 1, 60), F.lit("")), F.lit("archive"))


def digest_name(member: Column) -> Column:
    """SHA-1 of a member's name with its own extension, if that is a plain one."""
    ext = F.lower(S.suffix(member))
    return F.concat(F.sha1(member), F.when(ext.rlike(r"^\.[a-z0-9]{1,8}$"), ext).otherwise(""))


def content_name(name: Column) -> Column:
    """What a compressed single file holds: its own name without the suffix of the compression."""
    return F.coalesce(F.nullif(F.regexp_replace(S.base_name(name), r"(?i)\.(gz|bz2|xz|tgz|tbz2|txz)$", ""), F.lit("")), F.lit("content"))


def as_text(value: Column) -> Column:
    """A record's field, given as JSON, as text: strings trimmed, objects by their name or title; null if empty."""
    whole = F.trim(value)
    plain = F.when(whole.startswith('"'), F.trim(F.get_json_object(F.concat(F.lit('{"v":'), whole, F.lit("}")), "$.v"))).otherwise(whole)
    named = F.coalesce(*[F.nullif(F.get_json_object(whole, f"$.{k}"), F.lit("")) for k in _NAMES], whole)
    return F.when(whole.startswith("{"), named).otherwise(F.nullif(F.nullif(plain, F.lit("")), F.lit("null")))


def scrub_paths(text: Column) -> Column:
    """A message without absolute paths, quoted or bare, and without what a removed one leaves dangling."""
    root = r"(?:[A-Za-z]:[\\/]|\\\\|/(?=[^\s/]+/))"
    out = F.regexp_replace(text, rf"(['\"]){root}[^'\"]*\1", "")
    out = F.regexp_replace(out, rf"(?<![\w.:/\\]){root}[^\s'\"()\[\],;]+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[\s:,;]+(?=\))", ""), r"\(\s*\)", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"\s+(?=[:,;)])", ""), r"\s+", " "), F.lit(" :,;"))


def capture_date(embedded: Column, file_time: Column) -> Column:
    """When a picture was taken: what it says itself and nothing else; a file's own time never stands in."""
    return F.nullif(F.trim(embedded), F.lit(""))


def content_digests(content: Column) -> dict[str, Column]:
    """The three digests of a content, from one read of it."""
    return {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256)}


def weak_identity(content: Column, size: Column) -> Column:
    """SHA-256 over the size and the first and last mebibyte: tells a large archive again without reading it."""
    tail = F.when(size > EDGE, F.substring(content, -EDGE, EDGE)).otherwise(F.lit(b""))
    return F.concat_ws("-", size.cast("string"), F.sha2(F.concat(F.encode(size.cast("string"), "UTF-8"), F.substring(content, 1, EDGE), tail), 256))
