"""Scalar functions of record details, documents, tiles and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

#: The five flags of an imported record, in the order of their bits.
RECORD_FLAGS = ("VictimIdentified", "OffenderIdentified", "IsDistributed", "IsSuspected", "SelfGenerated")
#: Review buckets beside the categories.
TRIAGE = {"non_pertinent": "Non-pertinent", "pertinent_other": "Pertinent - other evidence", "review": "Needs review", "skip": "Skipped"}
#: Families of metadata tags.
_VIDEO_FAMILIES = ("QuickTime", "RIFF", "Matroska", "M2TS", "H264", "MPEG", "ASF", "FLV", "MXF")
_FILE_FAMILIES = ("File", "JFIF", "PNG", "ICC_Profile", "Photoshop", "JPEG", "GIF", "BMP", "Adobe", "APP14", "FlashPix", "MPF", "PrintIM")


def truth(text: Column) -> Column:
    """true or 1, false or 0, in any letter case; anything else is null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def pack_flags(flags: list[Column]) -> Column:
    """One integer: bit i says that flag i is known, bit 8 + i that it is true; null if none is known."""
    bits = [F.when(f.isNull(), 0).when(f, (1 << i) | (1 << (8 + i))).otherwise(1 << i) for i, f in enumerate(flags)]
    return F.nullif(reduce(lambda a, b: a + b, bits), F.lit(0))


def unpack_flag(packed: Column, i: int) -> Column:
    return F.when(packed.bitwiseAND(F.lit(1 << i)) != 0, packed.bitwiseAND(F.lit(1 << (8 + i))) != 0)


def exif_date(text: Column) -> Column:
    """ISO text of a camera date, or null; an offset stays."""
    t = F.trim(F.regexp_replace(text, "\x00", ""))
    pattern = r"^(\d{4})[:-](\d{2})[:-](\d{2}) (\d{2}:\d{2}:\d{2})([+-]\d{2}:?\d{2})?$"
    same = t.rlike(r"^\d{4}:\d{2}:\d{2} .*$") | t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
    parts = [F.regexp_extract(t, pattern, k) for k in range(1, 6)]
    zone = F.regexp_replace(parts[4], r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    day = F.concat_ws("-", *parts[:3])
    whole = F.concat(day, F.lit(" "), parts[3]).try_cast("timestamp_ntz")
    return F.when(same & t.rlike(pattern) & whole.isNotNull(), F.concat(day, F.lit("T"), parts[3], zone))


def tile_id(z: int, x: Column, y: Column) -> Column:
    """Number of a map tile along the Hilbert curve of its zoom, after all tiles of smaller zooms."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(((1 << (2 * z)) - 1) // 3).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx = F.when(a["x"].bitwiseAND(s) != 0, 1).otherwise(0)
        ry = F.when(a["y"].bitwiseAND(s) != 0, 1).otherwise(0)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - a["x"]).otherwise(a["x"]), F.when(flip, s - 1 - a["y"]).otherwise(a["y"])
        d = a["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        return F.struct(F.when(ry == 0, fy).otherwise(a["x"]).alias("x"), F.when(ry == 0, fx).otherwise(a["y"]).alias("y"), d.alias("d"))

    sizes = F.array(*[F.lit(1 << k).cast("long") for k in range(z - 1, -1, -1)]) if z else F.array().cast("array<long>")
    return F.aggregate(sizes, start, step)["d"]


def frame_picks(total: Column, count: int) -> Column:
    """Frames to show of a video: evenly spread, the first and the last among them, each once."""
    n = F.least(F.lit(count).cast("long"), total)
    at = lambda i: F.floor(i * (total - 1) / F.greatest(n - 1, F.lit(1)).cast("double")).cast("long")
    return F.when(total > 0, F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at)))


def tag_category(family: Column, group: Column) -> Column:
    return (
        F.when(family == "Composite", "composite").when(group == "GPS", "gps").when(family == "EXIF", "exif").when(family == "MakerNotes", "makernotes").when(family == "XMP", "xmp")
        .when(family == "IPTC", "iptc").when(family.isin(*_VIDEO_FAMILIES), "video").when(family.isin(*_FILE_FAMILIES), "file").otherwise("other")
    )


def hex_slice(content: Column, offset: int, length: int) -> Column:
    """Bytes of a file in hexadecimal; the length lies between 16 and 65536."""
    return F.lower(F.hex(F.substring(content, max(0, offset) + 1, min(max(16, length), 65536))))


def triage_label(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TRIAGE.items() for x in kv]), code)


#: What is said of the place and of the copy of an extracted item.
_UNDRAWN, _DATA_URI = "an image no page draws", "embedded in the page (data: URI)"
_ATTACHED, _RESOURCE = "attached file", "a resource saved with the page"
_SAME_BYTES = "byte for byte"
_REBUILT = "rebuilt from the PDF's pixels as a PNG; its hashes are not an original file's"
_SAVED_PAGES = (".mht", ".mhtml", ".webarchive")


class _ItemName:
    """An extracted item's name taken apart at its underscores: lead, number of its object, and what follows."""

    def __init__(self, name: Column) -> None:
        self.base = F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)
        self.parts = F.split(F.lower(F.regexp_replace(self.base, r"(?<=.)\.[^.]*$", "")), "_")
        self.has_suffix = self.base.rlike(r"\.\w+$")
        self.lead = self.parts[0]
        self.numbered = F.coalesce(F.get(self.parts, F.lit(1)).rlike(r"^obj[0-9]{5}$"), F.lit(False))
        self.sequel = F.array_join(F.slice(self.parts, 3, F.greatest(F.size(self.parts) - 2, F.lit(0))), "_")

    def after(self, parts: int) -> Column:
        """The name as written from behind so many underscores on; null if it has fewer."""
        return F.when(F.size(F.split(self.base, "_")) > parts, F.array_join(F.slice(F.split(self.base, "_"), parts + 1, 10_000), "_"))

    @property
    def is_object(self) -> Column:
        return self.numbered & self.has_suffix & self.sequel.rlike(r"^(rebuilt)?(_?[0-9]+)?$")

    @property
    def is_data_uri(self) -> Column:
        words = F.when(self.lead.rlike("^[0-9]{4}$"), F.slice(self.parts, 2, 4)).otherwise(F.slice(self.parts, 1, 4))
        return F.array_join(words, "_").rlike("^data_uri_[0-9]{4}(_[0-9]+)?$") & self.has_suffix


def _named(what: str, name: Column) -> Column:
    return F.concat(F.lit(what), F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""))


def place_in_document(name: Column, container_ext: Column) -> Column:
    """Where in its document an extracted item was, told by its name; null if it is not such an item."""
    item, ext = _ItemName(name), F.lower(F.coalesce(container_ext, F.lit("")))
    in_pdf = (
        F.when((item.lead == "attachment") & item.numbered, _named(_ATTACHED, item.after(2)))
        .when(item.is_object & (item.lead == "unused"), F.lit(_UNDRAWN))
        .when(item.is_object & item.lead.rlike("^p[0-9]{4}$"), F.concat(F.lit("page "), F.substring(item.lead, 2, 4).try_cast("int").cast("string")))
    )
    in_page = F.when(item.is_data_uri, F.lit(_DATA_URI)).when(ext.isin(*_SAVED_PAGES) & item.lead.rlike("^[0-9]{4}$"), _named(_RESOURCE, item.after(1)))
    return F.when(ext.isin(".pdf", ""), in_pdf).when(ext.isin(*schema.DOCUMENT_EXTS), in_page)


def copy_in_document(name: Column, container_ext: Column) -> Column:
    """Whether the copy of an extracted item has the bytes it had in its document; null if it is not such an item."""
    item = _ItemName(name)
    rebuilt = item.is_object & item.sequel.startswith("rebuilt") & ~item.lead.isin("attachment")
    return F.when(place_in_document(name, container_ext).isNotNull(), F.when(rebuilt & F.lower(F.coalesce(container_ext, F.lit(""))).isin(".pdf", ""), F.lit(_REBUILT)).otherwise(F.lit(_SAME_BYTES)))
