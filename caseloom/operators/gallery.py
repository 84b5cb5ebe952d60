"""The interactive file query: filter, collapse, sort, page and count, as one declarative plan."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..functions.text import slashed

#: What the free-text search looks into, besides the name and the path shown.
SEARCHED = ("alt_paths", "cache_info", "camera", "notes", "mime", "source", "created_dt", "reviewed_by", "hashset_hit", "error", "md5", "sha1", "sha256", "phash")
#: Sorts by a short name: column and whether it runs downwards whatever is asked.
NAMED_SORTS = {"date": ("created_dt", False), "skin": ("skin_ratio", True), "faces": ("faces", True), "cluster": ("cluster_id", False)}
MOST_ROWS, DEFAULT_ROWS = 5000, 500


@dataclass
class FileQuery:
    """Parameters of one gallery request. Unset ones filter nothing; all set ones must hold together."""

    stack: int | None = None
    vstack: int | None = None
    container: int | None = None
    kind: str | None = None
    source: str | None = None
    origin: str | None = None
    category: int | None = None
    cluster: int | None = None
    has_gps: bool = False
    min_size: int | None = None
    has_duplicates: str | None = None
    day_from: str | None = None
    day_to: str | None = None
    undated: bool = False
    words: str | None = None
    columns: list[tuple[str, str, str]] = field(default_factory=list)
    collapse: bool = False
    sort: str | None = None
    descending: bool = False
    limit: int = DEFAULT_ROWS
    offset: int = 0


def shown_name() -> Column:
    return S.display_name(F.col("orig_name"), F.col("rel_path"), F.col("media_id"))


def shown_path(known: list[str]) -> Column:
    """The path a file had on its device, else its own; an imported record never falls back to rel_path."""
    rel = F.when(F.col("media_id").isNull(), F.col("rel_path"))
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("orig_path", "path") if c in known]
    return F.coalesce(*parts, rel)


def list_column(name: str, known: list[str]) -> Column | None:
    if name == "name":
        return shown_name()
    if name == "file_path":
        return shown_path(known)
    return F.col(name) if name in schema.LIST_COLUMNS and name in known else None


def column_filter(name: str, op: str, value: str, known: list[str]) -> Column | None:
    """One column filter; None for a column or operation that is not known or a limit that is no number."""
    c = list_column(name, known)
    if c is None:
        return None
    if op in ("min", "max", "gt", "lt"):
        try:
            limit = float(value)
        except ValueError:
            return None
        n = S.leading_number(c.cast("string"))
        return {"min": n >= limit, "max": n <= limit, "gt": n > limit, "lt": n < limit}[op]
    text = c.cast("string")
    return {
        "contains": lambda: S.contains_ci(c, value),
        "eq": lambda: text == value,
        "neq": lambda: c.isNull() | (text != value),
        "set": lambda: c.isNotNull() & (text != ""),
        "notset": lambda: c.isNull() | (text == ""),
    }.get(op, lambda: None)()


def search_words(text: str, known: list[str]) -> Column:
    """Every word must be found in one of the searched columns; wildcards in a word stay wildcards."""
    rel = F.when(F.col("media_id").isNull(), F.col("rel_path"))
    device = F.coalesce(F.nullif(F.col("orig_path"), F.lit("")), rel) if "orig_path" in known else rel
    places = [shown_name(), device, *[F.col(c) for c in SEARCHED if c in known]]
    hit = lambda w: reduce(Column.__or__, [F.coalesce(c.ilike(f"%{w}%"), F.lit(False)) for c in places])
    return reduce(Column.__and__, [hit(w) for w in text.split()], F.lit(True))


def any_date(day_from: str | None, day_to: str | None, undated: bool, known: list[str]) -> Column:
    """A file time within the days (the last one included), or a capture day, or any recorded reading's day."""
    lo, hi = day_from or "0001-01-01", day_to or "9999-12-30"
    start, end = (F.unix_timestamp(F.to_timestamp(F.lit(d))) for d in (lo, hi))
    stamps = [F.coalesce((F.col(c) != 0) & (F.col(c) >= start) & (F.col(c) < end + 86_400), F.lit(False)) for c in ("ctime", "mtime", "atime")]
    texts = [F.coalesce((F.col("created_dt") != "") & F.substring("created_dt", 1, 10).between(lo, hi), F.lit(False))]
    none = [F.coalesce(F.col(c), F.lit(0.0)) == 0 for c in ("ctime", "mtime", "atime")] + [F.coalesce("created_dt", F.lit("")) == ""]
    if "recorded_times" in known:
        readings = F.map_values(F.from_json("recorded_times", "map<string,string>"))
        texts.append(F.coalesce(F.exists(readings, lambda v: (v != "") & F.substring(v, 1, 10).between(lo, hi)), F.lit(False)))
        none.append(~F.coalesce(F.exists(readings, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(False)))
    dated = reduce(Column.__or__, stamps + texts)
    return dated | reduce(Column.__and__, none) if undated else dated


def predicate(q: FileQuery, known: list[str]) -> Column:
    """All row-wise conditions of a request. Asking for a group or a container's content ignores the others."""
    if q.stack is not None or q.vstack is not None:
        return F.col("stack_id") == q.stack if q.stack is not None else F.col("vstack_id") == q.vstack
    if q.container is not None:
        return (F.col("container_id") == q.container) & (F.col("kind") != "archive")
    out = [F.col("kind") == q.kind if q.kind else F.col("kind") != "archive"]
    for name, value in (("source", q.source), ("category", q.category), ("cluster_id", q.cluster)):
        if value is not None:
            out.append(F.col(name) == value)
    if q.origin in schema.ORIGINS:
        out.append(F.col("origin") == q.origin)
    if q.has_gps:
        out.append(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull())
    if q.min_size is not None:
        out.append(F.col("size") >= q.min_size)
    if q.day_from or q.day_to:
        out.append(any_date(q.day_from, q.day_to, q.undated, known))
    if q.words and q.words.split():
        out.append(search_words(q.words, known))
    for c in (column_filter(*f, known) for f in q.columns):
        if c is not None:
            out.append(c)
    return reduce(Column.__and__, out)


def with_duplicates(files: DataFrame, matching: DataFrame, how: str) -> DataFrame:
    """Rows of ``matching`` whose exact, visual or near group has other members among all ``files``."""
    keys = {"exact": ["stack_id"], "visual": ["vstack_id"], "cluster": ["cluster_id"], "any": ["stack_id", "vstack_id", "cluster_id"]}[how]
    parts = []
    for key in keys:
        # Two different ids make a group of several; minima combine before the shuffle and repeats do not matter.
        grouped = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select(key)
        parts.append(matching.select("id", key).join(grouped, key, "left_semi").select("id"))
    return matching.join(reduce(DataFrame.unionByName, parts).distinct(), "id", "left_semi")


def collapsed(matching: DataFrame) -> DataFrame:
    """One representative, the smallest id, of each group among the rows that match.

    The aggregate carries ids only and combines before its shuffle; full rows are joined back afterwards.
    """
    heads = matching.groupBy(S.group_key().alias("_grp")).agg(F.min("id").alias("id")).select("id")
    return matching.join(heads, "id", "left_semi")


def matching_files(files: DataFrame, q: FileQuery) -> DataFrame:
    """Rows a request selects, collapsed if asked for, before sorting and paging.

    Exact repeats of a row come out as repeats; whoever picks columns makes them distinct, so that filters and
    columns reach the scan before anything is shuffled.
    """
    rows = files.where(predicate(q, files.columns))
    alone = q.stack is not None or q.vstack is not None or q.container is not None
    if q.has_duplicates and not alone:
        rows = with_duplicates(files, rows, q.has_duplicates)
    return collapsed(rows) if q.collapse and not alone else rows


def sort_key(q: FileQuery, known: list[str]) -> tuple[Column, bool, bool]:
    """(key, whether it runs down, whether ties of id do); nulls come first upwards, last downwards.

    A column of the list view sorts by itself in the asked direction. Otherwise the short names apply, and
    anything else sorts by rel_path, both upwards unless fixed.
    """
    key = list_column(q.sort or "", known)
    if key is not None:
        return key, q.descending, q.descending
    name, down = NAMED_SORTS.get(q.sort or "", ("rel_path", False))
    if name not in known:
        name, down = "rel_path", False
    return F.col(name), down, False


def page(files: DataFrame, q: FileQuery, columns: list[str | Column]) -> DataFrame:
    """The page of a request, at most 5000 rows of ``columns``: a distributed top-k over the sort key and id only.

    Repeats count once. Of collapsed requests one aggregate finds the representatives with their sort keys; the
    rows of the page, whose number is bounded by MOST_ROWS, are looked up by id.
    """
    key, down, id_down = sort_key(q, files.columns)
    order = [F.col("_key").desc() if down else F.col("_key").asc(), F.col("id").desc() if id_down else F.col("id").asc()]
    most = min(max(q.limit, 1), MOST_ROWS)
    if q.collapse and q.stack is None and q.vstack is None and q.container is None:
        rows = matching_files(files, replace(q, collapse=False)).select(S.group_key().alias("_grp"), "id", key.alias("_key"))
        narrow = rows.groupBy("_grp").agg(F.min(F.struct("id", "_key")).alias("_x")).select("_x.id", "_x._key")
    else:
        narrow = matching_files(files, q).select("id", key.alias("_key")).distinct()
    top = narrow.orderBy(*order)
    top = (top.offset(q.offset) if q.offset else top).limit(most)
    found = files.join(F.broadcast(top), "id").select("_key", F.col("id").alias("_id"), *columns).distinct()
    order = [F.col("_key").desc() if down else F.col("_key").asc(), F.col("_id").desc() if id_down else F.col("_id").asc()]
    return found.orderBy(*order).limit(most).drop("_key", "_id")


def count(files: DataFrame, q: FileQuery) -> DataFrame:
    """How many files a request selects; a collapsed one has as many as it has groups."""
    if q.collapse:
        return matching_files(files, replace(q, collapse=False)).agg(F.countDistinct(S.group_key()).alias("total"))
    return matching_files(files, q).agg(F.countDistinct("id").alias("total"))


def with_group_sizes(rows: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("stack_id", "vstack_id")) -> DataFrame:
    """Add stack_size and vstack_size, counted over all files but only for the groups on the page (at most MOST_ROWS)."""
    for key in keys:
        name = key.removesuffix("_id") + "_size"
        wanted = rows.select(key).where(F.col(key).isNotNull()).distinct()
        sizes = files.select("id", key).join(F.broadcast(wanted), key, "left_semi").groupBy(key).agg(F.countDistinct("id").alias(name))
        rows = rows.join(F.broadcast(sizes), key, "left").withColumn(name, F.coalesce(name, F.lit(1)))
    return rows


def group_heads(files: DataFrame) -> DataFrame:
    """Whether each file represents its group: recomputed as one aggregate instead of stored."""
    heads = files.groupBy(S.group_key().alias("_grp")).agg(F.min("id").alias("id")).select("id", F.lit(1).alias("_head"))
    return files.join(heads, "id", "left").select(files["id"], S.group_key().alias("grp"), F.coalesce("_head", F.lit(0)).alias("grp_head"))


# --- the column-filter language of the list view -------------------------------------------------------

#: Numeric columns; what a bare number means to some of them; words for any value and for none.
_NUMERIC = ("size", "duration", "width", "height", "faces", "skin_ratio", "gps_lat", "gps_lon", "category", "id")
_AT_LEAST = ("size", "duration", "skin_ratio")
_SUBSTRING = ("gps_lat", "gps_lon")
_ANY, _NONE = ("set", "any", "*"), ("none", "empty", "null")
_COMPARED = {">=": "min", "<=": "max", ">": "gt", "<": "lt", "=": "eq"}

#: One pattern per kind of token; a column's own quantities come first.
_PLAIN = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?"
_TOKENS = {"compare": r">=|<=|>|<|=", "to": r"\.\.|—|–|to\b|-", "space": r"\s+"}
_QUANTITY = {
    "size": (r"(?P<n>-?[0-9]+(?:\.[0-9]+)?)\s*(?P<unit>[kmg]b?|b)?(?!\w)", lambda m: float(math.floor(float(m["n"]) * 1024 ** "bkmg".index((m["unit"] or "k")[0]) + 0.5))),
    "duration": (rf"(?P<min>[0-9]+):(?P<s>[0-5]?[0-9](?:\.[0-9]+)?)|(?P<n>{_PLAIN})\w*", lambda m: float(m["n"]) if m["n"] else int(m["min"]) * 60 + float(m["s"])),
    "skin_ratio": (rf"(?P<n>{_PLAIN})\s*%?", lambda m: float(m["n"]) * 0.01),
}
_OTHER = (rf"(?P<n>{_PLAIN})\w*", lambda m: float(m["n"]))


def _tokens(column: str, text: str) -> list[tuple[str, str | float]] | None:
    """Text as (kind, value) tokens, or None where something is none. A sign belongs to a number only where one may begin."""
    pattern, value = _QUANTITY.get(column, _OTHER)
    out: list[tuple[str, str | float]] = []
    at = 0
    while at < len(text):
        number = re.compile(pattern).match(text, at) if not out or out[-1][0] != "number" else None
        kind, m = ("number", number) if number else next(((k, m) for k, p in _TOKENS.items() if (m := re.compile(p).match(text, at))), (None, None))
        if m is None:
            return None
        if kind != "space":
            out.append((kind, value(m) if kind == "number" else m[0]))
        at = m.end()
    return out


def _typed(n: float) -> str:
    return str(int(n)) if n == int(n) else repr(n)


def parse_column_filter(column: str, text: str, choice: bool = False) -> list[tuple[str, str, str]]:
    """Clauses (column, operation, value) of what was typed above a column; ``choice`` for a fixed list.

    filter := word for any value | word for none | number `to` number | comparison number | number | text
    """
    t = text.strip().lower()
    if not t:
        return []
    if choice:
        return [(column, "eq", text.strip())]
    if t in _ANY + _NONE:
        return [(column, "set" if t in _ANY else "notset", "")]
    as_text = [(column, "contains", text.strip())]
    if column not in _NUMERIC:
        return as_text
    match _tokens(column, t):
        case [("number", a), ("to", _), ("number", b)]:
            return [(column, "min", _typed(min(a, b))), (column, "max", _typed(max(a, b)))]
        case [("compare", sign), ("number", n)]:
            return [(column, _COMPARED[sign], _typed(n))]
        case [("number", n)] if column not in _SUBSTRING:
            return [(column, "min" if column in _AT_LEAST else "eq", _typed(n))]
    return as_text if column in _SUBSTRING else []


# --- containers and counts ----------------------------------------------------------------------------

def container_members(files: DataFrame, ext_in: tuple[str, ...] | None = None) -> DataFrame:
    """Files that came out of a container whose extension is one of ``ext_in`` (any container if None)."""
    boxes = files.where(F.lower("ext").isin(*ext_in)) if ext_in else files
    return files.join(boxes.select(F.col("id").alias("container_id")), "container_id", "left_semi")


def container_subkinds(boxes: DataFrame, files: DataFrame, item_names: str = r"^(?i)(p.{4}_obj|unused_obj|attachment_obj)") -> DataFrame:
    """Containers (id, ext) with their ``subkind``: a document by its extension or, without one, by the names of its items."""
    named = files.where(F.col("orig_name").rlike(item_names) & F.col("container_id").isNotNull()).select(F.col("container_id").alias("id")).distinct().withColumn("_doc", F.lit(True))
    by_name = (F.coalesce("ext", F.lit("")) == "") & F.coalesce("_doc", F.lit(False))
    return boxes.join(named, "id", "left").withColumn("subkind", F.when(F.lower("ext").isin(*schema.DOCUMENT_EXTS) | by_name, "document").otherwise("archive")).drop("_doc")


def scope(name: str, codes: list[int] | None = None, where: str | None = None) -> Column:
    """Files a report covers, as a condition on their row; scopes that need other tables are in ``scoped``."""
    if name == "all":
        return F.lit(True)
    if name == "categorized":
        return F.col("category").isNotNull() & (F.col("category") != schema.UNCATEGORIZED)
    if name == "uncategorized":
        return F.col("category").isNull() | (F.col("category") == schema.UNCATEGORIZED)
    if name == "categories":
        return F.coalesce("category", F.lit(schema.UNCATEGORIZED)).isin(*(codes or [-1]))
    if name == "where":
        return F.expr(where or "true")
    raise ValueError(f"no such scope: {name}")


def scoped(files: DataFrame, name: str, chosen: DataFrame | None = None, flags: DataFrame | None = None, codes: list[int] | None = None, where: str | None = None) -> DataFrame:
    """Files a report covers: a row-wise scope, the ``selected`` ones (ids of ``chosen``) or those with any of some ``flags``.

    ``chosen`` has id; ``flags`` has file_id, one row for each flag asked for that a file bears. An unknown
    scope, and one whose table is missing, is an error: a report must not widen to everything.
    """
    if name == "selected" and chosen is not None:
        return files.join(chosen.select("id").distinct(), "id", "left_semi")
    if name == "flags" and flags is not None:
        return files.join(flags.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
    return files.where(scope(name, codes, where))


def day_bounds(day_from: str, day_to: str, zone: str) -> tuple[Column, Column]:
    """Epoch seconds at which a span of local days starts and, exclusively, ends."""
    at = lambda day: F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(day), zone))
    return at(F.lit(day_from)), at(F.date_add(F.lit(day_to).cast("date"), 1).cast("string"))


def nth_sample(files: DataFrame, most: int = 50) -> DataFrame:
    """About ``most`` rows spread evenly over the files in path order, each keeping its place.

    Places come from per-partition counts after a range partitioning, not from one global window.
    """
    ranked = files.repartitionByRange("path", "id").sortWithinPartitions("path", "id").withColumn("_part", F.spark_partition_id())
    from ..session import cut

    ranked = cut(ranked.select("id", "path", "_part"))
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    placed = ranked.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("path", "id")) - 1)
    placed = placed.join(before, "_part").withColumn("place", F.col("_at") + F.coalesce("_before", F.lit(0)))
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / most))
    return placed.where(F.col("place") % step == 0).select("id", "path", "place")


def path_key() -> Column:
    return F.lower(slashed(F.col("path")))
