"""Queries of the case engine over the test tables, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..functions.text import hex_digits, hex_to_long
from ..operators import containers, dedupe, gallery, matching, search, stats
from ..operators.gallery import FileQuery
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Files once each; stand-ins for relations the test tables do not have are derived alike in both engines.
_WITH = """WITH f AS (SELECT DISTINCT * FROM files),
r AS (SELECT DISTINCT * FROM vic_records),
e0 AS (SELECT source AS set_name, CASE origin WHEN 'walk' THEN 'case' WHEN 'deleted' THEN 'stash' ELSE 'global' END AS store,
  CASE WHEN category = 0 THEN 'known-good' ELSE 'known' END AS kind, kind = 'image' AS vic, category, lower(trim(md5)) AS m, lower(trim(sha1)) AS s, lower(trim(sha256)) AS t FROM f WHERE category IS NOT NULL AND category <> 5 AND source IS NOT NULL),
entries AS (SELECT set_name, store, kind, vic, category, 'md5' AS algo, m AS value FROM e0 WHERE regexp_full_match(m, '[0-9a-f]{32}') AND m <> 'd41d8cd98f00b204e9800998ecf8427e'
  UNION ALL SELECT set_name, store, kind, vic, category, 'sha1', s FROM e0 WHERE regexp_full_match(s, '[0-9a-f]{40}') AND s <> 'da39a3ee5e6b4b0d3255bfef95601890afd80709'
  UNION ALL SELECT set_name, store, kind, vic, category, 'sha256', t FROM e0 WHERE regexp_full_match(t, '[0-9a-f]{64}') AND t <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'),
fd AS (SELECT id, 'md5' AS algo, lower(trim(md5)) AS value FROM f WHERE regexp_full_match(lower(trim(md5)), '[0-9a-f]{32}')
  UNION ALL SELECT id, 'sha1', lower(trim(sha1)) FROM f WHERE regexp_full_match(lower(trim(sha1)), '[0-9a-f]{40}')
  UNION ALL SELECT id, 'sha256', lower(trim(sha256)) FROM f WHERE regexp_full_match(lower(trim(sha256)), '[0-9a-f]{64}')),
hits0 AS (SELECT fd.id, fd.algo, fd.value, e.set_name, e.store, e.kind, e.vic, e.category, row_number() OVER (PARTITION BY fd.id, e.set_name ORDER BY
  CASE fd.algo WHEN 'sha256' THEN 0 WHEN 'sha1' THEN 1 ELSE 2 END, CASE e.store WHEN 'case' THEN 0 WHEN 'stash' THEN 1 ELSE 2 END, coalesce(e.category, 9999), fd.algo, e.store, e.kind, e.vic, fd.value) AS rn
  FROM fd JOIN entries e ON e.algo = fd.algo AND e.value = fd.value WHERE fd.value NOT IN ('d41d8cd98f00b204e9800998ecf8427e','da39a3ee5e6b4b0d3255bfef95601890afd80709','e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855')),
hits AS (SELECT * EXCLUDE (rn) FROM hits0 WHERE rn = 1),
bits AS (SELECT *, CASE WHEN store = 'stash' THEN 2 WHEN vic THEN 1 WHEN kind = 'known-good' THEN 8 ELSE 4 END AS bit FROM hits),
ph AS (SELECT id, ('0x' || lower(trim(phash)))::UBIGINT AS h, CASE WHEN regexp_full_match(lower(trim(dhash)), '[0-9a-f]{16}') THEN ('0x' || lower(trim(dhash)))::UBIGINT END AS d
  FROM f WHERE regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}')),
pm AS (SELECT * FROM ph WHERE bit_count(h) BETWEEN 12 AND 52)
"""


def files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The files relation, or some of its columns beside the id; exact repeats of a row count once.

    Conditions on the result move below the step that drops repeats and so reach the scan; naming the columns
    keeps that step as narrow as the query. Operators that do not mind repeats take ``raw_files`` instead.
    """
    rows = raw_files(spark, folder)
    return (rows.select("id", *[c for c in columns if c != "id"]) if columns else rows).distinct()


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files relation as stored: exact repeats of a row may occur."""
    return table(spark, folder, "files")


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vic_records").distinct()


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Hash-set entries, a stand-in for lists the tables do not have: the digests of categorized files, a set per source."""
    digests = F.explode(F.array(*[F.struct(F.lit(a).alias("algo"), hex_digits(F.col(a), n).alias("value")) for a, n in (("md5", 32), ("sha1", 40), ("sha256", 64))]))
    rows = files(spark, folder, "source", "origin", "category", "kind", "md5", "sha1", "sha256").where(F.col("category").isNotNull() & (F.col("category") != schema.UNCATEGORIZED) & F.col("source").isNotNull()).select(
        F.col("source").alias("set_name"), F.when(F.col("origin") == "walk", "case").when(F.col("origin") == "deleted", "stash").otherwise("global").alias("store"),
        F.when(F.col("category") == 0, "known-good").otherwise("known").alias("kind"), (F.col("kind") == "image").alias("vic"), "category", digests.alias("x"),
    )
    rows = rows.select("set_name", "store", "kind", "vic", "category", "x.algo", "x.value")
    return rows.where(F.col("value").isNotNull() & ~F.col("value").isin(*schema.EMPTY_HASHES))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match_known(files(spark, folder, *matching.ALGORITHM_RANK), entries(spark, folder))


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = _WITH + sql
        return fn

    return add


def gallery_query(name: str, q: FileQuery, where: str, columns: tuple[str, ...] = ("id", "kind", "source"), alone: bool = False) -> None:
    """Register one gallery request with the WHERE clause it stands for."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return gallery.matching_files(raw_files(spark, folder), q).select(*columns).distinct()

    run.__name__ = name
    QUERIES[name] = run
    base = "" if alone or q.kind else "kind <> 'archive' AND "
    SQL[name] = _WITH + f"SELECT {', '.join(columns)} FROM f WHERE {base}({where})"


# --- gallery predicates -------------------------------------------------------------------------------
gallery_query("f01_stack_members", FileQuery(stack=228, kind="video"), "stack_id = 228", alone=True)
gallery_query("f02_container_members", FileQuery(container=2673), "container_id = 2673 AND kind <> 'archive'", alone=True)
gallery_query("f03_kind", FileQuery(kind="video"), "kind = 'video'")
gallery_query("f03_default_kind", FileQuery(), "true")
gallery_query("f05_source", FileQuery(source="handset_b"), "source = 'handset_b'")
gallery_query("f06_origin", FileQuery(origin="carve"), "origin = 'carve'")
gallery_query("f06_origin_unknown_ignored", FileQuery(origin="nowhere", source="usb_a"), "source = 'usb_a'")
gallery_query("f08_category", FileQuery(category=1), "category = 1")
gallery_query("f12_cluster", FileQuery(cluster=130), "cluster_id = 130")
gallery_query("f20_gps_and_size", FileQuery(has_gps=True, min_size=300_000), "gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND size >= 300000")
gallery_query(
    "f19_has_exact_duplicates", FileQuery(has_duplicates="exact"), "stack_id IN (SELECT stack_id FROM f GROUP BY 1 HAVING count(*) > 1)"
)
gallery_query(
    "f19_has_any_duplicates", FileQuery(has_duplicates="any"),
    "stack_id IN (SELECT stack_id FROM f GROUP BY 1 HAVING count(*) > 1) OR vstack_id IN (SELECT vstack_id FROM f GROUP BY 1 HAVING count(*) > 1) OR cluster_id IN (SELECT cluster_id FROM f GROUP BY 1 HAVING count(*) > 1)",
)
gallery_query(
    "f21_any_date", FileQuery(day_from="2016-01-01", day_to="2017-06-30"),
    """(ctime <> 0 AND ctime >= epoch(TIMESTAMP '2016-01-01') AND ctime < epoch(TIMESTAMP '2017-07-01')) OR (mtime <> 0 AND mtime >= epoch(TIMESTAMP '2016-01-01') AND mtime < epoch(TIMESTAMP '2017-07-01'))
    OR (atime <> 0 AND atime >= epoch(TIMESTAMP '2016-01-01') AND atime < epoch(TIMESTAMP '2017-07-01'))
    OR (created_dt <> '' AND substr(created_dt, 1, 10) BETWEEN '2016-01-01' AND '2017-06-30')""",
)
_PLACES = ("coalesce(nullif(orig_name, ''), CASE WHEN media_id IS NULL THEN rel_path END)", "CASE WHEN media_id IS NULL THEN rel_path END", "alt_paths", "camera", "mime", "source", "created_dt", "md5", "sha1", "sha256", "phash")
_word = lambda w: "(" + " OR ".join(f"coalesce({c} ILIKE '%{w}%', false)" for c in _PLACES) + ")"
gallery_query("f23_search", FileQuery(words="camera dcim"), f"{_word('camera')} AND {_word('dcim')}")
gallery_query("f23_search_wildcard", FileQuery(words="IMG%heic a_b"), f"{_word('IMG%heic')} AND {_word('a_b')}")
gallery_query("f24_contains", FileQuery(columns=[("camera", "contains", "nor")]), "camera ILIKE '%nor%'")
gallery_query("f24_contains_escaped", FileQuery(columns=[("path", "contains", "_1")]), r"path ILIKE '%\_1%' ESCAPE '\'")
gallery_query("f24_eq_text_of_number", FileQuery(columns=[("width", "eq", "640")]), "CAST(width AS VARCHAR) = '640'")
gallery_query("f24_neq_keeps_null", FileQuery(columns=[("camera", "neq", "Tavik M1")]), "camera IS NULL OR camera <> 'Tavik M1'")
gallery_query("f24_range", FileQuery(columns=[("size", "min", "100000"), ("size", "lt", "200000")]), "size >= 100000 AND size < 200000")
gallery_query("f24_set_and_notset", FileQuery(columns=[("phash", "set", ""), ("camera", "notset", "")]), "phash IS NOT NULL AND phash <> '' AND (camera IS NULL OR camera = '')")
gallery_query("f24_unknown_ignored", FileQuery(columns=[("no_such", "eq", "1")], source="nas_a"), "source = 'nas_a'")
gallery_query("f34_language_size", FileQuery(columns=gallery.parse_column_filter("size", "100 - 250kb")), "size >= 102400 AND size <= 256000")
gallery_query("f34_language_duration", FileQuery(kind="video", columns=gallery.parse_column_filter("duration", ">= 0:30")), "kind = 'video' AND duration >= 30")
gallery_query("f34_language_text", FileQuery(columns=gallery.parse_column_filter("camera", "quill")), "camera ILIKE '%quill%'")


@query("SELECT count(*) AS total FROM (SELECT min(id) FROM f WHERE kind <> 'archive' AND size >= 200000 GROUP BY coalesce(vstack_id, stack_id, id))")
def t03_collapsed_count(spark, folder):
    return gallery.count(raw_files(spark, folder), FileQuery(collapse=True, min_size=200_000))


@query("""SELECT f.id, f.size, f.kind, coalesce((SELECT count(*) FROM f g WHERE g.stack_id = f.stack_id), 0) AS stack_size FROM f
WHERE id IN (SELECT min(id) FROM f WHERE kind = 'image' AND size >= 50000 GROUP BY coalesce(vstack_id, stack_id, id)) ORDER BY size DESC, id DESC LIMIT 200""")
def gallery_collapsed(spark, folder):
    """The flagship: filter, one representative per group among the matches, sort, page, group sizes."""
    base = raw_files(spark, folder)
    rows = gallery.page(base, FileQuery(kind="image", min_size=50_000, collapse=True, sort="size", descending=True, limit=200), ["id", "size", "kind", "stack_id"])
    sized = gallery.with_group_sizes(rows, base, ("stack_id",))
    return sized.select("id", "size", "kind", F.when(F.col("stack_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("stack_size")).alias("stack_size"))


@query("SELECT id, rel_path FROM f WHERE kind <> 'archive' ORDER BY rel_path ASC NULLS FIRST, id ASC LIMIT 500")
def t01_default_sort_page(spark, folder):
    return gallery.page(raw_files(spark, folder), FileQuery(), ["id", "rel_path"])


@query("SELECT id, created_dt FROM f WHERE kind <> 'archive' ORDER BY created_dt DESC NULLS LAST, id DESC LIMIT 300 OFFSET 100")
def t02_named_sort_offset(spark, folder):
    return gallery.page(raw_files(spark, folder), FileQuery(sort="created_dt", descending=True, limit=300, offset=100), ["id", "created_dt"])


@query("SELECT id, created_dt FROM f WHERE kind <> 'archive' ORDER BY created_dt ASC NULLS FIRST, id ASC LIMIT 250 OFFSET 1400")
def t02_short_name_sort(spark, folder):
    return gallery.page(raw_files(spark, folder), FileQuery(sort="date", descending=True, limit=250, offset=1400), ["id", "created_dt"])


@query("SELECT id, coalesce(nullif(orig_name, ''), CASE WHEN media_id IS NULL THEN rel_path END) AS name FROM f WHERE kind <> 'archive' ORDER BY name ASC NULLS FIRST, id ASC LIMIT 400")
def t01_virtual_name_sort(spark, folder):
    return gallery.page(raw_files(spark, folder), FileQuery(sort="name", limit=400), ["id", gallery.shown_name().alias("name")])


@query("SELECT id, coalesce(vstack_id, stack_id, id) AS grp, CASE WHEN id = min(id) OVER (PARTITION BY coalesce(vstack_id, stack_id, id)) THEN 1 ELSE 0 END AS grp_head FROM f")
def w02_group_heads(spark, folder):
    return gallery.group_heads(files(spark, folder, "stack_id", "vstack_id"))


@query("SELECT id, container_id FROM f WHERE container_id IN (SELECT id FROM f WHERE lower(ext) IN ('.zip', '.tar', '.gz', '.7z'))")
def f07_from_archives(spark, folder):
    return gallery.container_members(files(spark, folder, "container_id", "ext"), (".zip", ".tar", ".gz", ".7z")).select("id", "container_id")


@query("SELECT id FROM f WHERE category IS NOT NULL AND category <> 5")
def f25_scope_categorized(spark, folder):
    return files(spark, folder, "category").where(gallery.scope("categorized")).select("id")


@query("SELECT id FROM f WHERE category IS NULL OR category = 5")
def f25_scope_uncategorized(spark, folder):
    return files(spark, folder, "category").where(gallery.scope("uncategorized")).select("id")


@query("SELECT id FROM f WHERE size > 100 AND kind = 'image'")
def f25_scope_where(spark, folder):
    return files(spark, folder, "kind", "size").where(gallery.scope("where", where="size > 100 AND kind = 'image'")).select("id")


@query("SELECT id, bit_count(h)::INTEGER AS bits FROM pm")
def f28_meaningful_hash(spark, folder):
    h = hex_to_long(hex_digits(F.col("phash"), 16))
    return files(spark, folder, "phash").select("id", h.alias("h")).where(S.meaningful_hash(F.col("h"))).select("id", F.bit_count("h").alias("bits"))


@query("SELECT id, round(gps_lat, 7) AS lat, round(gps_lon, 7) AS lon FROM f WHERE gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND NOT (gps_lat = 0 AND gps_lon = 0)")
def f29_valid_coordinates(spark, folder):
    c = S.valid_coordinates(F.col("gps_lat"), F.col("gps_lon"))
    return files(spark, folder, "gps_lat", "gps_lon").select("id", c.alias("c")).where(F.col("c").isNotNull()).select("id", "c.lat", "c.lon")


@query("SELECT id FROM f WHERE mtime >= epoch(TIMESTAMP '2019-03-10 05:00:00') AND mtime < epoch(TIMESTAMP '2019-03-13 04:00:00')")
def f35_local_day_bounds(spark, folder):
    lo, hi = gallery.day_bounds("2019-03-10", "2019-03-12", "America/New_York")
    return files(spark, folder, "mtime").where((F.col("mtime") >= lo) & (F.col("mtime") < hi)).select("id")


# --- stacks, clusters, components ---------------------------------------------------------------------
@query("SELECT id, min(id) OVER (PARTITION BY coalesce(nullif(sha256, ''), 'md5:' || nullif(md5, ''))) AS stack_id FROM f WHERE coalesce(nullif(sha256, ''), nullif(md5, '')) IS NOT NULL UNION ALL SELECT id, NULL FROM f WHERE coalesce(nullif(sha256, ''), nullif(md5, '')) IS NULL")
def w01_exact_stacks(spark, folder):
    return dedupe.exact_stacks(files(spark, folder, "md5", "sha256"))


def _stacked(spark, folder):
    base = files(spark, folder, "md5", "sha256", "phash", "dhash")
    return base.join(dedupe.exact_stacks(base), "id")


_GROUPS = """, st AS (SELECT id, min(id) OVER (PARTITION BY coalesce(nullif(sha256, ''), 'md5:' || nullif(md5, ''))) AS stack_id FROM f WHERE coalesce(nullif(sha256, ''), nullif(md5, '')) IS NOT NULL
  UNION ALL SELECT id, NULL FROM f WHERE coalesce(nullif(sha256, ''), nullif(md5, '')) IS NULL),
nodes AS (SELECT pm.* FROM pm JOIN st USING (id) WHERE st.stack_id IS NULL OR st.stack_id = pm.id),
bands AS (SELECT id, h, d, b AS band, (h >> ((56 - 8 * b)::UBIGINT)) & 255::UBIGINT AS key FROM nodes, range(8) t(b)),
keep AS (SELECT band, key FROM bands GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 1500),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN keep USING (band, key) JOIN bands y USING (band, key) WHERE x.id < y.id AND bit_count(xor(x.h, y.h)) <= {bits}
  AND (x.d IS NULL OR y.d IS NULL OR bit_count(xor(x.d, y.d)) <= {bits} + 2)),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
"""


def _recursive(sql: str, bits: int) -> str:
    """The shared views and a recursive walk over the pairs; recursion has to be announced in front."""
    walk = "walk(id, head) AS (SELECT a, a FROM edges UNION SELECT e.b, w.head FROM walk w JOIN edges e ON e.a = w.id), comp AS (SELECT id, min(head) AS head FROM walk GROUP BY id)"
    return _WITH.replace("WITH f", "WITH RECURSIVE f", 1) + _GROUPS.replace("{bits}", str(bits)) + walk + sql


@query()
def x03_perceptual_pairs(spark, folder):
    rows = _stacked(spark, folder).where(F.col("stack_id").isNull() | (F.col("stack_id") == F.col("id")))
    rows = rows.select("id", hex_to_long(hex_digits(F.col("phash"), 16)).alias("h"), hex_to_long(hex_digits(F.col("dhash"), 16)).alias("d"))
    return dedupe.perceptual_pairs(rows.where(S.meaningful_hash(F.col("h"))), schema.CLUSTER_BITS)


SQL["x03_perceptual_pairs"] = _recursive(" SELECT a, b FROM pairs", schema.CLUSTER_BITS)


@query()
def x05_near_clusters(spark, folder):
    return dedupe.near_clusters(_stacked(spark, folder))


SQL["x05_near_clusters"] = _recursive(" SELECT st.id, comp.head AS cluster_id FROM st LEFT JOIN comp ON comp.id = coalesce(st.stack_id, st.id)", schema.CLUSTER_BITS)


@query()
def x06_visual_stacks(spark, folder):
    return dedupe.visual_stacks(_stacked(spark, folder))


SQL["x06_visual_stacks"] = _recursive(" SELECT st.id, comp.head AS vstack_id FROM st LEFT JOIN comp ON comp.id = coalesce(st.stack_id, st.id)", schema.VISUAL_BITS)


# --- known hashes -------------------------------------------------------------------------------------
@query("SELECT id, set_name, algo, store, kind, vic, category, value FROM hits")
def j01_known_hashes(spark, folder):
    return _hits(spark, folder)


@query("""SELECT p.id, arg_min(l.set_name, (bit_count(xor(p.h, l.h)), l.set_name, l.value)) AS set_name, arg_min(l.value, (bit_count(xor(p.h, l.h)), l.set_name, l.value)) AS value, min(bit_count(xor(p.h, l.h)))::INTEGER AS distance
FROM ph p JOIN (SELECT DISTINCT source AS set_name, lower(trim(phash)) AS value, ('0x' || lower(trim(phash)))::UBIGINT AS h FROM f WHERE category IN (1, 2) AND source IS NOT NULL AND regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}')) l
ON bit_count(xor(p.h, l.h)) <= 6 WHERE p.id NOT IN (SELECT id FROM hits) GROUP BY p.id""")
def j02_perceptual_fallback(spark, folder):
    base = files(spark, folder, "category", "phash", "source", "dhash")
    # The listed hashes are a stand-in set: the perceptual hashes of notable files.
    listed = base.where(F.col("category").isin(1, 2) & F.col("source").isNotNull()).select(F.col("source").alias("set_name"), hex_digits(F.col("phash"), 16).alias("value")).where(F.col("value").isNotNull())
    return matching.match_perceptual(base, listed, _hits(spark, folder))


@query("""SELECT id, bit_or(bit)::INTEGER AS hashset_mask, arg_min(category, CASE WHEN category = 0 THEN 100 + category ELSE category END) FILTER (WHERE kind = 'known' AND category IS NOT NULL AND category <> 5) AS asserted,
string_agg(set_name, ',' ORDER BY CASE bit WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END, set_name) AS sets FROM bits GROUP BY id""")
def g14_hit_summary(spark, folder):
    return matching.summarise_hits(_hits(spark, folder))


@query(""", s AS (SELECT id, bit_or(bit)::INTEGER AS mask, arg_min(category, CASE WHEN category = 0 THEN 100 + category ELSE category END) FILTER (WHERE kind = 'known' AND category IS NOT NULL AND category <> 5) AS asserted,
string_agg(set_name, ',' ORDER BY CASE bit WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END, set_name) AS sets FROM bits GROUP BY id)
SELECT f.id, CASE WHEN (f.category IS NULL OR f.category = 5) AND s.asserted IS NOT NULL THEN s.asserted WHEN (f.category IS NULL OR f.category = 5) AND s.mask = 8 THEN 0 ELSE f.category END AS category,
coalesce(s.mask, 0) AS hashset_mask, coalesce(s.sets, '') AS sets FROM f LEFT JOIN s ON s.id = f.id""")
def m08_rematch(spark, folder):
    return matching.rematch(files(spark, folder, "category"), _hits(spark, folder))


@query("SELECT id, set_name, bit FROM bits WHERE bit <> 2")
def m12_stash_turned_off(spark, folder):
    return matching.drop_source(_hits(spark, folder), schema.MASK_STASH).select("id", "set_name", matching.source_bit().alias("bit"))


@query("SELECT DISTINCT id FROM bits WHERE (SELECT bit_or(b.bit) FROM bits b WHERE b.id = bits.id) & 3 = 3")
def f15_both_sources(spark, folder):
    both = schema.MASK_VIC | schema.MASK_STASH
    return matching.summarise_hits(_hits(spark, folder)).where(F.col("hashset_mask").bitwiseAND(F.lit(both)) == both).select("id")


@query("SELECT DISTINCT f.id FROM f JOIN hits ON hits.id = f.id WHERE hits.set_name = 'nas_a'")
def f16_one_set(spark, folder):
    return files(spark, folder, "id").join(_hits(spark, folder).where(F.col("set_name") == "nas_a").select("id"), "id", "left_semi").select("id")


@query("SELECT id FROM f WHERE id NOT IN (SELECT id FROM hits WHERE kind = 'known-good')")
def f17_hide_known_good(spark, folder):
    return files(spark, folder, "id").join(_hits(spark, folder).where(F.col("kind") == "known-good").select("id"), "id", "left_anti").select("id")


@query("SELECT e.set_name, count(DISTINCT (e.algo, e.value)) AS entries, coalesce(any_value(m.matched), 0) AS matched FROM entries e LEFT JOIN (SELECT set_name, count(DISTINCT id) AS matched FROM hits GROUP BY 1) m ON m.set_name = e.set_name GROUP BY e.set_name")
def g07_set_list(spark, folder):
    e = entries(spark, folder)
    return matching.set_summary(e, matching.match_known(files(spark, folder, "md5", "sha1", "sha256"), e))


@query("SELECT lower(trim(md5)) AS md5, min(category) AS category FROM f WHERE category IN (1, 2) AND regexp_full_match(lower(trim(md5)), '[0-9a-f]{32}') AND lower(trim(md5)) <> 'd41d8cd98f00b204e9800998ecf8427e' GROUP BY 1")
def f27_stash_candidates(spark, folder):
    return matching.stash_candidates(files(spark, folder, "category", "md5"))


@query("""SELECT md5, region, min(category) AS category, arg_min(added_at, (n, added_at, source)) AS added_at, arg_min(source, (n, added_at, source)) AS source FROM (
SELECT lower(trim(md5)) AS md5, 'US' AS region, category, media_id AS added_at, source, 0 AS n FROM r WHERE category IS NOT NULL UNION ALL SELECT lower(trim(md5)), 'US', category, id, source, 1 FROM f WHERE category IN (1, 2))
WHERE regexp_full_match(md5, '[0-9a-f]{32}') AND md5 <> 'd41d8cd98f00b204e9800998ecf8427e' AND source IS NOT NULL GROUP BY 1, 2""")
def m07_stash_merge(spark, folder):
    old = records(spark, folder).where(F.col("category").isNotNull() & F.col("source").isNotNull()).select("md5", F.lit("US").alias("region"), "category", F.col("media_id").alias("added_at"), "source")
    new = files(spark, folder, "category", "md5", "source").where(F.col("category").isin(1, 2) & F.col("source").isNotNull()).select("md5", F.lit("US").alias("region"), "category", F.col("id").alias("added_at"), "source")
    return matching.stash_merge(old, new)


@query("SELECT source AS region, category, count(*) AS n, max(media_id) AS latest FROM r WHERE source IS NOT NULL AND category IS NOT NULL GROUP BY ROLLUP (source, category)")
def g08_stash_summary(spark, folder):
    rows = records(spark, folder).where(F.col("source").isNotNull() & F.col("category").isNotNull())
    return stats.stash_summary(rows.select(F.col("source").alias("region"), "category", F.col("media_id").alias("added_at")))


@query("SELECT hashset_id, media_id, seq, name_id, value FROM (SELECT *, row_number() OVER (PARTITION BY hashset_id, media_id, name_id ORDER BY seq NULLS FIRST, value NULLS FIRST) AS rn FROM (SELECT DISTINCT * FROM vic_media_exif)) WHERE rn = 1")
def w04_first_record_wins(spark, folder):
    rows = table(spark, folder, "vic_media_exif")
    return rows.groupBy("hashset_id", "media_id", "name_id").agg(F.min(F.struct("seq", "value")).alias("x")).select("hashset_id", "media_id", "x.seq", "name_id", "x.value")


# --- searches -----------------------------------------------------------------------------------------
@query("""SELECT id, distance::INTEGER AS distance, round(100.0::DOUBLE * (1 - distance / 64.0::DOUBLE), 1) AS similarity FROM (SELECT a.id, bit_count(xor(a.h, p.h)) AS distance FROM pm a, (SELECT * FROM pm WHERE id = (SELECT min(id) FROM pm)) p
WHERE bit_count(xor(a.h, p.h)) <= 24 AND (a.d IS NULL OR p.d IS NULL OR bit_count(xor(a.d, p.d)) <= 26)) ORDER BY id <> (SELECT min(id) FROM pm), distance, id LIMIT 200""")
def x08_find_similar(spark, folder):
    base = files(spark, folder, "dhash", "phash")
    h = hex_to_long(hex_digits(F.col("phash"), 16))
    target = base.where(S.meaningful_hash(h)).agg(F.min("id").alias("m")).head()["m"]
    return search.find_similar(base, target, 24)


@query("""SELECT v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) p
WHERE round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) >= 0.363 ORDER BY v.vec_id <> (SELECT min(vec_id) FROM embeddings), score DESC, id LIMIT 200""")
def x09_face_match(spark, folder):
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return search.face_matches(v, v.agg(F.min("id").alias("m")).head()["m"])


@query("""SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0
AND round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) >= 0.7""")
def x10_content_search(spark, folder):
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return search.nearest_vectors(v.where(F.col("id") % 50 == 0), v, schema.CONTENT_COSINE)


_WORDS = """, w AS (SELECT DISTINCT doc_id AS id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS total FROM documents WHERE text IS NOT NULL), df AS (SELECT word, count(*) AS df FROM w GROUP BY 1)
"""


def _worded(spark, folder):
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.split(F.lower("text"), " ").alias("words"))


@query(_WORDS + "SELECT word, df, round(ln(total::DOUBLE / df), 6) AS idf FROM df, n")
def g18_document_frequencies(spark, folder):
    return search.document_frequencies(_worded(spark, folder))


@query(_WORDS + """, p AS (SELECT word FROM w WHERE id = (SELECT min(doc_id) FROM documents WHERE length(text) > 200)), s AS (SELECT w.id, sum(ln(n.total::DOUBLE / df.df)) AS s FROM w JOIN p USING (word) JOIN df USING (word), n GROUP BY w.id),
z AS (SELECT id, count(*) AS k FROM w GROUP BY id) SELECT s.id, round(s.s / sqrt(z.k), 6) AS score FROM s JOIN z USING (id) ORDER BY score DESC, id LIMIT 150""")
def x11_word_overlap(spark, folder):
    target = table(spark, folder, "documents").where(F.length("text") > 200).agg(F.min("doc_id").alias("m")).head()["m"]
    return search.word_overlap(_worded(spark, folder), target)


@query("SELECT id, min_by(engine, rank) AS engine FROM (SELECT id, 0 AS rank, 'exact' AS engine FROM f WHERE stack_id IS NOT NULL UNION ALL SELECT id, 1, 'visual' FROM f WHERE vstack_id IS NOT NULL UNION ALL SELECT id, 2, 'near' FROM f WHERE cluster_id IS NOT NULL) GROUP BY id")
def x14_merged_search(spark, folder):
    base = files(spark, folder, "cluster_id", "stack_id", "vstack_id")
    return search.merged_search(*[(n, base.where(F.col(c).isNotNull()).select("id")) for n, c in (("exact", "stack_id"), ("visual", "vstack_id"), ("near", "cluster_id"))])


@query("SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM pm a JOIN pm b ON b.id = a.id + 1")
def x07_hamming(spark, folder):
    h = files(spark, folder, "phash").select("id", hex_to_long(hex_digits(F.col("phash"), 16)).alias("h")).where(S.meaningful_hash(F.col("h")))
    other = h.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("h").alias("hb"))
    return h.join(other, "id").select(F.col("id").alias("a"), "b", S.hamming(F.col("h"), F.col("hb")).alias("distance"))


# --- counts -------------------------------------------------------------------------------------------
@query("""SELECT count(*) FILTER (kind <> 'archive') AS total, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'video') AS videos, count(*) FILTER (kind = 'other') AS others,
count(*) FILTER (category IS NOT NULL AND category <> 5) AS categorized, count(*) FILTER (coalesce(vstack_id, stack_id, id) <> id) AS collapsed, count(DISTINCT stack_id) AS stacks, count(DISTINCT vstack_id) AS vstacks,
count(DISTINCT cluster_id) AS clusters, count(*) FILTER (stack_id IS NOT NULL AND stack_id <> id) AS redundant FROM f""")
def g01_case_stats(spark, folder):
    return stats.case_stats(files(spark, folder, "category", "cluster_id", "kind", "stack_id", "vstack_id"))


@query("SELECT coalesce(category, 5) AS category, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM f), 1) AS percent FROM f GROUP BY 1")
def g13_category_share(spark, folder):
    return stats.by_category_share(files(spark, folder, "category"))


@query("SELECT cluster_id, count(*) AS n FROM f WHERE cluster_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 200")
def g02_largest_clusters(spark, folder):
    return stats.largest_clusters(files(spark, folder, "cluster_id"))


@query("""SELECT count(*) FILTER (gps_lat IS NOT NULL AND gps_lon IS NOT NULL) AS with_gps, count(*) FILTER (kind = 'image' AND phash IS NULL) AS unhashed_images, count(*) FILTER (kind = 'video' AND duration IS NULL) AS unread_videos,
count(*) FILTER (kind = 'archive') AS archives, count(*) FILTER (size = 0) AS empty_files, count(DISTINCT source) AS sources FROM f""")
def g02_screening_totals(spark, folder):
    return stats.screening_totals(files(spark, folder, "duration", "gps_lat", "gps_lon", "kind", "phash", "size", "source"))


@query("SELECT source, count(*) AS n, count(*) FILTER (origin = 'walk') AS walk, count(*) FILTER (origin = 'deleted') AS deleted, count(*) FILTER (origin = 'carve') AS carve, count(*) FILTER (origin IS NULL) AS unknown FROM f GROUP BY source")
def g10_origin_counts(spark, folder):
    return stats.origin_counts(files(spark, folder, "origin", "source"))


@query("SELECT count(*) AS archives, count(*) FILTER (k.kids > 0) AS opened, coalesce(sum(k.kids), 0)::BIGINT AS items, coalesce(max(k.kids), 0) AS most FROM f LEFT JOIN (SELECT container_id, count(*) AS kids FROM f WHERE container_id IS NOT NULL GROUP BY 1) k ON k.container_id = f.id WHERE f.kind = 'archive'")
def g03_container_census(spark, folder):
    return containers.container_census(files(spark, folder, "container_id", "kind"))


@query("SELECT container_id, count(*) AS n, count(*) FILTER (kind = 'image') AS n_image, count(*) FILTER (kind = 'video') AS n_video, count(*) FILTER (kind = 'other') AS n_other, count(*) FILTER (kind = 'archive') AS n_archive FROM f WHERE container_id IS NOT NULL GROUP BY 1")
def g06_member_counts(spark, folder):
    return containers.member_counts(files(spark, folder, "container_id", "kind"))


@query("""SELECT coalesce(c.status, 'unread') AS status, coalesce(c.ai, '') AS ai, count(*) AS n FROM f LEFT JOIN (SELECT media_id AS id, min(CASE category WHEN 4 THEN 'c2pa' WHEN 0 THEN 'xmp' ELSE 'none' END) AS status,
min(CASE mime WHEN 'image/png' THEN 'yes' WHEN 'image/jpeg' THEN 'no' END) AS ai FROM r GROUP BY 1) c ON c.id = f.id WHERE f.kind IN ('image', 'video') GROUP BY 1, 2""")
def g04_credentials_census(spark, folder):
    m = F.col("media_id")
    c = records(spark, folder).groupBy(m.alias("id")).agg(F.min(F.when(F.col("category") == 4, "c2pa").when(F.col("category") == 0, "xmp").otherwise("none")).alias("status"), F.min(F.when(F.col("mime") == "image/png", "yes").when(F.col("mime") == "image/jpeg", "no")).alias("ai"))
    return stats.credentials_census(files(spark, folder, "kind"), c)


@query("SELECT user_id AS id, CASE WHEN coalesce(bool_or(value > 150), false) THEN 'yes' WHEN coalesce(bool_or(NOT value > 150), false) THEN 'no' WHEN bool_or(true) THEN 'unknown' END AS ai FROM events GROUP BY 1")
def g17_ai_verdict(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("id"), (F.col("value") > 150).alias("generated"), F.lit(True).alias("stated"))
    return stats.ai_verdict(e)
