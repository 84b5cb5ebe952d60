"""Queries for reports, containers, sources and scalar functions, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import containers, gallery, reports
from ..sources import hashlists, readers
from ..session import table
from .case_queries import QUERIES, SQL, _WITH, files, query, records

_LABEL = "CASE coalesce(category, 5) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in reports.CATEGORY_LABELS.items()) + " ELSE 'Category ' || coalesce(category, 5) END"


@query(f"""SELECT id, kind, source, rel_path, CASE WHEN coalesce(size, 0) = 0 THEN '' WHEN size > 1e6 THEN printf('%.1f', size / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.0f', size / 1024.0::DOUBLE) || ' KB' END AS size_text,
CASE WHEN coalesce(duration, 0) = 0 THEN '' ELSE (floor(duration)::BIGINT // 60) || ':' || lpad((floor(duration)::BIGINT % 60)::VARCHAR, 2, '0') END AS duration_text,
CASE WHEN mtime IS NULL OR mtime = 0 THEN '' ELSE strftime(make_timestamp((floor(mtime) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') END AS modified, {_LABEL} AS category_label, md5, coalesce(origin, '') AS origin FROM f WHERE kind IN ('image', 'video') AND size > 1000""")
def k01_report_rows(spark, folder):
    return reports.report_rows(files(spark, folder, "category", "duration", "kind", "md5", "mtime", "origin", "rel_path", "size", "source"), "size > 1000")


@query("SELECT DISTINCT md5 FROM f WHERE kind <> 'archive' AND md5 IS NOT NULL AND md5 <> ''")
def k04_md5_list(spark, folder):
    return reports.md5_list(files(spark, folder, "kind", "md5"))


@query("SELECT id, rel_path, round(gps_lat, 7) AS lat, round(gps_lon, 7) AS lon FROM f WHERE gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND NOT (gps_lat = 0 AND gps_lon = 0)")
def k05_location_points(spark, folder):
    return reports.location_points(files(spark, folder, "gps_lat", "gps_lon", "rel_path"))


@query("SELECT r.media_id, r.md5, CASE WHEN c <> 5 THEN c END AS category FROM (SELECT r.media_id, r.md5, CASE WHEN a.media_id IS NOT NULL THEN a.category ELSE b.category END AS c FROM r LEFT JOIN (SELECT media_id, arg_min_null(category, id) AS category FROM f WHERE media_id IS NOT NULL GROUP BY 1) a ON a.media_id = r.media_id LEFT JOIN (SELECT md5, arg_min_null(category, id) AS category FROM f WHERE md5 IS NOT NULL GROUP BY 1) b ON b.md5 = r.md5) r")
def k06_round_trip(spark, folder):
    return reports.round_trip(records(spark, folder).select("media_id", "md5"), files(spark, folder, "category", "md5", "media_id"))


@query(f"SELECT coalesce(category, 5) AS code, {_LABEL} AS label, kind, count(*) AS n, CASE WHEN coalesce(category, 5) = 5 THEN 1 ELSE 0 END AS last FROM f WHERE kind IN ('image', 'video') GROUP BY ALL")
def k07_category_sections(spark, folder):
    return reports.category_summary(files(spark, folder, "category", "kind"))


@query("SELECT stack_id, count(*) AS copies, max(size) AS bytes_each, sum(size)::BIGINT AS bytes_total, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources FROM f WHERE stack_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def k16_duplicate_stacks(spark, folder):
    return reports.duplicate_stacks(files(spark, folder, "size", "source", "stack_id"))


@query("SELECT stack_id, id, path FROM f WHERE stack_id IN (SELECT stack_id FROM f GROUP BY 1 HAVING count(*) > 1)")
def k16_duplicate_members(spark, folder):
    return reports.duplicate_members(files(spark, folder, "path", "stack_id"))


@query("SELECT vstack_id, count(*) AS files, count(DISTINCT md5) AS contents FROM f WHERE vstack_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def k17_visual_groups(spark, folder):
    return reports.visual_groups(files(spark, folder, "md5", "vstack_id"))


@query("SELECT cluster_id, count(*) AS files, count(DISTINCT vstack_id) AS visual_groups FROM f WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def k18_clusters(spark, folder):
    return reports.cluster_rows(files(spark, folder, "cluster_id", "vstack_id"))


@query("SELECT event_id AS id, ts, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def k21_audit_log(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("action"))
    return reports.audit_log(e)


@query("SELECT CASE WHEN gps_lat IS NULL OR gps_lon IS NULL THEN 'no position' WHEN gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND NOT (gps_lat = 0 AND gps_lon = 0) THEN 'mapped' ELSE 'unusable position' END AS reason, count(*) AS n FROM f WHERE kind IN ('image', 'video') GROUP BY 1")
def k22_location_tally(spark, folder):
    return reports.location_tally(files(spark, folder, "gps_lat", "gps_lon", "kind"))


# --- containers ---------------------------------------------------------------------------------------
@query("""SELECT root, id, min(depth)::INTEGER AS depth FROM walk GROUP BY root, id, depth""")
def x16_descendants(spark, folder):
    return containers.descendants(files(spark, folder, "container_id"))


SQL["x16_descendants"] = _WITH.replace("WITH f", "WITH RECURSIVE f", 1) + """, top AS (SELECT id FROM f WHERE container_id IS NULL AND id IN (SELECT container_id FROM f)),
walk(root, id, depth) AS (SELECT t.id, f.id, 1 FROM top t JOIN f ON f.container_id = t.id UNION SELECT w.root, f.id, w.depth + 1 FROM walk w JOIN f ON f.container_id = w.id) SELECT root, id, depth FROM walk"""


@query("SELECT id FROM f WHERE kind = 'archive' AND (size & 3) <> 3 AND id NOT IN (SELECT container_id FROM f WHERE container_id IS NOT NULL)")
def s17_unsettled_containers(spark, folder):
    return containers.unsettled_containers(files(spark, folder, "container_id", "kind", "size").withColumn("expanded", F.col("size").bitwiseAND(F.lit(3)).cast("int")))


def _extents(spark, folder):
    """A stand-in for byte extents: events of a user as runs in a volume."""
    return table(spark, folder, "events").select((F.col("user_id") % 40).alias("volume"), (F.col("event_id") * 37 % 9973).alias("start"), (F.col("event_id") % 12).alias("len"))


_EXT = """, x AS (SELECT user_id % 40 AS volume, event_id * 37 % 9973 AS s, event_id * 37 % 9973 + event_id % 12 AS e FROM events WHERE event_id % 12 > 0),
m AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY volume ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS n FROM x),
g AS (SELECT *, sum(n) OVER (PARTITION BY volume ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m), u AS (SELECT volume, min(s) AS s, max(e) AS e FROM g GROUP BY volume, g)"""


@query(_EXT + ' SELECT volume, s AS start, e AS "end" FROM u')
def s14_merged_extents(spark, folder):
    return containers.merged_extents(_extents(spark, folder))


@query(_EXT + """, l AS (SELECT volume, coalesce(lag(e) OVER (PARTITION BY volume ORDER BY s), 0) AS b, s FROM u) SELECT volume, b AS start, s AS "end" FROM l WHERE s - b >= 1""")
def s14_free_extents(spark, folder):
    return containers.free_extents(_extents(spark, folder))


@query(""", p AS (SELECT l_orderkey AS item, (l_linenumber - 1) * 10 AS pos, max(CASE WHEN l_quantity > 40 THEN 9 ELSE 10 END) AS size FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
b AS (SELECT *, sum(CASE WHEN before = pos THEN 0 ELSE 1 END) OVER (PARTITION BY item ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bad FROM c) SELECT item, count(*) AS pieces, sum(size)::BIGINT AS bytes FROM b WHERE bad = 0 GROUP BY item""")
def w08_contiguous_run(spark, folder):
    p = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("item"), ((F.col("l_linenumber") - 1) * 10).cast("long").alias("position"), F.when(F.col("l_quantity") > 40, 9).otherwise(10).cast("long").alias("size"))
    return containers.contiguous_run(p)


@query('SELECT source AS "case", path AS name FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ingested_at DESC NULLS LAST, path DESC) AS rn FROM f WHERE origin IS NOT NULL) WHERE rn > 20')
def w05_prune_snapshots(spark, folder):
    s = files(spark, folder, "ingested_at", "origin", "path", "source").select(F.col("source").alias("case"), F.col("path").alias("name"), F.col("ingested_at").alias("taken_at"), F.col("origin").isNotNull().alias("automatic"))
    return containers.prune_snapshots(s)


@query("SELECT source AS cache, path AS name FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY atime DESC NULLS LAST, path DESC ROWS UNBOUNDED PRECEDING) AS s FROM f) WHERE s > 5000000")
def w06_cache_eviction(spark, folder):
    e = files(spark, folder, "atime", "path", "size", "source").select(F.col("source").alias("cache"), F.col("path").alias("name"), F.col("atime").alias("used_at"), "size")
    return containers.evict_over_budget(e, 5_000_000)


@query("SELECT file_id, ts FROM (SELECT l_orderkey AS file_id, l_linenumber AS ts, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE i = n // 2")
def w07_middle_frame(spark, folder):
    fr = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("ts")).distinct()
    return containers.middle_frames(fr)


@query("SELECT id, path, place FROM (SELECT id, path, row_number() OVER (ORDER BY path, id) - 1 AS place, count(*) OVER () AS n FROM f) WHERE place % greatest(1, n // 50) = 0")
def w09_every_kth(spark, folder):
    return gallery.nth_sample(files(spark, folder, "path"))


def _views(spark, folder):
    """Member names as seen through two storage views of some sources."""
    base = files(spark, folder, "source", "rel_path", "size", "kind", "origin").where(~F.col("rel_path").rlike("data|storage|sdcard|mnt")).select("source", "rel_path", "size", "kind", "origin")
    one = base.where(F.col("kind") == "image").select("source", F.concat(F.lit("data/media/0/"), "rel_path").alias("name"), "size", F.lit(None).cast("long").alias("crc"))
    two = base.where(F.col("source") > "m").select("source", F.concat(F.lit("storage/emulated/0/"), "rel_path").alias("name"), (F.col("size") + F.when(F.col("origin") == "carve", 1).otherwise(0)).alias("size"), F.lit(None).cast("long").alias("crc"))
    return one.unionByName(two)


@query(""", v AS (SELECT DISTINCT source, 'data/media/0/' || rel_path AS name, rel_path AS rest, 5 AS rank, size FROM f WHERE kind = 'image' AND NOT regexp_matches(rel_path, 'data|storage|sdcard|mnt') UNION SELECT DISTINCT source, 'storage/emulated/0/' || rel_path, rel_path, 6, size + CASE WHEN origin = 'carve' THEN 1 ELSE 0 END FROM f WHERE source > 'm' AND NOT regexp_matches(rel_path, 'data|storage|sdcard|mnt')),
g AS (SELECT source, rest, count(DISTINCT name) AS n, count(DISTINCT size) AS z, list_sort(list(DISTINCT {'rank': rank, 'name': name})) AS l FROM v GROUP BY 1, 2)
SELECT source, l[1].name AS name, (list_transform(l[2:], lambda x: x.name))::VARCHAR[] AS alt_paths FROM g WHERE n >= 2 AND z = 1 UNION ALL SELECT source, u.name, []::VARCHAR[] FROM (SELECT source, unnest(l) AS u FROM g WHERE NOT (n >= 2 AND z = 1))""")
def j09_storage_views(spark, folder):
    return containers.collapse_views(_views(spark, folder))


@query("SELECT DISTINCT f.rel_path, CASE WHEN n.rel_path IS NULL THEN 'missing' ELSE 'size' END AS problem FROM f LEFT JOIN (SELECT rel_path, max(size) AS size FROM f WHERE origin IS DISTINCT FROM 'carve' GROUP BY 1) n ON n.rel_path = f.rel_path WHERE n.rel_path IS NULL OR n.size <> f.size")
def j11_relink_problems(spark, folder):
    base = files(spark, folder, "origin", "rel_path", "size")
    listing = base.where(~F.col("origin").eqNullSafe("carve")).groupBy("rel_path").agg(F.max("size").alias("size"))
    return containers.relink_problems(base, listing)


@query("SELECT container_id AS archive, min(string_split(rel_path, '/')[1]) AS wrapper FROM f WHERE container_id IS NOT NULL AND rel_path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT string_split(rel_path, '/')[1]) = 1 AND bool_and(contains(rel_path, '/')) AND min(string_split(rel_path, '/')[1]) NOT IN ('data', 'private', 'Users', 'storage')")
def s10_wrapper_folder(spark, folder):
    rows = files(spark, folder, "container_id", "rel_path").where("container_id IS NOT NULL AND rel_path IS NOT NULL")
    return containers.wrapper_folder(rows.select(F.col("container_id").alias("archive"), F.col("rel_path").alias("name")))


# --- sources ------------------------------------------------------------------------------------------
@query("SELECT id, CASE WHEN lower(ext) IN ('.jpg','.heic','.webp','.gif','.png') THEN 'image' WHEN lower(ext) IN ('.mp4','.mov','.avi') THEN 'video' WHEN lower(ext) IN ('.zip','.tar','.7z') THEN 'archive' ELSE 'other' END AS by_ext FROM f")
def s02_kind_by_extension(spark, folder):
    return files(spark, folder, "ext").select("id", S.kind_by_extension(F.col("ext")).alias("by_ext"))


#: A head of each kind of content: what the extension of a file stands for here, in hexadecimal, and its kind.
_HEADS = {
    ".jpg": ("FFD8FFE000104A46", "image"), ".png": ("89504E470D0A1A0A0000000D", "image"), ".heic": ("0000001866747970686569630000", "image"), ".txt": ("00000020667479704D344120", "other"),
    ".mp4": ("000000206674797069736F6D", "video"), ".zip": ("504B030414000000", "archive"), ".webp": ("52494646AAAAAAAA57454250", "image"), ".avi": ("52494646AAAAAAAA41564920", "video"), ".db": ("00051607", "other"),
}


@query("SELECT id, CASE lower(ext) " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, (_, k) in _HEADS.items()) + " ELSE 'other' END AS kind FROM f")
def s03_kind_by_magic(spark, folder):
    """The kind told by a head that stands in for each file's content."""
    heads = F.create_map(*[F.lit(x) for e, (h, _) in _HEADS.items() for x in (e, h)])
    return files(spark, folder, "ext").select("id", S.kind_by_magic(F.unhex(F.coalesce(F.try_element_at(heads, F.lower("ext")), F.lit("")))).alias("kind"))


@query("SELECT id AS line, CASE WHEN trim(v) = '' AND category IS NULL THEN 'blank' WHEN NOT regexp_full_match(h, '[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}') THEN 'skipped' WHEN h = 'd41d8cd98f00b204e9800998ecf8427e' THEN 'empty' ELSE 'read' END AS status FROM (SELECT id, category, md5 AS v, lower(trim(md5)) AS h FROM f WHERE md5 IS NOT NULL)")
def s23_hash_list_lines(spark, folder):
    lines = files(spark, folder, "category", "md5").where(F.col("md5").isNotNull()).select(F.col("id").alias("line"), F.concat_ws(",", "md5", F.col("category").cast("string")).alias("value"))
    return hashlists.parse_lines(lines).select("line", "status")


@query("""SELECT count(*) FILTER (s = 'read') AS read, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'empty') AS empty FROM (SELECT CASE WHEN trim(md5) = '' THEN 'blank' WHEN NOT regexp_full_match(lower(trim(md5)), '[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}') THEN 'skipped'
WHEN lower(trim(md5)) = 'd41d8cd98f00b204e9800998ecf8427e' THEN 'empty' ELSE 'read' END AS s FROM f WHERE md5 IS NOT NULL)""")
def g11_list_counts(spark, folder):
    lines = files(spark, folder, "md5").where(F.col("md5").isNotNull()).select(F.col("id").alias("line"), F.col("md5").alias("value"))
    return hashlists.list_counts(hashlists.parse_lines(lines))


@query("""SELECT id AS rec, CASE length(m) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END AS algo, m AS value, CASE WHEN id % 3 = 1 THEN NULL ELSE category END AS category FROM (SELECT id, category, lower(trim(md5)) AS m FROM f WHERE md5 IS NOT NULL) WHERE regexp_full_match(m, '[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}') AND m <> 'd41d8cd98f00b204e9800998ecf8427e'""")
def s24_json_records(spark, folder):
    """Files written as records of a hash list, under three spellings of the members, and read back."""
    rows = files(spark, folder, "md5", "category").where(F.col("md5").isNotNull())
    record = lambda md5, category, extra=(): F.to_json(F.struct(F.col("md5").alias(md5), F.col("category").alias(category), *extra), {"ignoreNullFields": "false"})
    body = F.when(F.col("id") % 3 == 0, record("MD5", "Category")).when(F.col("id") % 3 == 1, record("md5", "VicsCategory", [F.lit("x").alias("MediaCategory")])).otherwise(record("Md5", "category"))
    return hashlists.record_entries(rows.select(F.col("id").alias("rec"), body.alias("body")))


@query("""SELECT rel_path AS path, arg_min_null(md5, media_id) AS md5, arg_min_null(media_size, media_id) AS size, arg_min(category, media_id) FILTER (category IS NOT NULL AND category <> 5) AS category, count(*) AS records
FROM (SELECT DISTINCT ON (media_id) * FROM r ORDER BY media_id, rel_path, md5) WHERE rel_path IS NOT NULL GROUP BY 1""")
def s27_import_media(spark, folder):
    m = records(spark, folder).groupBy("media_id").agg(F.min(F.struct("rel_path", "md5", "category", "media_size")).alias("x"))
    m = m.select(F.col("media_id").alias("pos"), F.col("x.rel_path").alias("path"), "x.md5", "x.category", F.col("x.media_size").alias("size"))
    return readers.import_media(m)


@query(r"""SELECT DISTINCT raw_id, nullif(upper(regexp_extract(regexp_extract(body, '"@odata\.context"\s*:\s*"([^"]*)"', 1), '\.xml/([A-Za-z][A-Za-z-]*)/\$metadata', 1)), '') AS region FROM vic_raw WHERE body IS NOT NULL""")
def s32_region_tag(spark, folder):
    return table(spark, folder, "vic_raw").where(F.col("body").isNotNull()).select("raw_id", readers.region_of(F.col("body")).alias("region")).distinct()


# --- scalar functions ---------------------------------------------------------------------------------
@query("""SELECT id, CASE WHEN regexp_full_match(lower(trim(md5)), '[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}') AND lower(trim(md5)) NOT IN ('d41d8cd98f00b204e9800998ecf8427e') THEN lower(trim(md5)) END AS norm,
CASE length(md5) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' END AS algo FROM f""")
def c04_normal_hash(spark, folder):
    return files(spark, folder, "md5").select("id", S.normal_hash(F.col("md5")).alias("norm"), S.algorithm_of(F.col("md5")).alias("algo"))


@query("SELECT id, CASE WHEN mtime IS NULL OR mtime = 0 THEN '' ELSE strftime(make_timestamp((floor(mtime) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') END AS utc, CASE WHEN mtime IS NULL OR mtime = 0 THEN '' ELSE strftime(make_timestamp((floor(mtime) * 1000000)::BIGINT) + INTERVAL '9 hours', '%Y-%m-%d %H:%M:%S') END AS tokyo FROM f")
def c07_epoch_text(spark, folder):
    return files(spark, folder, "mtime").select("id", S.epoch_text(F.col("mtime")).alias("utc"), S.epoch_text(F.col("mtime"), "Asia/Tokyo").alias("tokyo"))


@query("SELECT id, round((gps_lon + 180) / 360 * 256.0 * 1024, 4) AS x, round((0.5 - ln((1 + greatest(-0.9999, least(0.9999, sin(radians(gps_lat))))) / (1 - greatest(-0.9999, least(0.9999, sin(radians(gps_lat)))))) / (4 * pi())) * 256.0 * 1024, 4) AS y FROM f WHERE gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon)")
def c10_mercator_pixel(spark, folder):
    x, y = S.mercator_pixel(F.col("gps_lat"), F.col("gps_lon"), 10)
    rows = files(spark, folder, "gps_lat", "gps_lon").where(F.col("gps_lat").between(-90, 90) & F.col("gps_lon").between(-180, 180) & ~F.isnan("gps_lat") & ~F.isnan("gps_lon"))
    return rows.select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("SELECT id, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1)) AS suffix FROM f")
def c12_paths(spark, folder):
    return files(spark, folder, "path").select("id", S.base_name(F.col("path")).alias("base"), S.suffix(F.col("path")).alias("suffix"))


@query(f"SELECT id, {_LABEL} AS label FROM f")
def c15_category_label(spark, folder):
    return files(spark, folder, "category").select("id", reports.category_label(F.col("category")).alias("label"))


@query("SELECT id, lower(CASE WHEN regexp_matches(n, '^[A-Za-z_]') THEN n ELSE '_' || n END) AS name FROM (SELECT id, regexp_replace(trim(regexp_replace(rel_path, '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g')), '\\s+', '_', 'g') AS n FROM f)")
def c21_identifier(spark, folder):
    return files(spark, folder, "rel_path").select("id", S.identifier(F.col("rel_path")).alias("name"))


@query("SELECT id, CASE WHEN floor(gps_lat * 10000) / 10000 = 0 AND floor(gps_lon * 10000) / 10000 = 0 THEN NULL ELSE floor(gps_lat * 10000) / 10000 END AS lat, CASE WHEN floor(gps_lat * 10000) / 10000 = 0 AND floor(gps_lon * 10000) / 10000 = 0 THEN NULL ELSE floor(gps_lon * 10000) / 10000 END AS lon FROM f WHERE gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon)")
def c23_iso6709(spark, folder):
    """Positions written as ISO 6709 with four decimals and read back."""
    rows = files(spark, folder, "gps_lat", "gps_lon").where("gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon)")
    text = F.format_string("%+08.4f%+09.4f/", F.floor(F.col("gps_lat") * 10000) / 10000, F.floor(F.col("gps_lon") * 10000) / 10000)
    return rows.select("id", S.iso6709(text).alias("c")).select("id", "c.lat", "c.lon")


@query("SELECT id, CASE WHEN gps_lat < 0 THEN -1 ELSE 1 END * (floor(abs(gps_lat)) + (floor(abs(gps_lat) * 60)::BIGINT % 60) / 60.0::DOUBLE + (floor(abs(gps_lat) * 3600)::BIGINT % 60) / 3600.0::DOUBLE) AS degrees FROM f WHERE gps_lat BETWEEN -90 AND 90 AND NOT isnan(gps_lat)")
def s29_dms_degrees(spark, folder):
    """Latitudes written in degrees, minutes and seconds with their letter, and read back."""
    rows = files(spark, folder, "gps_lat").where("gps_lat BETWEEN -90 AND 90 AND NOT isnan(gps_lat)")
    a = F.abs("gps_lat")
    text = F.concat_ws(", ", F.floor(a).cast("string"), (F.floor(a * 60) % 60).cast("string"), (F.floor(a * 3600) % 60).cast("string"))
    return rows.select("id", S.dms_degrees(text, F.when(F.col("gps_lat") < 0, "S").otherwise("N")).alias("degrees"))


@query("SELECT id, coalesce(try_cast(regexp_extract(rel_path, '[0-9]+\\.?[0-9]*([eE][-+]?[0-9]+)?', 0) AS DOUBLE), 0.0::DOUBLE) AS n FROM f")
def f24_leading_number(spark, folder):
    return files(spark, folder, "rel_path").select("id", S.leading_number(F.regexp_extract("rel_path", r"[0-9]+.*", 0)).alias("n"))


@query("SELECT id, user_id AS file_id, event_type AS flag FROM (SELECT DISTINCT f.id, e.user_id, e.event_type FROM f JOIN events e ON e.user_id = f.id)")
def j04_flags(spark, folder):
    flags = table(spark, folder, "events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("flag")).distinct()
    return files(spark, folder, "id").join(flags, F.col("id") == F.col("file_id")).select("id", "file_id", "flag")


@query("SELECT id FROM f WHERE id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def f09_flagged(spark, folder):
    flagged = table(spark, folder, "events").where(F.col("event_type") == "error").select(F.col("user_id").alias("id"))
    return files(spark, folder, "id").join(flagged, "id", "left_semi").select("id")


@query("SELECT id, coalesce(vstack_id, stack_id, id) AS grp FROM f WHERE coalesce(vstack_id, stack_id, id) IN (SELECT coalesce(vstack_id, stack_id, id) FROM f WHERE category = 1)")
def j13_categorize_group(spark, folder):
    base = files(spark, folder, "category", "stack_id", "vstack_id")
    chosen = base.where(F.col("category") == 1).select(S.group_key().alias("grp"))
    return base.withColumn("grp", S.group_key()).join(chosen, "grp", "left_semi").select("id", "grp")


@query("SELECT id FROM f WHERE kind IN ('image', 'video') AND id NOT IN (SELECT file_id FROM content_vecs WHERE file_id IS NOT NULL)")
def j14_not_yet_indexed(spark, folder):
    done = table(spark, folder, "content_vecs").select(F.col("file_id").alias("id"))
    return files(spark, folder, "kind").where(F.col("kind").isin("image", "video")).join(done, "id", "left_anti").select("id")

