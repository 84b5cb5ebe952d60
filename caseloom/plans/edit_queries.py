"""Queries for edits, artifacts, row decoration and name functions, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import details as D
from ..functions import names as N
from ..functions import scalars as S
from ..operators import artifacts, edits, gallery
from ..session import table
from .case_queries import QUERIES, SQL, _hits, files, query, records
from .report_queries import _LABEL

_NAME = "coalesce(nullif(orig_name, ''), CASE WHEN media_id IS NULL THEN rel_path END)"
_DURATION = "CASE WHEN coalesce(duration, 0) = 0 THEN '' ELSE (floor(duration)::BIGINT // 60) || ':' || lpad((floor(duration)::BIGINT % 60)::VARCHAR, 2, '0') END"


def _events(spark, folder):
    return table(spark, folder, "events")


# --- writes -------------------------------------------------------------------------------------------
@query("""SELECT path, coalesce(n.size, f.size) AS size, coalesce(n.category, f.category, 5) AS category, coalesce(f.ingested_at, 1e9::DOUBLE) AS ingested_at, f.id IS NULL AS fresh FROM f FULL JOIN (
SELECT rel_path AS path, arg_max_null(media_size, media_id) AS size, arg_max_null(category, media_id) AS category FROM (SELECT media_id, rel_path, min(media_size) AS media_size, min(category) AS category FROM r WHERE rel_path IS NOT NULL GROUP BY 1, 2) GROUP BY 1) n USING (path)""")
def m01_upsert_files(spark, folder):
    """Imported records meet the files of their path: known paths are filled, new ones added."""
    r = records(spark, folder).where(F.col("rel_path").isNotNull()).groupBy("media_id", "rel_path").agg(F.min("media_size").alias("size"), F.min("category").alias("category"))
    incoming = r.select(F.col("rel_path").alias("path"), "size", "category", F.col("media_id").alias("seq"))
    base = files(spark, folder, "path", "size", "category", "ingested_at")
    known = base.select("path", F.lit(True).alias("_known"))
    return edits.upsert_files(base, incoming, F.lit(1e9)).join(known, "path", "left").select("path", "size", "category", "ingested_at", F.col("_known").isNull().alias("fresh"))


def _edits(spark, folder):
    """A stand-in for edits: every event of a user edits the file of its number."""
    e = _events(spark, folder)
    return e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("value") > 100, (F.col("event_id") % 5).cast("int")).alias("category"), F.when(F.col("value") < 20, F.col("event_type")).alias("notes"))


_EDITS = ", ed AS (SELECT user_id AS file_id, event_id AS seq, ts, CASE WHEN value > 100 THEN (event_id % 5)::INTEGER END AS category, CASE WHEN value < 20 THEN event_type END AS notes FROM events)"


@query(_EDITS + """, l AS (SELECT file_id, arg_max(category, seq) FILTER (category IS NOT NULL) AS category, arg_max(notes, seq) FILTER (notes IS NOT NULL) AS notes FROM ed GROUP BY 1)
SELECT f.id, coalesce(l.category, f.category) AS category, l.notes FROM f LEFT JOIN l ON l.file_id = f.id""")
def m02_categorize(spark, folder):
    base = files(spark, folder, "category").withColumn("notes", F.lit(None).cast("string"))
    return edits.apply_edits(base, _edits(spark, folder))


@query(_EDITS + " SELECT ts, 'category' AS action, file_id, category::VARCHAR AS detail FROM ed WHERE category IS NOT NULL UNION ALL SELECT ts, 'notes', file_id, notes FROM ed WHERE notes IS NOT NULL")
def m02_audit_rows(spark, folder):
    return edits.audit_of(_edits(spark, folder))


_CATEGORIES = "(SELECT n_nationkey AS code, n_name AS name, n_nationkey < 3 AS locked, false AS hidden FROM nation)"


def _categories(spark, folder):
    """A stand-in for a case's categories: the nations, the first three of them locked."""
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), (F.col("n_nationkey") < 3).alias("locked"), F.lit(False).alias("hidden"))


@query(f"SELECT code, name, locked, code = 4 AS hidden FROM {_CATEGORIES} WHERE code <> 4 OR (SELECT count(*) FROM f WHERE category = 4) > 0")
def m03_delete_category(spark, folder):
    return edits.delete_category(files(spark, folder, "category"), _categories(spark, folder), 4)[1].select("code", "name", "locked", "hidden")


@query("SELECT coalesce(CASE WHEN category = 4 THEN 3 ELSE category END, -1) AS category, count(*) AS n FROM f GROUP BY 1")
def m03_reassign_category(spark, folder):
    moved, _ = edits.delete_category(files(spark, folder, "category"), _categories(spark, folder), 4, to=3)
    return moved.groupBy(F.coalesce("category", F.lit(-1)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT file_id, flag FROM (SELECT user_id AS file_id, event_type AS flag, arg_max(value > 50, event_id) AS keep FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) WHERE keep
UNION SELECT user_id, event_type FROM events b WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM (SELECT user_id, event_type, arg_max(value > 50, event_id) AS keep FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) c WHERE c.user_id = b.user_id AND c.event_type = b.event_type AND NOT c.keep)""")
def m04_change_flags(spark, folder):
    """Flags from the even events of a user, changed by the odd ones."""
    e = _events(spark, folder).select(F.col("user_id").alias("file_id"), F.col("event_type").alias("flag"), F.col("event_id").alias("seq"), (F.col("value") > 50).alias("add"))
    return edits.change_flags(e.where(F.col("seq") % 2 == 0).select("file_id", "flag"), e.where(F.col("seq") % 2 == 1))


_SETTLE = "regexp_full_match(lower(trim(md5)), '[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}') AND lower(trim(md5)) <> 'd41d8cd98f00b204e9800998ecf8427e'"


@query(f"""SELECT set_name, algo, value, category FROM entries WHERE algo = 'md5' AND set_name = 'nas_a' UNION ALL
SELECT 'nas_a', CASE length(value) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END, value, category FROM (SELECT lower(trim(md5)) AS value, arg_min_null(category, (media_id, category)) AS category FROM r WHERE md5 IS NOT NULL AND {_SETTLE} GROUP BY 1)
WHERE value NOT IN (SELECT value FROM entries WHERE algo = 'md5' AND set_name = 'nas_a')""")
def m05_add_to_set(spark, folder):
    from .case_queries import entries

    held = entries(spark, folder).where((F.col("algo") == "md5") & (F.col("set_name") == "nas_a")).select("set_name", "algo", "value", "category")
    new = records(spark, folder).select(F.col("md5").alias("value"), "category", F.struct("media_id", F.coalesce("category", F.lit(1 << 30))).alias("seq"))
    return edits.add_to_set(held, new, "nas_a")


@query("SELECT set_name AS name, 'ready' AS status, count(DISTINCT (algo, value)) AS entries FROM entries WHERE set_name <> 'nas_a' GROUP BY 1 UNION ALL SELECT 'nas_a', CASE WHEN count(*) > 0 THEN 'ready' ELSE 'failed' END, count(DISTINCT (algo, value)) FROM entries WHERE algo = 'sha1'")
def m06_global_set(spark, folder):
    from .case_queries import entries

    e = entries(spark, folder)
    sets = e.groupBy(F.col("set_name").alias("name")).agg(F.countDistinct("algo", "value").alias("entries")).select("name", F.lit("ready").alias("status"), "entries")
    return edits.build_global_set(sets, "nas_a", e.where(F.col("algo") == "sha1"))


@query("SELECT id, CASE category WHEN 0 THEN 5 WHEN 5 THEN 0 ELSE category END AS category FROM f")
def m09_swap_codes(spark, folder):
    return edits.swap_codes(files(spark, folder, "category"))


@query("SELECT DISTINCT doc_id AS file_id, trim(reader) AS flag FROM level_labels WHERE trim(reader) <> '' UNION SELECT user_id, event_type FROM events")
def m09_tags_to_flags(spark, folder):
    tags = table(spark, folder, "level_labels").select(F.col("doc_id").alias("file_id"), F.col("reader").alias("tag"))
    return edits.tags_to_flags(tags, _events(spark, folder).select(F.col("user_id").alias("file_id"), F.col("event_type").alias("flag")))


@query("SELECT r_regionkey AS code, r_name AS name, r_regionkey AS position FROM region UNION ALL SELECT DISTINCT category, 'Category ' || category, 5 + category FROM f WHERE category IS NOT NULL AND category NOT IN (SELECT r_regionkey FROM region)")
def m10_seed_categories(spark, folder):
    scheme = table(spark, folder, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("position"))
    return edits.seed_categories(scheme, files(spark, folder, "category"))


@query("SELECT id, CASE WHEN starts_with(path, '/cases/') THEN '/mnt/new/' || substr(path, 8) ELSE path END AS path FROM f")
def m11_rebase_paths(spark, folder):
    return edits.rebase_paths(files(spark, folder, "path"), "/cases", "/mnt/new/")


@query("SELECT id FROM f WHERE id NOT IN (SELECT user_id FROM events WHERE event_type = 'view')")
def m13_stale_readings(spark, folder):
    return edits.stale_readings(files(spark, folder, "id"), _events(spark, folder).select(F.col("user_id").alias("file_id"), F.col("event_type").alias("version")), "view")


# --- artifacts ----------------------------------------------------------------------------------------
@query(f"""SELECT c.*, {_NAME} AS name FROM (SELECT user_id AS file_id, n || ' of ' || max(n) OVER (PARTITION BY user_id) || CASE WHEN n = max(n) OVER (PARTITION BY user_id) AND n > 1 THEN ' (active)' ELSE '' END AS manifest,
CASE WHEN value > 100 THEN 'Yes' ELSE 'No' END AS ai_declared, event_type AS generator, 'C2PA' AS metadata_source FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'view')
UNION ALL SELECT user_id, '', CASE WHEN value > 100 THEN 'Yes' ELSE 'No' END, event_type, 'XMP' FROM events WHERE event_type = 'view') c JOIN f ON f.id = c.file_id""")
def k10_content_credentials(spark, folder):
    from pyspark.sql import Window

    e = _events(spark, folder).select(F.col("user_id").alias("file_id"), "event_id", (F.col("value") > 100).alias("ai"), "event_type")
    own = e.where(F.col("event_type") != "view").withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy("event_id")))
    manifests = own.select("file_id", "n", F.col("event_type").alias("generator"), "ai")
    return artifacts.credentials(files(spark, folder, "orig_name", "rel_path", "media_id"), manifests, e.where(F.col("event_type") == "view").select("file_id", F.col("event_type").alias("source_type"), "ai"))


@query(f"""SELECT f.id AS file_id, path, (t // 3600) || ':' || lpad((t % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS "offset", ts AS offset_s, coalesce(phash, '') AS phash, {_DURATION} AS duration_text, md5, {_LABEL} AS category_label
FROM f JOIN (SELECT DISTINCT l_orderkey AS id, (l_linenumber * 977.5)::DOUBLE AS ts, floor(l_linenumber * 977.5)::BIGINT AS t FROM lineitem) k ON k.id = f.id WHERE kind = 'video'""")
def k13_key_frames(spark, folder):
    own = files(spark, folder, "kind", "path", "md5", "phash", "duration", "category").where(F.col("kind") == "video")
    frames = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 977.5).alias("ts")).distinct()
    frames = frames.join(own.select(F.col("id").alias("file_id"), "phash"), "file_id")
    return artifacts.key_frames(own, frames)


def _packed_records(spark, folder):
    """Imported records with flags, a stand-in: a flag is known if a bit of the size is set, true if the next one is."""
    bit = lambda k: F.coalesce("media_size", F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
    flags = D.pack_flags([F.when(bit(2 * i), bit(2 * i + 1)) for i in range(len(artifacts.RECORD_FLAGS))])
    return records(spark, folder).select("media_id", "orig_name", "orig_path", "category", "md5", "sha1", "mime", F.col("media_size").alias("size"), flags.alias("flags"))


_FLAG = lambda c: ", ".join(f"CASE WHEN {c} & {1 << 2 * i} = 0 THEN '' WHEN {c} & {1 << 2 * i + 1} <> 0 THEN 'Yes' ELSE 'No' END AS {f}" for i, f in enumerate(artifacts.RECORD_FLAGS))


@query(f"SELECT media_id, coalesce(orig_name, '') AS name, coalesce(orig_path, '') AS device_path, {_LABEL} AS category_label, {_FLAG('coalesce(media_size, 0)')}, coalesce(md5, '') AS md5, coalesce(sha1, '') AS sha1, coalesce(mime, '') AS mime, media_size AS size FROM r WHERE media_id IS NOT NULL")
def k14_vic_records(spark, folder):
    return artifacts.record_rows(_packed_records(spark, folder))


@query(f"""SELECT h.id, h.set_name, x.media_id AS vic_media_id, h.category AS asserted, {_FLAG('x.media_size')}, f.path, h.value, {_LABEL.replace('category,', 'f.category,').replace("|| coalesce(category", "|| coalesce(f.category")} AS case_category FROM hits h
JOIN (SELECT lower(trim(md5)) AS value, media_id, min(coalesce(media_size, 0)) AS media_size FROM r WHERE md5 IS NOT NULL AND media_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lower(trim(md5)) ORDER BY media_id) = 1) x ON x.value = h.value JOIN f ON f.id = h.id""")
def k19_set_matches(spark, folder):
    own = files(spark, folder, "path", "category")
    r = records(spark, folder).where(F.col("md5").isNotNull() & F.col("media_id").isNotNull()).groupBy("md5", "media_id").agg(F.min(F.coalesce("media_size", F.lit(0))).alias("media_size"))
    # One record of several of a digest and number: the smallest one, as in the SQL.
    low = r.groupBy(F.lower(F.trim("md5")).alias("md5"), "media_id").agg(F.min("media_size").alias("media_size"))
    bit = lambda k: F.col("media_size").bitwiseAND(F.lit(1 << k)) != 0
    low = low.withColumn("flags", D.pack_flags([F.when(bit(2 * i), bit(2 * i + 1)) for i in range(len(artifacts.RECORD_FLAGS))]))
    return artifacts.set_matches(own, _hits(spark, folder).select("id", "set_name", "value", "category"), low)


@query("SELECT stack_id, count(*) AS copies, regexp_extract(arg_min(path, id), '([^/]*)$', 1) AS name, arg_min(path, id) AS path, count(DISTINCT source) AS sources, max(size) AS bytes_each, sum(size)::BIGINT AS bytes_total FROM f WHERE stack_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def k16_stack_rows(spark, folder):
    return artifacts.stack_rows(files(spark, folder, "stack_id", "path", "source", "size"))


@query("SELECT n_nationkey AS code, n_name AS name, (SELECT count(*) FROM f WHERE category = n_nationkey) AS n FROM nation")
def k21_category_counts(spark, folder):
    return artifacts.category_counts(_categories(spark, folder), files(spark, folder, "category"))


@query(f"""SELECT id, {_LABEL} AS category_label, coalesce((SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events WHERE user_id = id), '') AS flags, id IN (SELECT l_orderkey FROM lineitem) AS has_keyframes
FROM (SELECT id, category, size FROM f WHERE kind = 'image' ORDER BY size DESC, id DESC LIMIT 300)""")
def p05_decorated_page(spark, folder):
    page = gallery.page(table(spark, folder, "files"), gallery.FileQuery(kind="image", sort="size", descending=True, limit=300), ["id", "category"])
    flags = _events(spark, folder).select(F.col("user_id").alias("file_id"), F.col("event_type").alias("flag"))
    frames = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("file_id"))
    return artifacts.decorated(page, flags, frames).select("id", "category_label", "flags", "has_keyframes")


@query("SELECT id, coalesce(nullif(path, ''), CASE WHEN media_id IS NULL THEN rel_path END) AS file_path FROM f")
def p03_file_path(spark, folder):
    return files(spark, folder, "path", "rel_path", "media_id").select("id", gallery.shown_path(["path"]).alias("file_path"))


# --- scopes, counts and views -------------------------------------------------------------------------
@query("SELECT id FROM f WHERE id IN (SELECT user_id FROM events WHERE event_type IN ('error', 'view'))")
def f25_scope_flags(spark, folder):
    chosen = _events(spark, folder).where(F.col("event_type").isin("error", "view")).select(F.col("user_id").alias("file_id"))
    return gallery.scoped(files(spark, folder, "id"), "flags", flags=chosen)


@query("SELECT id FROM f WHERE id IN (SELECT doc_id FROM level_labels)")
def f25_scope_selected(spark, folder):
    return gallery.scoped(files(spark, folder, "id"), "selected", chosen=table(spark, folder, "level_labels").select(F.col("doc_id").alias("id")))


@query("SELECT id FROM f, (SELECT 1) WHERE id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def f22_with_error(spark, folder):
    """Errors, a stand-in: the latest failed event of a file's number."""
    failed = _events(spark, folder).where(F.col("event_type") == "error").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("error"))
    return files(spark, folder, "id").join(failed, "id", "left").where(F.col("error").isNotNull()).select("id")


@query("SELECT id, (floor((gps_lon + 180) / 360 * 64))::INTEGER AS x, (floor((0.5 - ln((1 + sin(radians(gps_lat))) / (1 - sin(radians(gps_lat)))) / (4 * pi())) * 64))::INTEGER AS y FROM f WHERE gps_lat BETWEEN -80 AND 80 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lon) AND ((floor((gps_lon + 180) / 360 * 64))::INTEGER + (floor((0.5 - ln((1 + sin(radians(gps_lat))) / (1 - sin(radians(gps_lat)))) / (4 * pi())) * 64))::INTEGER) % 3 = 0")
def f32_covered_points(spark, folder):
    points = files(spark, folder, "gps_lat", "gps_lon").where("gps_lat BETWEEN -80 AND 80 AND gps_lon BETWEEN -180 AND 180").select("id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    tiles = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y")).where((F.col("x") + F.col("y")) % 3 == 0)
    return artifacts.covered_points(points, tiles, 6)


@query("SELECT event_id AS id FROM events WHERE event_type NOT IN ('view', 'error')")
def f33_audit_edits(spark, folder):
    e = _events(spark, folder).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "ingest").when(F.col("event_type") == "error", "process").otherwise(F.col("event_type")).alias("action"), F.lit(None).cast("string").alias("detail"))
    return artifacts.audit_view(e, "edits").select("id")


@query("SELECT event_type AS stage, count(*) FILTER (value <= 150 OR value IS NULL) AS done, count(*) FILTER (value > 150) AS failed, round(sum(value), 3) AS seconds FROM events GROUP BY 1")
def g12_stage_outcomes(spark, folder):
    runs = _events(spark, folder).select(F.col("event_type").alias("stage"), F.col("user_id").alias("file_id"), F.when(F.col("value") > 150, "slow").alias("error"), F.col("value").alias("seconds"))
    return artifacts.stage_outcomes(runs)


@query("SELECT source, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (category IS NOT NULL AND category <> 5) AS categorized, max(ingested_at) AS latest FROM f GROUP BY 1")
def g19_case_overview(spark, folder):
    return artifacts.case_overview(files(spark, folder, "source", "size", "category", "ingested_at"))


@query("SELECT DISTINCT lower(trim(md5)) AS value FROM f WHERE " + _SETTLE)
def w10_distinct_digests(spark, folder):
    return files(spark, folder, "md5").select(S.normal_hash(F.col("md5")).alias("value")).where("value IS NOT NULL AND value <> 'd41d8cd98f00b204e9800998ecf8427e'").distinct()


# --- scalar functions ---------------------------------------------------------------------------------
@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def c01_content_digests(spark, folder):
    d = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", *[c.alias(k) for k, c in N.content_digests(F.encode("text", "UTF-8")).items()])


@query("SELECT DISTINCT name_id, value, CASE name_id % 3 WHEN 0 THEN nullif(trim(value), '') WHEN 1 THEN coalesce(nullif(value, ''), to_json({'Name': value})::VARCHAR) ELSE nullif(trim(value), '') END AS text FROM vic_media_exif WHERE value IS NOT NULL AND name_id IS NOT NULL AND regexp_full_match(value, '[A-Za-z0-9 .,/-]*[A-Za-z][A-Za-z0-9 .,/-]*') AND lower(trim(value)) <> 'null'")
def c14_as_text(spark, folder):
    """Values as members of a record: as they are, as objects with a name, and as quoted texts."""
    v = table(spark, folder, "vic_media_exif").where(F.col("name_id").isNotNull() & F.col("value").rlike("^[A-Za-z0-9 .,/-]*[A-Za-z][A-Za-z0-9 .,/-]*$") & (F.lower(F.trim("value")) != "null")).select("name_id", "value").distinct()
    as_json = F.when(F.col("name_id") % 3 == 0, F.col("value")).when(F.col("name_id") % 3 == 1, F.to_json(F.struct(F.col("value").alias("Name")))).otherwise(F.concat(F.lit('"'), "value", F.lit('"')))
    return v.select("name_id", "value", N.as_text(as_json).alias("text"))


@query("SELECT id, nullif(trim(created_dt), '') AS taken FROM f")
def c17_capture_date(spark, folder):
    return files(spark, folder, "created_dt", "mtime").select("id", N.capture_date(F.col("created_dt"), F.col("mtime")).alias("taken"))


@query("SELECT id, coalesce(nullif(substr(trim(regexp_replace(rel_path, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), 1, 60), ''), 'archive') AS slug, sha1(rel_path) || CASE WHEN regexp_matches(rel_path, '[^/]\\.[A-Za-z0-9]{1,8}$') THEN lower(regexp_extract(rel_path, '\\.[A-Za-z0-9]{1,8}$', 0)) ELSE '' END AS digest_name FROM f WHERE rel_path IS NOT NULL")
def c19_safe_names(spark, folder):
    rows = files(spark, folder, "rel_path").where(F.col("rel_path").isNotNull())
    return rows.select("id", N.slug(F.col("rel_path")).alias("slug"), N.digest_name(F.col("rel_path")).alias("digest_name"))


@query("SELECT id, CASE WHEN regexp_full_match(path, '/[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)+') THEN 'cannot open: kind ' || kind ELSE 'cannot open: kind ' || kind || ' (too long)' END AS said FROM f WHERE path IS NOT NULL")
def c20_scrubbed_errors(spark, folder):
    """Messages that name a file's path: quoted, and bare where it has no blank."""
    rows = files(spark, folder, "path", "kind").where(F.col("path").isNotNull())
    bare = F.when(F.col("path").rlike("^/[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)+$"), F.col("path")).otherwise("too long")
    return rows.select("id", N.scrub_paths(F.concat(F.lit("cannot open '"), "path", F.lit("': kind "), "kind", F.lit(" ("), bare, F.lit(")"))).alias("said"))


_EXT_OF = "CASE lower(trim(split_part(mime, ';', 1))) " + " ".join(f"WHEN '{m}' THEN '{e}'" for m, e in N.MIME_EXTENSIONS.items()) + " END"


@query(f"SELECT DISTINCT media_id, mime, {_EXT_OF} AS ext FROM r")
def c22_mime_extension(spark, folder):
    return records(spark, folder).select("media_id", "mime", N.mime_extension(F.col("mime")).alias("ext")).distinct()


@query("SELECT doc_id, n || '-' || sha256(encode(n::VARCHAR) || b[1:1048576] || CASE WHEN n > 1048576 THEN b[n - 1048575:n] ELSE ''::BLOB END) AS identity FROM (SELECT doc_id, strlen(text) AS n, encode(text) AS b FROM documents WHERE text IS NOT NULL)")
def c29_weak_identity(spark, folder):
    d = table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", F.encode("text", "UTF-8").alias("b"), F.octet_length("text").alias("n"))
    return d.select("doc_id", N.weak_identity(F.col("b"), F.col("n")).alias("identity"))


@query("""SELECT DISTINCT media_id, CASE WHEN e IN ('.jpg','.jpeg','.heic','.webp','.gif','.png','.bmp','.tif','.tiff') THEN 'image' WHEN e IN ('.mp4','.mov','.avi','.mkv','.3gp','.webm') THEN 'video' WHEN e IN ('.zip','.tar','.7z','.gz') THEN 'archive'
WHEN lower(coalesce(mime, '')) IN ('image/unknown', 'application/octet-stream', '') THEN 'other' WHEN lower(mime) LIKE 'video/%' THEN 'video' WHEN lower(mime) LIKE 'image/%' THEN 'image' ELSE 'other' END AS kind
FROM (SELECT media_id, mime, lower(regexp_extract(regexp_extract(coalesce(rel_path, ''), '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1)) AS e FROM r)""")
def s30_kind_from_mime(spark, folder):
    return records(spark, folder).select("media_id", N.kind_from_mime(F.col("mime"), F.coalesce("rel_path", F.lit(""))).alias("kind")).distinct()


__all__ = ["QUERIES", "SQL"]
