"""Queries for container kinds, credentials, artifacts and record details, with the SQL they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import details as D
from ..functions import scalars as S
from ..operators import gallery, nested, reports
from ..operators.components import connected_components
from ..session import table
from .case_queries import QUERIES, SQL, _WITH, _hits, entries, files, query, records

_CRED = "c AS (SELECT media_id AS id, min(CASE category WHEN 4 THEN 'c2pa' WHEN 0 THEN 'xmp' ELSE 'none' END) AS status, min(CASE mime WHEN 'image/png' THEN 'yes' WHEN 'image/jpeg' THEN 'no' END) AS ai FROM r GROUP BY 1)"


def _credentials(spark, folder) -> DataFrame:
    """A stand-in for content credentials: readings derived from the imported records."""
    m = F.col("media_id")
    return records(spark, folder).groupBy(m.alias("id")).agg(F.min(F.when(F.col("category") == 4, "c2pa").when(F.col("category") == 0, "xmp").otherwise("none")).alias("status"), F.min(F.when(F.col("mime") == "image/png", "yes").when(F.col("mime") == "image/jpeg", "no")).alias("ai"))


@query(""", n AS (SELECT DISTINCT container_id AS id FROM f WHERE container_id IS NOT NULL AND orig_name LIKE 'IMG%') SELECT f.id, CASE WHEN lower(ext) IN ('.pdf','.html','.htm','.xhtml','.mht','.mhtml','.webarchive') THEN 'document' WHEN lower(ext) IN ('.db', '.plist') THEN 'document'
WHEN coalesce(ext, '') = '' AND n.id IS NOT NULL THEN 'document' ELSE 'archive' END AS subkind FROM f LEFT JOIN n ON n.id = f.id WHERE f.id IN (SELECT container_id FROM f)""")
def f04_document_containers(spark, folder):
    """Which containers are documents: by extension, or, without one, by how their items are named (here: IMG and on)."""
    base = files(spark, folder, "container_id", "ext", "orig_name")
    boxes = base.join(base.select(F.col("container_id").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_semi")
    # The tables hold no documents: listings and databases stand in for them.
    boxes = boxes.withColumn("ext", F.when(F.lower("ext").isin(".db", ".plist"), ".pdf").otherwise(F.col("ext")))
    return gallery.container_subkinds(boxes, base, "^IMG").select("id", "subkind")


@query(", " + _CRED + " SELECT f.id FROM f JOIN c USING (id) WHERE kind <> 'archive' AND status IN ('c2pa', 'xmp')")
def f10_declared_credentials(spark, folder):
    return files(spark, folder, "kind").where("kind <> 'archive'").join(_credentials(spark, folder).where(F.col("status").isin("c2pa", "xmp")), "id", "left_semi").select("id")


@query(", " + _CRED + " SELECT f.id FROM f WHERE kind IN ('image', 'video') AND id NOT IN (SELECT id FROM c)")
def f10_unread_credentials(spark, folder):
    return files(spark, folder, "kind").where(F.col("kind").isin("image", "video")).join(_credentials(spark, folder), "id", "left_anti").select("id")


@query(", " + _CRED + " SELECT f.id FROM f JOIN c USING (id) WHERE kind <> 'archive' AND ai = 'yes'")
def f11_ai_reading(spark, folder):
    return files(spark, folder, "kind").where("kind <> 'archive'").join(_credentials(spark, folder).where("ai = 'yes'"), "id", "left_semi").select("id")


@query("SELECT id FROM f WHERE kind <> 'archive' AND id IN (SELECT id FROM hits)")
def f13_any_hit(spark, folder):
    return files(spark, folder, "kind").where("kind <> 'archive'").join(_hits(spark, folder).select("id"), "id", "left_semi").select("id")


@query("SELECT DISTINCT id FROM hits WHERE store = 'case' AND kind = 'known'")
def f14_case_set_hit(spark, folder):
    return _hits(spark, folder).where((F.col("store") == "case") & (F.col("kind") == "known")).select("id").distinct()


@query("SELECT id, 'cannot decode' AS error FROM f WHERE size <> 0 AND kind = 'image' AND phash IS NULL")
def f26_retryable_errors(spark, folder):
    error = F.when(F.col("size") == 0, F.concat(F.lit("online-only cloud placeholder: "), F.col("size"))).when((F.col("kind") == "image") & F.col("phash").isNull(), "cannot decode")
    rows = files(spark, folder, "kind", "phash", "size").select("id", error.alias("error"))
    return rows.where(F.col("error").isNotNull() & ~F.col("error").startswith("online-only cloud placeholder: "))


#: Where systems and applications keep their own artwork.
_ARTWORK = ("%/windows/%", "%/program files%", "%/programdata/%", "%/system/library/%", "%/applications/%.app/%", r"%\\windows\\%", r"%\\program files%")


@query("""SELECT min(id) AS id, min(CASE WHEN lower(path) LIKE '%/windows/%' OR lower(path) LIKE '%/program files%' OR lower(path) LIKE '%/programdata/%' OR lower(path) LIKE '%/system/library/%' OR lower(path) LIKE '%/applications/%.app/%'
THEN 1 ELSE 0 END)::INTEGER AS artwork FROM f WHERE kind IN ('image', 'video') AND greatest(coalesce(width, 0), coalesce(height, 0)) >= 128 GROUP BY coalesce(stack_id, id)""")
def f30_indexable(spark, folder):
    low = F.lower("path")
    art = reduce(lambda a, p: a | low.like(p), _ARTWORK[1:], low.like(_ARTWORK[0]))
    rows = files(spark, folder, "height", "kind", "path", "stack_id", "width").where(F.col("kind").isin("image", "video") & (F.greatest(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))) >= 128))
    return rows.groupBy(F.coalesce("stack_id", "id").alias("g")).agg(F.min("id").alias("id"), F.min(F.when(art, 1).otherwise(0)).alias("artwork")).select("id", "artwork")


@query("SELECT id, count(*) OVER (PARTITION BY stack_id) AS n FROM f WHERE stack_id IS NOT NULL")
def g05_group_sizes(spark, folder):
    base = files(spark, folder, "stack_id").where(F.col("stack_id").isNotNull())
    return base.join(base.groupBy("stack_id").agg(F.count(F.lit(1)).alias("n")), "stack_id").select("id", "n")


@query()
def g09_case_summary(spark, folder):
    """Media counted from the arrays, never from a header, per document."""
    media = nested.media_table(table(spark, folder, "vic_raw")).groupBy("raw_id").agg(F.count(F.lit(1)).alias("media_count"))
    first = nested.case_table(table(spark, folder, "vic_raw")).groupBy("raw_id").agg(F.min(F.struct("case_pos", "case_id", "case_number", "application")).alias("c"))
    return media.join(first, "raw_id", "left").select("raw_id", "c.case_id", "c.case_number", "c.application", "media_count")


@query("SELECT id, source, path, size, md5 FROM f WHERE kind <> 'archive'")
def k09_media_files(spark, folder):
    return files(spark, folder, "kind", "md5", "path", "size", "source").where("kind <> 'archive'").select("id", "source", "path", "size", "md5")


@query("SELECT id, coalesce(origin, '') AS origin, category FROM f WHERE kind <> 'archive' AND category IS NOT NULL AND category <> 5")
def k11_categorized_media(spark, folder):
    return files(spark, folder, "category", "kind", "origin").where("kind <> 'archive' AND category IS NOT NULL AND category <> 5").select("id", F.coalesce("origin", F.lit("")).alias("origin"), "category")


@query("SELECT id, rel_path, round(gps_lat, 7) AS lat, round(gps_lon, 7) AS lon FROM f WHERE kind <> 'archive' AND gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND NOT (gps_lat = 0 AND gps_lon = 0)")
def k12_media_locations(spark, folder):
    return reports.location_points(files(spark, folder, "kind", "rel_path", "gps_lat", "gps_lon").where("kind <> 'archive'"))


@query("SELECT e.set_name, e.store, count(DISTINCT (e.algo, e.value)) AS entries, coalesce(any_value(h.n), 0) AS matched FROM entries e LEFT JOIN (SELECT set_name, store, count(DISTINCT id) AS n FROM hits GROUP BY 1, 2) h ON h.set_name = e.set_name AND h.store = e.store GROUP BY 1, 2")
def k15_known_sets(spark, folder):
    e = entries(spark, folder)
    n = e.groupBy("set_name", "store").agg(F.countDistinct("algo", "value").alias("entries"))
    m = _hits(spark, folder).groupBy("set_name", "store").agg(F.countDistinct("id").alias("matched"))
    return n.join(m, ["set_name", "store"], "left").select("set_name", "store", "entries", F.coalesce("matched", F.lit(0)).alias("matched"))


@query("SELECT h.id, h.set_name, h.algo AS via, f.path FROM hits h JOIN f ON f.id = h.id WHERE f.kind <> 'archive'")
def k20_hash_set_hits(spark, folder):
    return _hits(spark, folder).join(files(spark, folder, "kind", "path").where("kind <> 'archive'").select("id", "path"), "id").select("id", "set_name", F.col("algo").alias("via"), "path")


@query("SELECT r.media_id, r.md5, e.name AS first_property FROM r LEFT JOIN (SELECT media_id, arg_min(name, (hashset_id, seq, name)) AS name FROM (SELECT DISTINCT x.hashset_id, x.media_id, x.seq, n.name FROM vic_media_exif x JOIN vic_exif_names n ON n.id = x.name_id WHERE x.media_id <> 0) GROUP BY 1) e ON e.media_id = r.media_id")
def j03_record_details(spark, folder):
    x = table(spark, folder, "vic_media_exif").where("media_id <> 0").join(table(spark, folder, "vic_exif_names").select(F.col("id").alias("name_id"), "name"), "name_id")
    first = x.groupBy("media_id").agg(F.min(F.struct("hashset_id", "seq", "name")).alias("x")).select("media_id", F.col("x.name").alias("first_property"))
    return records(spark, folder).select("media_id", "md5").join(first, "media_id", "left")


@query("SELECT f.container_id, count(*) AS n FROM f LEFT JOIN f g ON g.id = f.id AND g.origin IS DISTINCT FROM 'carve' WHERE f.container_id IS NOT NULL AND (g.id IS NULL OR g.size <> f.size + CASE WHEN f.kind = 'other' THEN 1 ELSE 0 END) GROUP BY 1")
def j12_archive_mismatches(spark, folder):
    """Members of an archive found missing or changed against what was recorded."""
    base = files(spark, folder, "container_id", "kind", "origin", "size").where(F.col("container_id").isNotNull()).select("id", "container_id", (F.col("size") + F.when(F.col("kind") == "other", 1).otherwise(0)).alias("size"))
    found = files(spark, folder, "container_id", "kind", "origin", "size").where(~F.col("origin").eqNullSafe("carve")).select("id", F.col("size").alias("now"))
    bad = base.join(found, "id", "left").where(F.col("now").isNull() | (F.col("now") != F.col("size")))
    return bad.groupBy("container_id").agg(F.count(F.lit(1)).alias("n"))


@query(""", c AS (SELECT n_name AS name, n_nationkey + n_nationkey % 3 AS code FROM nation WHERE n_nationkey % 2 = 0), s AS (SELECT n_name AS name, n_nationkey AS code FROM nation WHERE n_nationkey % 4 <> 1), t AS (SELECT max(code) AS top FROM (SELECT code FROM c UNION ALL SELECT code FROM s)),
x AS (SELECT s.name, s.code, c.code AS case_code, s.code IN (SELECT code FROM c) AS taken FROM s LEFT JOIN c ON c.name = s.name)
SELECT name, code, coalesce(case_code, CASE WHEN taken THEN top + row_number() OVER (PARTITION BY case_code IS NULL AND taken ORDER BY name) ELSE code END)::INTEGER AS new_code FROM x, t""")
def j15_saved_categories(spark, folder):
    """Saved categories put into a case: an equal name keeps the case's code, a free code stays, else a new one.

    Nations stand in: those of even number are the case's categories, under other letter case and codes.
    """
    nation = table(spark, folder, "nation")
    saved = nation.where("n_nationkey % 4 <> 1").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    case = nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("case_name"), (F.col("n_nationkey") + F.col("n_nationkey") % 3).alias("case_code"))
    rows = saved.join(case, F.lower(F.trim("name")) == F.lower(F.trim("case_name")), "left").join(case.select(F.col("case_code").alias("code"), F.lit(True).alias("taken")).distinct(), "code", "left")
    top = saved.select("code").unionByName(case.select(F.col("case_code").alias("code"))).agg(F.max("code").alias("top"))
    # Categories are few: numbering the clashes is one small task.
    clash = rows.where(F.col("case_code").isNull() & F.col("taken")).select("name", F.row_number().over(Window.orderBy("name")).alias("k"))
    rows = rows.join(clash, "name", "left").join(F.broadcast(top))
    return rows.select("name", "code", F.coalesce("case_code", F.when(F.col("k").isNotNull(), F.col("top") + F.col("k")), "code").alias("new_code"))


def marker_clusters(points: DataFrame, pixels: float, zoom: int) -> DataFrame:
    """(id, cluster): markers of a map chained together by distances of at most some pixels.

    Markers of one small cell are near without being compared, so a busy place costs as many links as it has markers;
    only markers of neighbouring cells are compared. Markers at one pixel position count as one.
    """
    x, y = S.mercator_pixel(F.col("lat"), F.col("lon"), zoom)
    at = points.select("id", x.alias("x"), y.alias("y"))
    side = pixels / 2**0.5 * 0.999999  # any two markers of one cell are near enough
    spots = at.groupBy("x", "y").agg(F.min("id").alias("head"))
    cell = spots.select("head", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    tops = cell.groupBy("cx", "cy").agg(F.min("head").alias("a"))
    own = cell.join(tops, ["cx", "cy"]).where(F.col("a") != F.col("head")).select("a", F.col("head").alias("b"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1, 2) for j in range(-2, 3) if (i, j) > (0, 0)])
    other = cell.select(F.col("head").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(near).alias("n")).select("b", "x2", "y2", (F.col("cx") + F.col("n.i")).alias("cx"), (F.col("cy") + F.col("n.j")).alias("cy"))
    across = cell.join(other, ["cx", "cy"]).where((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= pixels**2)
    groups = connected_components(own.unionByName(across.select(F.col("head").alias("a"), "b"))).select(F.col("id").alias("head"), F.col("head").alias("top"))
    return at.join(spots, ["x", "y"]).join(groups, "head", "left").select("id", F.coalesce("top", "head").alias("cluster"))


@query()
def x15_marker_clusters(spark, folder):
    return marker_clusters(reports.location_points(files(spark, folder, "rel_path", "gps_lat", "gps_lon")).where(F.abs("lat") < 85), 7.0, 6)


SQL["x15_marker_clusters"] = _WITH.replace("WITH f", "WITH RECURSIVE f", 1) + """, p AS (SELECT id, (round(gps_lon, 7) + 180.0) / 360.0 * 16384.0 AS x, (0.5 - ln((1 + sin(radians(round(gps_lat, 7)))) / (1 - sin(radians(round(gps_lat, 7))))) / (4 * pi())) * 16384.0 AS y FROM f
WHERE gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND NOT (gps_lat = 0 AND gps_lon = 0) AND abs(round(gps_lat, 7)) < 85),
e AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 49), w(id, top) AS (SELECT a, a FROM e UNION SELECT e.b, w.top FROM w JOIN e ON e.a = w.id) SELECT id, min(top) AS cluster FROM w GROUP BY id"""


# --- record details and documents ---------------------------------------------------------------------
@query("SELECT DISTINCT hashset_id, media_id, seq, value, CASE WHEN lower(trim(value)) IN ('true', '1') THEN 257 WHEN lower(trim(value)) IN ('false', '0') THEN 1 END AS packed FROM vic_media_exif")
def c13_record_flags(spark, folder):
    rows = table(spark, folder, "vic_media_exif").select("hashset_id", "media_id", "seq", "value").distinct()
    return rows.withColumn("packed", D.pack_flags([D.truth(F.col("value")), F.lit(None).cast("boolean")]))


@query("""SELECT id, CASE WHEN m AND try_cast(d AS DATE) IS NOT NULL AND try_cast(c AS TIME) IS NOT NULL THEN d || 'T' || c || CASE WHEN length(o) = 5 THEN left(o, 3) || ':' || right(o, 2) ELSE o END END AS iso FROM (SELECT id, regexp_full_match(trim(created_dt), '[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}([+-][0-9]{2}:?[0-9]{2})?|[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AS m,
replace(left(trim(created_dt), 10), ':', '-') AS d, substr(trim(created_dt), 12, 8) AS c, substr(trim(created_dt), 20) AS o FROM f)""")
def c09_exif_dates(spark, folder):
    return files(spark, folder, "created_dt").select("id", D.exif_date(F.col("created_dt")).alias("iso"))


def _descent(z: int) -> str:
    """SQL of the curve's descent: one view per level, each halving the square and turning the quadrant."""
    views = []
    for k in range(z):
        b, m = z - 1 - k, (1 << (z - 1 - k)) - 1
        bx, by, x, y = f"((px >> {b}) & 1)", f"((py >> {b}) & 1)", f"(px & {m})", f"(py & {m})"
        turned = lambda own, other: f"CASE WHEN {by} = 1 THEN {own} WHEN {bx} = 1 THEN {m} - {other} ELSE {other} END"  # noqa: B023, E731
        views.append(f"h{k + 1} AS (SELECT id, x, y, d + {1 << 2 * b}::BIGINT * xor(3 * {bx}, {by}) AS d, {turned(x, y)} AS px, {turned(y, x)} AS py FROM h{k})")
    return ", ".join(views)


_ZOOM = 10
_MERCATOR_ROW = "(0.5 - ln((1 + sin(radians(gps_lat))) / (1 - sin(radians(gps_lat)))) / (4 * pi()))"


@query(f""", h0 AS (SELECT id, x, y, 0::BIGINT AS d, x AS px, y AS py FROM (SELECT id, least({(1 << _ZOOM) - 1}, floor((gps_lon + 180) / 360 * {1 << _ZOOM}))::INTEGER AS x, floor({_MERCATOR_ROW} * {1 << _ZOOM})::INTEGER AS y FROM f WHERE gps_lat BETWEEN -80 AND 80 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lon))),
{_descent(_ZOOM)} SELECT id, x, y, ((1::BIGINT << {2 * _ZOOM}) - 1) // 3 + d AS tile FROM h{_ZOOM}""")
def c11_tile_ids(spark, folder):
    """The number on the curve of the tile that every position lies in."""
    rows = files(spark, folder, "gps_lat", "gps_lon").where("gps_lat BETWEEN -80 AND 80 AND gps_lon BETWEEN -180 AND 180")
    px, py = S.mercator_pixel(F.col("gps_lat"), F.col("gps_lon"), _ZOOM)
    at = rows.select("id", F.least(F.floor(px / 256), F.lit((1 << _ZOOM) - 1)).cast("int").alias("x"), F.floor(py / 256).cast("int").alias("y"))
    return at.withColumn("tile", D.tile_id(_ZOOM, F.col("x"), F.col("y")))


@query("""SELECT id, total, CASE WHEN total > 0 THEN array_to_string(list_distinct_sorted, ',') END AS picks FROM (SELECT id, total, list_sort(list_distinct(list_transform(range(least(6, total)), lambda i: floor(i * (total - 1) / greatest(least(6, total) - 1, 1)::DOUBLE)::BIGINT))) AS list_distinct_sorted
FROM (SELECT id, floor(duration)::BIGINT AS total FROM f WHERE kind = 'video'))""")
def c18_frame_picks(spark, folder):
    """Six frames of every film of one frame a second."""
    rows = files(spark, folder, "kind", "duration").where("kind = 'video'").select("id", F.floor("duration").cast("long").alias("total"))
    picks = D.frame_picks(F.col("total"), 6)
    return rows.select("id", "total", F.when(picks.isNotNull(), F.array_join(picks.cast("array<string>"), ",")).alias("picks"))


_FAMILIES = ("Composite", "EXIF", "MakerNotes", "XMP", "IPTC", "QuickTime", "PNG", "Odd")


@query("""SELECT DISTINCT hashset_id, media_id, seq, name_id, CASE name_id % 8 WHEN 0 THEN 'composite' WHEN 1 THEN CASE WHEN seq % 2 = 0 THEN 'gps' ELSE 'exif' END ELSE CASE WHEN seq % 2 = 0 THEN 'gps' ELSE CASE name_id % 8 WHEN 2 THEN 'makernotes' WHEN 3 THEN 'xmp' WHEN 4 THEN 'iptc' WHEN 5 THEN 'video' WHEN 6 THEN 'file' ELSE 'other' END END END AS category
FROM vic_media_exif WHERE name_id IS NOT NULL AND seq IS NOT NULL AND name_id >= 0""")
def c25_tag_categories(spark, folder):
    """Families by the number of the property, groups by the place of the row, a stand-in."""
    rows = table(spark, folder, "vic_media_exif").where("name_id >= 0 AND seq IS NOT NULL").select("hashset_id", "media_id", "seq", "name_id").distinct()
    family = F.element_at(F.array(*map(F.lit, _FAMILIES)), (F.col("name_id") % 8 + 1).cast("int"))
    return rows.withColumn("category", D.tag_category(family, F.when(F.col("seq") % 2 == 0, "GPS").otherwise("IFD0")))


@query("SELECT id, CASE category WHEN 0 THEN 'Non-pertinent' WHEN 1 THEN 'Pertinent - other evidence' WHEN 2 THEN 'Needs review' WHEN 3 THEN 'Skipped' END AS label FROM f")
def c27_triage_labels(spark, folder):
    code = F.element_at(F.array(*[F.lit(c) for c in (*D.TRIAGE, "x")]), F.least(F.coalesce("category", F.lit(4)), F.lit(4)) + 1)
    return files(spark, folder, "category").select("id", D.triage_label(code).alias("label"))


@query("SELECT id, lower(hex(encode(substr(ext, 2, 16)))) AS bytes FROM f")
def c28_hex_slice(spark, folder):
    return files(spark, folder, "ext").select("id", D.hex_slice(F.encode("ext", "UTF-8"), 1, 4).alias("bytes"))


_ITEM = "lpad((id % 100000)::VARCHAR, 5, '0')"


@query(f"""SELECT id, name, CASE id % 6 WHEN 0 THEN 'page ' || (id % 10000) WHEN 1 THEN 'an image no page draws' WHEN 2 THEN CASE WHEN kind = 'image' THEN 'attached file (' || kind || ' a.jpg)' ELSE 'attached file' END WHEN 3 THEN 'embedded in the page (data: URI)'
WHEN 4 THEN 'a resource saved with the page (' || kind || '_x.gif)' END AS place, CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 < 2 AND category IS NULL THEN 'rebuilt from the PDF''s pixels as a PNG; its hashes are not an original file''s' ELSE 'byte for byte' END AS copy
FROM (SELECT *, CASE id % 6 WHEN 0 THEN 'p' || lpad((id % 10000)::VARCHAR, 4, '0') || '_obj' || {_ITEM} || CASE WHEN category IS NULL THEN '_rebuilt' ELSE '' END || '.png' WHEN 1 THEN 'x/unused_obj' || {_ITEM} || CASE WHEN category IS NULL THEN '_rebuilt' ELSE '' END || '_2.png'
WHEN 2 THEN 'attachment_obj' || {_ITEM} || CASE WHEN kind = 'image' THEN '_' || kind || ' a.jpg' ELSE '.bin' END WHEN 3 THEN 'data_uri_' || lpad((id % 10000)::VARCHAR, 4, '0') || '.png' WHEN 4 THEN lpad((id % 10000)::VARCHAR, 4, '0') || '_' || kind || '_x.gif' ELSE 'plain_' || id || '.jpg' END AS name FROM f WHERE kind IS NOT NULL)""")
def s19_place_in_document(spark, folder):
    """Names written by the scheme of extracted items, from the number of each file, and read back."""
    own, number = F.lpad((F.col("id") % 100_000).cast("string"), 5, "0"), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0")
    rebuilt = F.when(F.col("category").isNull(), "_rebuilt").otherwise("")
    which = F.col("id") % 6
    name = (
        F.when(which == 0, F.concat(F.lit("p"), number, F.lit("_obj"), own, rebuilt, F.lit(".png"))).when(which == 1, F.concat(F.lit("x/unused_obj"), own, rebuilt, F.lit("_2.png")))
        .when(which == 2, F.concat(F.lit("attachment_obj"), own, F.when(F.col("kind") == "image", F.concat(F.lit("_"), "kind", F.lit(" a.jpg"))).otherwise(".bin"))).when(which == 3, F.concat(F.lit("data_uri_"), number, F.lit(".png")))
        .when(which == 4, F.concat(number, F.lit("_"), "kind", F.lit("_x.gif"))).otherwise(F.concat(F.lit("plain_"), "id", F.lit(".jpg")))
    )
    box = F.when(which < 3, ".PDF").when(which == 3, ".html").otherwise(".mht")
    rows = files(spark, folder, "kind", "category").where(F.col("kind").isNotNull()).select("id", name.alias("name"), box.alias("box"))
    return rows.select("id", "name", D.place_in_document(F.col("name"), F.col("box")).alias("place"), D.copy_in_document(F.col("name"), F.col("box")).alias("copy"))


__all__ = ["QUERIES", "SQL"]
