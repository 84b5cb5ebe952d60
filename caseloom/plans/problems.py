"""Queries over the case tables for the core training-data operators (problems 1, 2, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instants, nearby, nested, wide
from ..session import small, table


def p1_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The wide table of all numbered media: one row per (hashset_id, media_id)."""
    rows = table(spark, folder, "vic_media_exif").where(F.col("media_id") != 0)
    return wide.pivot_attributes(rows, table(spark, folder, "vic_exif_names"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return wide.unpivot_filled(p1_wide(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    files, regions = table(spark, folder, "files"), table(spark, folder, "map_regions")
    near = nearby.near_pairs(files).select(F.lit("near").alias("kind"), "left_id", "right_id")
    return near.unionByName(nearby.points_in_regions(files, regions).select(F.lit("in").alias("kind"), "left_id", "right_id"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.VariantTables(table(spark, folder, "vic_raw"), ("exif",)).supertype("exif", F.col("prop"))


def p6_cases(spark: SparkSession, folder: str) -> DataFrame:
    return nested.case_table(table(spark, folder, "vic_raw"))


def p6_media(spark: SparkSession, folder: str) -> DataFrame:
    return nested.media_table(table(spark, folder, "vic_raw"))


def p6_exif(spark: SparkSession, folder: str) -> DataFrame:
    return nested.exif_table(table(spark, folder, "vic_raw"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "sources").where(F.col("source").isNotNull()).groupBy("source").agg(F.min("device_zone").alias("zone"))
    zones = instants.known_zones(sources, "zone")
    files = table(spark, folder, "files").select(F.lit("files").alias("tab"), F.col("id").alias("rec_id"), "source", F.lit("created_dt").alias("field"), F.col("created_dt").alias("value"))
    kinds = ("fs_created", "fs_modified", "fs_accessed")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in kinds]))
    records = table(spark, folder, "vic_records").select(F.lit("vic_records").alias("tab"), F.col("media_id").alias("rec_id"), "source", cells.alias("c")).select("tab", "rec_id", "source", "c.*")
    values = files.unionByName(records).where(F.col("value").isNotNull())
    values = values.join(small(sources, 50_000), "source", "left")
    found = instants.to_instants(values, instants.interval_table(spark, zones + instants.zones_named_in(values)))
    return found.select("tab", "rec_id", "field", "epoch_ms").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p2_found, p6_found, p6_cases, p6_media, p6_exif, p7_found)}

def _as_list(v: str) -> str:
    """SQL of a list written as an array, as its only object, or as JSON text of either; anything else is empty."""
    inner = f"ltrim({v} ->> '$', chr(65279))"
    read = f"CASE WHEN json_valid({inner}) THEN CASE json_type({inner}) WHEN 'ARRAY' THEN {inner}::JSON WHEN 'OBJECT' THEN json_array({inner}::JSON) ELSE '[]'::JSON END ELSE '[]'::JSON END"
    return f"CASE json_type({v}) WHEN 'ARRAY' THEN {v} WHEN 'OBJECT' THEN json_array({v}) WHEN 'VARCHAR' THEN {read} ELSE '[]'::JSON END"


def _member(name: str, of: str, keys: str, rest: str = "") -> str:
    """SQL of the first member of a name, in any letter case, of the objects ``o`` of a view."""
    return f"SELECT {keys}, e.value AS v{rest} FROM {of}, json_each(o) e WHERE lower(e.key) = '{name}' QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY e.id) = 1"


_SHRED = f"""WITH docs AS (SELECT raw_id, ltrim(body, chr(65279))::JSON AS o FROM (SELECT DISTINCT raw_id, body FROM vic_raw WHERE raw_id IS NOT NULL AND body IS NOT NULL) WHERE json_valid(ltrim(body, chr(65279))) AND json_type(CASE WHEN json_valid(ltrim(body, chr(65279))) THEN ltrim(body, chr(65279)) ELSE 'null' END) = 'OBJECT'),
top AS ({_member("value", "docs", "raw_id")}), cases AS (SELECT raw_id, e.key::INTEGER AS case_pos, e.value AS o FROM (SELECT raw_id, {_as_list("v")} AS l FROM top), json_each(l) e WHERE json_type(e.value) = 'OBJECT'),
held AS ({_member("media", "cases", "raw_id, case_pos")}), listed AS (SELECT raw_id, case_pos, e.key::INTEGER AS media_pos, e.value AS o FROM (SELECT raw_id, case_pos, {_as_list("v")} AS l FROM held), json_each(l) e WHERE json_type(e.value) = 'OBJECT'),
media AS (SELECT *, 'listed' AS variant FROM listed UNION ALL SELECT raw_id, case_pos, 0, o, 'bare' FROM cases ANTI JOIN held USING (raw_id, case_pos)),
tagged AS ({_member("exifs", "media", "raw_id, case_pos, media_pos")}), exif AS (SELECT raw_id, case_pos, media_pos, e.key::INTEGER AS exif_pos, e.value AS o FROM (SELECT raw_id, case_pos, media_pos, {_as_list("v")} AS l FROM tagged), json_each(l) e WHERE json_type(e.value) = 'OBJECT'),
named AS ({_member("propertyname", "exif", "raw_id, case_pos, media_pos, exif_pos")})"""


_USABLE = "gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND NOT (gps_lat = 0 AND gps_lon = 0)"
SQL = {
    "p2_found": f"""WITH p AS (SELECT DISTINCT id, gps_lat, gps_lon, 6371000 * cos(radians(gps_lat)) * cos(radians(gps_lon)) AS x, 6371000 * cos(radians(gps_lat)) * sin(radians(gps_lon)) AS y, 6371000 * sin(radians(gps_lat)) AS z FROM files WHERE {_USABLE}),
c AS (SELECT *, floor(x / 200) AS cx, floor(y / 200) AS cy, floor(z / 200) AS cz FROM p), o AS (SELECT a.r AS i, b.r AS j, c.r AS k FROM range(-1, 2) a(r), range(-1, 2) b(r), range(-1, 2) c(r)), n AS (SELECT c.*, cx + i AS nx, cy + j AS ny, cz + k AS nz FROM c, o),
near AS (SELECT n.id AS l, c.id AS r FROM n JOIN c ON c.cx = n.nx AND c.cy = n.ny AND c.cz = n.nz WHERE n.id < c.id AND (n.x - c.x) ** 2 + (n.y - c.y) ** 2 + (n.z - c.z) ** 2 <= (2 * 6371000 * sin(150 / (2 * 6371000.0))) ** 2),
v AS (SELECT DISTINCT region_id, i, len(ring) AS m, ring[i].lat AS a, ring[i].lon AS o, ring[i % len(ring) + 1].lat AS b, ring[i % len(ring) + 1].lon AS q FROM map_regions, LATERAL (SELECT unnest(range(1, len(ring) + 1)) AS i) u),
w AS (SELECT region_id, i, a, b, q - o - 360 * floor((q - o + 180) / 360) AS d, o FROM v),
e AS (SELECT region_id, a, b, first_value(o) OVER k + coalesce(sum(d) OVER (PARTITION BY region_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, d FROM w WINDOW k AS (PARTITION BY region_id ORDER BY i)),
t AS (SELECT p.id, e.region_id, s.r AS turn, count(*) AS n FROM p, e, (SELECT unnest([-360, 0, 360]) AS r) s WHERE (e.o > p.gps_lon + s.r) <> (e.o + e.d > p.gps_lon + s.r) AND p.gps_lat < (e.b - e.a) * (p.gps_lon + s.r - e.o) / e.d + e.a GROUP BY ALL)
SELECT 'near' AS kind, l AS left_id, r AS right_id FROM near UNION ALL SELECT DISTINCT 'in', id, region_id::BIGINT FROM t WHERE n % 2 = 1""",
    "p6_found": _SHRED + " SELECT * FROM (SELECT raw_id, case_pos, media_pos, exif_pos, trim(v ->> '$', ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(0) || chr(160)) AS prop FROM named WHERE json_type(v) = 'VARCHAR') WHERE prop <> ''",
    "p6_media": _SHRED + ", m AS (SELECT raw_id, case_pos, media_pos, variant, lower(e.key) AS k, e.value AS v FROM media, json_each(o) e QUALIFY row_number() OVER (PARTITION BY raw_id, case_pos, media_pos, lower(e.key) ORDER BY e.id) = 1) SELECT raw_id, case_pos, media_pos, variant, "
    + ", ".join(f"max(CASE WHEN k = '{m}' THEN v ->> '$' END) AS {c}" for c, m in nested.MEDIA_MEMBERS.items())
    + " FROM (SELECT * FROM m UNION ALL SELECT raw_id, case_pos, media_pos, variant, '', NULL FROM media) GROUP BY raw_id, case_pos, media_pos, variant",
    "p6_cases": _SHRED + ", m AS (SELECT raw_id, case_pos, lower(e.key) AS k, e.value AS v FROM cases SEMI JOIN held USING (raw_id, case_pos), json_each(o) e QUALIFY row_number() OVER (PARTITION BY raw_id, case_pos, lower(e.key) ORDER BY e.id) = 1) SELECT raw_id, case_pos, "
    + ", ".join(f"max(CASE WHEN k = '{m}' THEN v ->> '$' END) AS {c}" for c, m in nested.CASE_MEMBERS.items())
    + " FROM m GROUP BY raw_id, case_pos",
}
SQL["g09_case_summary"] = (
    f"SELECT m.raw_id, c.case_id, c.case_number, c.application, m.media_count FROM (SELECT raw_id, count(*) AS media_count FROM ({SQL['p6_media']}) GROUP BY 1) m "
    f"LEFT JOIN (SELECT * FROM ({SQL['p6_cases']}) QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY case_pos) = 1) c ON c.raw_id = m.raw_id"
)
