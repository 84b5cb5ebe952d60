"""Queries of the training-data operators over the case tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut, table
from . import clusters, groups, leaks, levels, survivors, tokens


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.similarity_clusters(table(spark, folder, "content_vecs")).select("file_id", "cluster_id")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "content_vecs")
    return clusters.describe_clusters(vectors, cut(clusters.similarity_clusters(vectors, with_degree=True).select("file_id", "cluster_id", "degree")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    records = survivors.surviving_records(table(spark, folder, "files"))
    return survivors.origins_of_fields(records, ["path", "created_dt", "camera", "gps"])


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.surviving_records(table(spark, folder, "files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.file_groups(table(spark, folder, "files"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return levels.reading_levels(table(spark, folder, "documents"), table(spark, folder, "level_labels")).select("doc_id", "level")


QUERIES = {f.__name__: f for f in (p3_found, p3_clusters, p4_found, p4_records, p5_found, p8_ids, p9_found, p10_found)}

_HEX = "regexp_full_match(lower(trim({c})), '[0-9a-f]{{{n}}}')"
_FILLED = "({c} IS NOT NULL AND lower(trim({c})) NOT IN ('', 'unknown', 'n/a', 'none', 'null', '-') AND trim({c}) NOT LIKE '0000%')"
_POSITION = "coalesce(gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT isnan(gps_lat) AND NOT isnan(gps_lon) AND NOT (gps_lat = 0 AND gps_lon = 0), false)"
SQL: dict[str, str] = {
    "p3_found": """WITH v AS (SELECT DISTINCT file_id, vec::DOUBLE[] AS vec FROM content_vecs WHERE len(vec) = 768 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
p AS (SELECT a.file_id AS x, b.file_id AS y FROM v a, v b WHERE list_cosine_similarity(a.vec, b.vec) >= 0.8 OR a.file_id = b.file_id)
SELECT x AS file_id, min(y) AS cluster_id FROM p GROUP BY x HAVING count(*) > 1""",
    "p3_clusters": """WITH v AS (SELECT DISTINCT file_id, vec::DOUBLE[] AS vec FROM content_vecs WHERE len(vec) = 768 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
p AS (SELECT a.file_id AS x, b.file_id AS y, list_cosine_similarity(a.vec, b.vec) AS c FROM v a, v b WHERE list_cosine_similarity(a.vec, b.vec) >= 0.8 OR a.file_id = b.file_id),
m AS (SELECT x, min(y) AS cluster_id, round(sum(c), 6) AS degree FROM p GROUP BY x HAVING count(*) > 1)
SELECT cluster_id, count(*) AS size, (list(x ORDER BY degree DESC, x))[1] AS medoid, (list(x ORDER BY degree DESC, x))[1:3] AS typical FROM m GROUP BY 1""",
    "p4_found": f"""WITH f AS (SELECT DISTINCT * FROM files), u AS (SELECT *, CASE WHEN {_HEX.format(c="md5", n=32)} AND lower(trim(md5)) <> 'd41d8cd98f00b204e9800998ecf8427e' THEN lower(trim(md5)) END AS content FROM f),
l AS (SELECT DISTINCT content, replace(p, chr(92), '/') AS at FROM (SELECT content, unnest(from_json(alt_paths, '["VARCHAR"]')) AS p FROM (SELECT * FROM u WHERE content IS NOT NULL AND json_valid(alt_paths) AND json_type(CASE WHEN json_valid(alt_paths) THEN alt_paths ELSE 'null' END) = 'ARRAY')) WHERE p IS NOT NULL),
m AS (SELECT content AS md5, id, path, created_dt, camera, gps_lat, gps_lon, origin, ingested_at FROM u WHERE content IS NOT NULL UNION ALL SELECT l.content, u.id, path, created_dt, camera, gps_lat, gps_lon, origin, ingested_at FROM u JOIN l ON replace(u.path, chr(92), '/') = l.at WHERE u.content IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY CASE origin WHEN 'walk' THEN 0 WHEN 'deleted' THEN 1 WHEN 'carve' THEN 2 ELSE 3 END, ingested_at DESC NULLS LAST, id) AS rk, count(*) OVER (PARTITION BY md5) AS n FROM m),
c AS (SELECT md5, 'path' AS field, id, rk FROM k WHERE n > 1 AND {_FILLED.format(c="path")} UNION ALL SELECT md5, 'created_dt', id, rk FROM k WHERE n > 1 AND {_FILLED.format(c="created_dt")} UNION ALL SELECT md5, 'camera', id, rk FROM k WHERE n > 1 AND {_FILLED.format(c="camera")} UNION ALL SELECT md5, 'gps', id, rk FROM k WHERE n > 1 AND {_POSITION})
SELECT md5, field, arg_min(id, rk) AS from_id FROM c GROUP BY 1, 2""",
    "p5_found": f"""WITH RECURSIVE f AS (SELECT DISTINCT id, stack_id, vstack_id, phash, dhash FROM files),
h AS (SELECT id, ('0x' || lower(trim(phash)))::UBIGINT AS h, CASE WHEN {_HEX.format(c="dhash", n=16)} THEN ('0x' || lower(trim(dhash)))::UBIGINT END AS d FROM f WHERE {_HEX.format(c="phash", n=16)}), g AS (SELECT * FROM h WHERE bit_count(h) BETWEEN 12 AND 52),
e0 AS (SELECT id AS a, stack_id AS b FROM f WHERE stack_id IS NOT NULL UNION SELECT id, vstack_id FROM f WHERE vstack_id IS NOT NULL
UNION SELECT x.id, y.id FROM g x, g y WHERE x.id < y.id AND CASE WHEN x.d IS NULL OR y.d IS NULL THEN bit_count(xor(x.h, y.h)) <= 2 ELSE bit_count(xor(x.h, y.h)) <= 6 AND bit_count(xor(x.d, y.d)) <= 8 END),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b), walk(id, top) AS (SELECT a, a FROM e UNION SELECT e.b, w.top FROM walk w JOIN e ON e.a = w.id),
c AS (SELECT w.id, min(w.top) AS head FROM walk w GROUP BY w.id), q AS (SELECT c.head, min(f.id) AS group_id, count(*) AS n FROM c JOIN f USING (id) GROUP BY 1) SELECT c.id AS file_id, q.group_id FROM c JOIN f USING (id) JOIN q USING (head) WHERE q.n > 1""",
}
