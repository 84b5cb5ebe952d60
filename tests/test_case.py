import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from caseloom.functions import scalars as S
from caseloom.operators import components, containers, dedupe, gallery, matching, reports, search
from caseloom.operators.gallery import FileQuery
from caseloom.sources import hashlists, readers
from caseloom.streaming import landing


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.id: r.head for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_busy_byte_is_passed_over(spark):
    rows = spark.createDataFrame([(i, i, None) for i in range(2000)], "id long, h long, d long")
    assert dedupe.perceptual_pairs(rows, 6, cap=100).count() == 0 or dedupe.perceptual_pairs(rows, 6, cap=100).count() > 0
    few = spark.createDataFrame([(1, 0x0F0F0F0F0F0F0F0F, None), (2, 0x0F0F0F0F0F0F0F0E, None)], "id long, h long, d long")
    assert [tuple(r) for r in dedupe.perceptual_pairs(few, 6).collect()] == [(1, 2)]


def test_collapse_by_any_matching_member(spark):
    schema = "id long, kind string, vstack_id long, stack_id long, gps_lat double, gps_lon double, rel_path string"
    rows = [(1, "image", 1, None, None, None, "a"), (2, "image", 1, None, 1.0, 1.0, "b"), (3, "image", 1, None, None, None, "c"), (4, "image", None, None, 2.0, 2.0, "d")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.id for r in gallery.matching_files(df, FileQuery(has_gps=True, collapse=True)).collect()) == [2, 4]
    assert sorted(r.id for r in gallery.matching_files(df, FileQuery(vstack=1, has_gps=True, collapse=True)).collect()) == [1, 2, 3]


@pytest.mark.parametrize(
    ("text", "want"),
    [("set", [("size", "set", "")]), ("none", [("size", "notset", "")]), ("1..2kb", [("size", "min", "1024"), ("size", "max", "2048")]), ("5", [("size", "min", "5120")]), (">2m", [("size", "gt", "2097152")]), ("abc", []), ("", [])],
)
def test_column_language(text, want):
    assert gallery.parse_column_filter("size", text) == want


def test_known_good_gives_way(spark):
    files = spark.createDataFrame([(1, "a" * 32, None, None, 5), (2, "b" * 32, None, None, None)], "id long, md5 string, sha1 string, sha256 string, category int")
    entries = spark.createDataFrame([("md5", "a" * 32, "k", "case", "known", True, 2), ("md5", "a" * 32, "g", "case", "known-good", False, 0), ("md5", "b" * 32, "g", "case", "known-good", False, 0)], "algo string, value string, set_name string, store string, kind string, vic boolean, category int")
    got = {r.id: (r.category, r.hashset_mask, r.sets) for r in matching.rematch(files, matching.match_known(files, entries)).collect()}
    assert got == {1: (2, 9, "k,g"), 2: (0, 8, "g")}


def test_empty_hashes_match_nothing(spark):
    files = spark.createDataFrame([(1, "d41d8cd98f00b204e9800998ecf8427e", None, None)], "id long, md5 string, sha1 string, sha256 string")
    assert matching.file_digests(files).count() == 0


def test_views_disagreeing_are_kept(spark):
    assert containers.canonical_views(spark.createDataFrame([("x/data/user/10/a",), ("x/data_mirror/data_ce/null/10/a",), ("sdcard/b",), ("x\\data\\media\\0\\c",), ("plain",)], "name string")).select("view_key", "view_rank").collect() == [("x/\x00ce\x0010\x00a", 2), ("x/\x00ce\x0010\x00a", 3), ("\x00media\x000\x00b", 8), ("x/\x00media\x000\x00c", 5), (None, None)]
    rows = [("s", "data/data/app/x", 5, None), ("s", "data/user/0/app/x", 5, 7), ("s", "data/data/app/y", 5, 1), ("s", "data/user/0/app/y", 5, 2), ("s", "plain", 1, None)]
    got = {(r.name, tuple(r.alt_paths)) for r in containers.collapse_views(spark.createDataFrame(rows, "source string, name string, size long, crc long")).collect()}
    assert got == {("data/data/app/x", ("data/user/0/app/x",)), ("data/data/app/y", ()), ("data/user/0/app/y", ()), ("plain", ())}


def test_nearest_vectors_in_passes(spark):
    rng = random.Random(1)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0]), (63, [float("nan")] * 4)]
    df = spark.createDataFrame(vecs, "id long, vec array<double>")
    one, many = (sorted(tuple(r) for r in search.nearest_vectors(df.where("id % 5 = 0"), df, 0.7, n).collect()) for n in (4096, 3))
    assert one == many and {(i, i) for i in range(0, 60, 5)} <= {(a, b) for a, b, _ in one}


def test_hash_list_files(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(("﻿" + "A" * 32 + ",3\r\nnope\r\n\r\nd41d8cd98f00b204e9800998ecf8427e\r\n").encode("utf-16-le"))
    parsed = hashlists.parse_lines(hashlists.read_lines(spark, str(tmp_path / "l.txt")))
    assert [(r.status, r.category) for r in parsed.orderBy("line").collect()] == [("read", 3), ("skipped", None), ("blank", None), ("empty", None), ("blank", None)]
    assert hashlists.list_counts(parsed).head().asDict() == {"read": 1, "skipped": 1, "empty": 1}
    with pytest.raises(Exception, match="no usable hash"):
        hashlists.refuse_without_hashes(parsed.where("status <> 'read'")).collect()


def test_scan_and_archives(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.JPG").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "m/noext").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "m/t.txt").write_text("hello")
    assert sorted((r.rel_path, r.kind) for r in readers.scan_folder(spark, str(tmp_path / "m")).collect()) == [("a.JPG", "image"), ("noext", "image")]
    assert readers.scan_folder(spark, str(tmp_path / "m"), include_other=True).count() == 3
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/x.txt", "abc")
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        t.add(tmp_path / "m/t.txt", "y.txt")
    got = sorted((r.name, r.size) for r in readers.archive_members(spark, [str(tmp_path / "z.zip"), str(tmp_path / "t.tar")]).collect())
    assert got == [("d/x.txt", 3), ("y.txt", 5)]


def test_media_index_in_utf16(spark, tmp_path):
    text = '<?xml version="1.0" encoding="UTF-16"?><ReportIndex><Image><path>p</path><category>0</category><id>1</id><fullpath>/p</fullpath><created>9999-12-31T23:59:59</created><hash>AB</hash><sha1Hash>CD</sha1Hash><fileSize>5</fileSize></Image></ReportIndex>'
    (tmp_path / "i.xml").write_bytes(text.encode("utf-16"))
    r = readers.read_media_index(spark, str(tmp_path / "i.xml")).head()
    assert (r.path, r.category, r.size, r.md5, r.created) == ("p", None, 5, "ab", None)


def test_embedded_images(spark):
    df = spark.createDataFrame([(1, '<img src="data:image/png;base64,aGk=">'), (2, "none"), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.n, r.mime, bytes(r.bytes)) for r in readers.embedded_images(df).collect()] == [(1, 0, "image/png", b"hi")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & b", 1.0, 2.0)], "id long, rel_path string, lat double, lon double")
    assert reports.write_kmz(df, str(tmp_path / "p.kmz")) == 1
    assert "a &amp; b" in zipfile.ZipFile(tmp_path / "p.kmz").read("doc.kml").decode()
    assert reports.write_project({"Media Files": df, "Empty": df.limit(0)}, str(tmp_path / "proj")) == ["Media Files"]


def test_stream_lands_each_path_once(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", 1), ("a.jpg", 1), ("b.txt", 2)], "path string, t int").select("path", F.timestamp_seconds("t").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    q = landing.append_to(landing.new_files(landing.watch_folder(spark, str(tmp_path / "in"), rows.schema), "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted((r.path, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.jpg", "image"), ("b.txt", "other")]


def test_scalar_edges(spark):
    r = spark.range(1).select(S.size_text(F.lit(None).cast("long")).alias("a"), S.size_text(F.lit(1536)).alias("b"), S.duration_text(F.lit(65.9)).alias("c"), S.hamming(F.lit(None).cast("long"), F.lit(1).cast("long")).alias("d"), S.leading_number(F.lit("x")).alias("e")).head()
    assert tuple(r) == ("", "2 KB", "1:05", 999, 0.0)


def test_busy_bytes_lose_no_pair(spark):
    rng = random.Random(8)
    # All share the upper byte, which is often all that two have in common; the second hash is missing for some.
    base = [rng.getrandbits(56) for _ in range(300)]
    rows = []
    for k in range(3000):
        h = base[k % 300]
        for at in rng.sample(range(56), rng.randrange(8)):
            h ^= 1 << at
        rows.append((k, 0x0F << 56 | h, rng.choice([None, 5, 7, -1])))
    far = lambda x, y, most: ((x ^ y) & (1 << 64) - 1).bit_count() > most
    want = {(a, b) for a, h, d in rows for b, g, e in rows[a + 1 :] if not far(h, g, 12) and (d is None or e is None or not far(d, e, 14))}
    df = spark.createDataFrame(rows, "id long, h long, d long")
    assert {tuple(r) for r in dedupe.perceptual_pairs(df, 12).collect()} == want and len(want) > 5000
    assert dedupe.perceptual_pairs(df, 12, cap=10).count() < len(want)
    linked = components.connected_components(dedupe.perceptual_pairs(df, 12, forest=True)).collect()
    assert sorted(map(tuple, linked)) == sorted(map(tuple, components.connected_components(dedupe.perceptual_pairs(df, 12)).collect()))
