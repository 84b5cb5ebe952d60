import gzip
import hashlib
import io
import json
import sqlite3
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from caseloom.functions import names as N
from caseloom.operators import artifacts, edits
from caseloom.sources import ingest, readers


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in members.items():
            z.writestr(n, b)
    return out.getvalue()


def tarred(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for n, b in members.items():
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    return out.getvalue()


def test_ingest_of_folders_and_nested_containers(spark, tmp_path):
    inner = zipped({"deep/a.jpg": b"\xff\xd8\xff\xe0pic", "../evil.jpg": b"x", "__MACOSX/b.jpg": b"y"})
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n1234")
    (tmp_path / "x" / "._q.jpg").write_bytes(bytes.fromhex("00051607") + b"fork")
    (tmp_path / "noext").write_bytes(b"\xff\xd8\xff\xe0aaaa")
    (tmp_path / "box.zip").write_bytes(zipped({"in.tar": tarred({"m/c.mp4": b"movie", "n.zip": inner}), "one.txt.gz": gzip.compress(b"text")}))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 broken")
    spec = tmp_path / "job.json"
    spec.write_text(json.dumps({"CASE": "C", "Sources": [{"name": "s", "path": "."}, {"path": " "}]}))
    sources, meta = ingest.parse_sources(str(spec))
    assert meta == {"case": "C"} and [s.kind for s in sources] == ["folder"]
    rows = {r.path.rsplit("/", 1)[-1] if "!" not in r.path else r.path.split("!", 1)[1]: r for r in ingest.ingest(spark, sources).collect()}
    assert {k: r.kind for k, r in rows.items() if "!" not in k and "." in k}["p.png"] == "image" and rows["noext"].kind == "image" and "._q.jpg" not in rows
    assert rows["in.tar!n.zip!deep/a.jpg"].kind == "image" and rows["in.tar!m/c.mp4"].kind == "video" and "one.txt.gz!one.txt" in rows
    assert not any("evil" in k or "MACOSX" in k for k in rows) and rows["in.tar!m/c.mp4"].md5 == hashlib.md5(b"movie").hexdigest()
    heads = readers.scan_folder(spark, str(tmp_path), include_other=True)
    assert heads.where(F.col("mtime") > 0).count() == 6
    for bad in ("[]", '{"sources": []}', "no json"):
        spec.write_text(bad)
        with pytest.raises(ValueError):
            ingest.parse_sources(str(spec))


def test_archive_formats(spark):
    rows = [(0, zipped({"a": b"b"})), (1, tarred({"a": b"b"})), (2, gzip.compress(b"x")), (3, b""), (4, bytes.fromhex("455646090D0AFF00") + b"seg"), (5, None)]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "i int, b binary")
    assert [r.f for r in df.select("i", ingest.archive_format(F.substring("b", 1, 512)).alias("f")).orderBy("i").collect()] == ["zip", "tar", "tar-compressed", None, "ewf", None]


def test_hash_databases_and_json_lists(spark, tmp_path):
    path = tmp_path / "h.db"
    with sqlite3.connect(path) as db:
        db.execute("create table other (md5 text)")
        db.execute("create table FILE (md5 text, sha1 text, bytes int)")
        db.executemany("insert into FILE values (?, ?, ?)", [("A" * 32, "b" * 40, 5), ("a" * 32, None, 5), ("c" * 32, None, 0), ("odd", None, None)])
    assert sorted(map(tuple, ingest.read_hash_databases(spark, [str(path)]).collect())) == [("md5", "a" * 32), ("sha1", "b" * 40)]
    bodies = spark.createDataFrame([(1, '[{"MD5":"x"},2]'), (2, '{"media":[{"a":1}]}'), (3, '{"value":[1'), (4, None), (5, '{"k":1}')], "doc_id int, body string")
    assert sorted(map(tuple, ingest.record_array(bodies).collect())) == [(1, 0, '{"MD5":"x"}'), (1, 1, "2"), (2, 0, '{"a":1}')]


def test_names(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).head()[0]
    assert one(N.slug, "--My case: 1/2--") == "My-case-1-2" and one(N.slug, "///") == "archive"
    assert one(N.digest_name, "a/b.JPG").endswith(".jpg") and len(one(N.digest_name, "a/b.ver y")) == 40
    assert one(N.as_text, ' " x " ') == "x" and one(N.as_text, '{"Title":"T"}') == "T" and one(N.as_text, "3") == "3" and one(N.as_text, "null") is None and one(N.as_text, '{"q":1}') == '{"q":1}'
    assert one(N.scrub_paths, "cannot open '/evidence/my files/a.jpg': bad (C:\\x\\y.png)") == "cannot open: bad"
    assert one(N.scrub_paths, "ratio 3/4 of /one") == "ratio 3/4 of /one"
    assert one(N.mime_extension, "IMAGE/JPEG; q=1") == ".jpg" and one(N.content_name, "x/a.tar.gz") == "a.tar"


def test_upsert_and_edits(spark):
    files = spark.createDataFrame([(1, "a", 5, 1, 7.0), (2, "b", 6, None, 8.0)], "id long, path string, size long, category int, ingested_at double")
    new = spark.createDataFrame([("a", 9, None, 1), ("a", 8, None, 2), ("c", 3, None, 1), (None, 1, 1, 1)], "path string, size long, category int, seq int")
    got = {r.path: r for r in edits.upsert_files(files, new, F.lit(99.0)).collect()}
    assert (got["a"].size, got["a"].category, got["a"].ingested_at, got["a"].id) == (8, 1, 7.0, 1) and (got["c"].category, got["c"].ingested_at) == (5, 99.0) and got["c"].id > 2 and len(got) == 3
    categories = spark.createDataFrame([(1, "x", False, False), (2, "y", False, False), (5, "u", True, False)], "code int, name string, locked boolean, hidden boolean")
    _, left = edits.delete_category(files, categories, 1)
    assert {(r.code, r.hidden) for r in left.collect()} == {(1, True), (2, False), (5, False)}
    moved, left = edits.delete_category(files, categories, 1, to=2)
    assert {r.code for r in left.collect()} == {2, 5} and {r.category for r in moved.collect()} == {2, None}
    _, left = edits.delete_category(files, categories, 5, to=2)
    assert {r.code for r in left.collect()} == {1, 2, 5}
    changes = spark.createDataFrame([(1, "f", 1, True), (1, "f", 2, False), (2, "g", 1, True)], "file_id long, flag string, seq int, add boolean")
    assert edits.change_flags(spark.createDataFrame([(1, "f"), (1, "h")], "file_id long, flag string"), changes).count() == 2
    order = spark.createDataFrame([(2, 0), (1, 1), (5, 2)], "code int, position int")
    assert [r.code for r in edits.reorder_categories(categories.withColumn("position", F.col("code")), order).orderBy("position").collect()] == [5, 2, 1]
    with pytest.raises(ValueError):
        artifacts.write_report(files, "odd", "/nowhere")
