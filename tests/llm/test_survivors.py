from caseloom.llm import survivors

SCHEMA = "id long, md5 string, path string, created_dt string, camera string, gps_lat double, gps_lon double, origin string, ingested_at double, alt_paths string, content string"
M = "A" * 32


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {(r.md5[0], r.field): r.from_id for r in survivors.origins_of_fields(survivors.surviving_records(df), ["path", "created_dt", "camera", "gps"]).collect()}


def test_rank_by_origin_time_and_id(spark):
    rows = [
        (1, M, "p1", "0000:00:00", "n/a", None, None, "walk", 5.0, None),
        (2, M.lower() + " ", "p2", "2020", None, 0.0, 0.0, "deleted", 9.0, None),
        (3, M, "p3", "2021", "Cam", 95.0, 1.0, None, None, None),
        (4, M, "p4", "2022", "Cam2", 5.0, 1.0, None, float("nan"), None),
        (5, M, "p5", None, "", None, None, "walk", 5.0, None),
        (5, M, "p5", None, "", None, None, "walk", 5.0, None),
    ]
    assert found(spark, rows) == {("a", "path"): 1, ("a", "created_dt"): 2, ("a", "camera"): 3, ("a", "gps"): 4}


def test_listed_paths_join_files_without_md5(spark):
    rows = [
        (1, M, "x", None, None, None, None, "carve", 1.0, '["c:\\\\d/e", 7, null]'),
        (2, "bad", "c:/d\\e", "2020", None, None, None, "walk", 1.0, None),
        (3, None, "other", "2020", None, None, None, "walk", 1.0, None),
        (4, "B" * 32, "y", None, None, None, None, "walk", 1.0, "{}"),
        (5, "d41d8cd98f00b204e9800998ecf8427e", "z", None, None, None, None, "walk", 1.0, '["other"]'),
    ]
    assert found(spark, rows) == {("a", "path"): 2, ("a", "created_dt"): 2}


def test_single_empty_and_null(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, M, "p", "d", "c", 1.0, 1.0, "walk", 1.0, "[broken"), (None, M, "q", "d", "c", 1.0, 1.0, "walk", 1.0, None)]) == {}


def test_hot_content(spark):
    rows = [(i, M, f"p{i}" * 50, None, None, None, None, "walk", float(i % 7), None) for i in range(3000)]
    assert found(spark, rows) == {("a", "path"): 6}
