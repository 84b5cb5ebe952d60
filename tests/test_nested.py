import json

from caseloom.operators import nested


def shred(spark, *bodies):
    df = spark.createDataFrame([(i, b, "extra") for i, b in enumerate(bodies)], "raw_id long, body string, node string")
    return df


def exif(spark, *bodies):
    return sorted((r.raw_id, r.case_pos, r.media_pos, r.exif_pos, r.prop) for r in nested.exif_table(shred(spark, *bodies)).collect())


def test_shapes(spark):
    e = [{"PropertyName": " Make ", "PropertyValue": "x"}]
    full = {"value": [{"Media": [{"Exifs": e}, 7, {"EXIFS": json.dumps(e)}]}, None, {"Exifs": e[0]}]}
    assert exif(spark, json.dumps(full)) == [(0, 0, 0, 0, "Make"), (0, 0, 2, 0, "Make"), (0, 2, 0, 0, "Make")]
    assert exif(spark, "﻿" + json.dumps({"VALUE": json.dumps({"media": {"exifs": [None, {"propertyname": "A"}]}})})) == [(0, 0, 0, 1, "A")]
    assert exif(spark, json.dumps({"value": [{"Media": None, "Exifs": e}], "Exifs": e})) == []


def test_nothing_from_bad_bodies(spark):
    bad = [None, "", "null", "[]", "<html>", '{"value": [', '{"value": "no json"}', '{"value": 3}', json.dumps({"value": [{"Exifs": [{"PropertyName": " "}, {"PropertyName": None}, {"PropertyName": 5}, {}]}]}), "[" * 100_000]
    assert exif(spark, *bad) == []
    assert exif(spark) == []


def test_tables_keep_links(spark):
    body = json.dumps({"value": [{"CaseNumber": "C1", "Media": [{"MD5": "aa", "Exifs": [{"PropertyName": "P", "PropertyValue": {"Num": 1}}]}]}, {"MediaID": 4}]})
    df = shred(spark, body, body)
    assert sorted((r.raw_id, r.case_pos, r.case_number) for r in nested.case_table(df).collect()) == [(0, 0, "C1"), (1, 0, "C1")]
    assert sorted((r.raw_id, r.case_pos, r.media_pos, r.variant, r.md5, r.media_key) for r in nested.media_table(df).collect()) == [(i, *x) for i in (0, 1) for x in ((0, 0, "listed", "aa", None), (1, 0, "bare", None, "4"))]
    assert {(r.variant, r.value_json) for r in nested.exif_table(df).collect()} == {("object", '{"Num":1}')}


def test_variants_have_tables_of_their_own(spark):
    values = ["x", 2.5, True, [1], {"a": 1}, None]
    body = json.dumps({"value": [{"Media": [{"Exifs": [{"PropertyName": f"P{i}", "PropertyValue": v} for i, v in enumerate(values)] + [{"PropertyName": "P6"}]}]}]})
    tables = nested.VariantTables(shred(spark, body, body), keep=True)
    value = lambda k: sorted((r.raw_id, r.exif_pos, r.value) for r in tables.subtype("exif", k).collect())
    assert value("text") == [(i, 0, "x") for i in (0, 1)] and value("number") == [(i, 1, 2.5) for i in (0, 1)] and value("flag") == [(i, 2, True) for i in (0, 1)]
    assert [x[1] for x in value("null")] == [5, 6, 5, 6] and value("array")[0][2] == "[1]" and value("object")[0][2] == '{"a":1}'
    assert sum(t.count() for k, t in tables.subtypes().items() if k.startswith("exif")) == tables.supertype("exif").count() == 14
    assert {nested.shape_of("case", {}), nested.shape_of("case", {"media": 1}), nested.shape_of("record", {})} == {"object without media", "object with media", "object"}


def test_repeats_count_once_and_long_arrays(spark):
    body = json.dumps({"value": {"Media": {"Exifs": [{"PropertyName": f"P{i}"} for i in range(30_000)]}}})
    df = spark.createDataFrame([(1, body), (1, body)], "raw_id long, body string")
    assert nested.exif_table(df).count() == 30_000
