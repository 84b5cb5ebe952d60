from pyspark.sql import functions as F

from caseloom.operators import wide

NAMES = [(1, "Make", "make"), (2, "Width", "width"), (3, "ImageWidth", "width"), (4, "Flash", "flash"), (5, "FNumber", "f_number"), (6, "Exposure", "exposure_us"), (7, "Orientation", "orientation"), (8, "Other", None), (9, "ISO", "iso"), (2, "Width", "width")]


def pivot(spark, rows):
    r = spark.createDataFrame(rows, "hashset_id int, media_id long, seq int, name_id int, value string, field string")  # a clashing extra column
    n = spark.createDataFrame(NAMES, "id int, name string, field string").withColumn("value", F.lit("x"))
    return {(x.hashset_id, x.media_id): x for x in wide.pivot_attributes(r, n).collect()}


def test_first_readable_value_by_seq_over_all_names(spark):
    got = pivot(spark, [(1, 1, 5, 2, "100", None), (1, 1, 2, 3, "wide", None), (1, 1, 3, 3, "4,000 px", None), (1, 1, 3, 3, "4,000 px", None)])
    assert got[1, 1].width == 4000 and got[1, 1].make is None


def test_readable_forms(spark):
    cases = {
        (2, "3024.0"): ("width", 3024), (2, "3 264"): ("width", 3264), (2, "-1"): ("width", None), (2, "0"): ("width", None), (2, "NaN"): ("width", None), (2, "99999999999"): ("width", None),
        (9, "ISO1600"): ("iso", 1600), (9, "auto"): ("iso", None), (1, " Orvane\x00 "): ("make", "Orvane"), (1, " N/A "): ("make", None),
        (7, "6 (Rotate 90 CW)"): ("orientation", 6), (7, "ROTATE 270 CW"): ("orientation", 8), (7, "9"): ("orientation", None), (7, "up"): ("orientation", None),
        (4, "On, Fired"): ("flash", True), (4, "Flash did not fire"): ("flash", False), (4, "16"): ("flash", False), (4, "maybe"): ("flash", None),
        (6, "1/125"): ("exposure_us", 8000), (6, "0,1"): ("exposure_us", 100000), (6, "12.5 ms"): ("exposure_us", 12500), (6, "1/0"): ("exposure_us", None), (6, "bulb"): ("exposure_us", None),
    }
    rows = [(1, i, 1, n, v, None) for i, (n, v) in enumerate(cases)]
    got = pivot(spark, rows)
    for i, (field, want) in enumerate(cases.values()):
        assert got[1, i][field] == want, list(cases)[i]
    assert str(pivot(spark, [(1, 1, 1, 5, "f/1,85", None)])[1, 1].f_number) == "1.9"


def test_nulls_empty_and_unknown(spark):
    got = pivot(spark, [(None, 1, 1, 1, "a", None), (1, None, 1, 1, "a", None), (1, 2, None, 1, "late", None), (1, 2, 7, 1, "early", None), (1, 3, 1, 8, "x", None), (1, 3, 1, 99, None, None)])
    assert set(got) == {(1, 2), (1, 3)} and got[1, 2].make == "early" and got[1, 3].make is None
    assert pivot(spark, []) == {}


def test_long_text_and_hot_entity(spark):
    rows = [(1, 1, i, 1, None, None) for i in range(3000)] + [(1, 1, 5000, 1, "y" * 200_000, None)]
    assert len(pivot(spark, rows)[1, 1].make) == 200_000
