import datetime as dt
from zoneinfo import ZoneInfo

from caseloom.operators import instants

UTC = dt.timezone.utc


def ms(*a, **k):
    return int(dt.datetime(*a, tzinfo=UTC, **k).timestamp() * 1000)


def read(spark, rows):
    df = spark.createDataFrame([(i, v, z, "clash") for i, (v, z) in enumerate(rows)], "i int, value string, zone string, intervals string")
    table = instants.interval_table(spark, [z for _, z in rows if z])
    return {r.i: r.epoch_ms for r in instants.to_instants(df, table).collect()}


def test_notations(spark):
    cases = [
        ("2020-01-02T03:04:05Z", ms(2020, 1, 2, 3, 4, 5)), ("2020:01:02 03:04:05", ms(2020, 1, 2, 3, 4, 5)), ("2020-01-02T03:04:05.9999999+05:30", ms(2020, 1, 1, 21, 34, 5) + 999),
        ("20200102T030405", ms(2020, 1, 2, 3, 4, 5)), ("01/02/2020 03:04:05", ms(2020, 1, 2, 3, 4, 5)), ("1/2/2020 12:04:05 AM", ms(2020, 1, 2, 0, 4, 5)), ("1/2/2020 12:04:05 PM (UTC-3:30)", ms(2020, 1, 2, 15, 34, 5)),
        ("Thu, 02 Jan 2020 03:04:05 -0330", ms(2020, 1, 2, 6, 34, 5)), ("Jan 2, 2020 3:04:05 PM", ms(2020, 1, 2, 15, 4, 5)), ("/Date(1577934245123+0200)/", 1577934245123), ("1577934245", 1577934245000), ("1577934245.1239", 1577934245123),
        ("1577934245123", 1577934245123), ("132223978451239999", 1577924245123), (" 2020-01-02 03:04:05 GMT ", ms(2020, 1, 2, 3, 4, 5)), ("2020-01-02T03:04:05+01:00[Europe/Paris]", ms(2020, 1, 2, 2, 4, 5)),
    ]
    got = read(spark, [(v, None) for v, _ in cases])
    for i, (v, want) in enumerate(cases):
        assert got.get(i) == want, v


def test_no_instant(spark):
    bad = ["2021-02-29T10:00:00", "2021-04-31 10:00:00", "11/24/2020 9:75:99 PM", "2020-01-02", "0", "-1", "", " ", "N/A", None, "9999-12-31T23:59:59Z", "1601-01-01T00:00:00Z", "/Date(0)/", "1/1/0001 12:00:00 AM", "13/13/2020 10:00:00", "2020-01-02T24:00:00", "13:00 PM", "20200102030405", "x" * 100_000]
    assert read(spark, [(v, None) for v in bad]) == {}
    assert read(spark, []) == {}


def test_summer_time(spark):
    z = "America/New_York"
    got = read(spark, [("2019-11-03 01:30:00", z), ("2019-03-10 02:30:00", z), ("2019-07-01 00:00:00", z), ("2019-07-01 00:00:00", "No/Where"), ("2019-10-06 02:30:00", "Australia/Sydney"), ("2019-07-01T00:00:00", None)])
    assert got[0] == ms(2019, 11, 3, 5, 30)  # the earlier of two
    assert got[1] == ms(2019, 3, 10, 7, 30)  # counts on with the offset before the change
    assert got[2] == ms(2019, 7, 1, 4) and got[3] == ms(2019, 7, 1) and got[5] == ms(2019, 7, 1)
    assert got[4] == int(dt.datetime(2019, 10, 6, 2, 30, tzinfo=ZoneInfo("Australia/Sydney")).timestamp() * 1000)


def test_intervals_follow_the_zone_database():
    for name, since, until, offset in instants.zone_intervals(["Africa/Casablanca", "Europe/Dublin", "Pacific/Apia", "No/Where"]):
        z = ZoneInfo(name)
        for s in (since, (since + until) // 2, until - 1):
            assert dt.datetime.fromtimestamp(s, z).utcoffset().total_seconds() == offset


def test_zone_is_found_among_many_other_names(spark):
    from caseloom.operators import instants

    made = [(f"2020-01-02 03:04:05[Made/Up{k}]",) for k in range(6000)]
    rows = spark.createDataFrame([*made, ("2020-01-02 03:04:05[Asia/Tokyo]",), ("2020-07-02 03:04:05[Europe/Paris]",), (None,)], "value string")
    assert sorted(instants.zones_named_in(rows)) == ["Asia/Tokyo", "Europe/Paris"]
    assert instants.known_zones(rows, "value") == []
