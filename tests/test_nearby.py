import math
import random

from caseloom.operators import nearby


def brute(points, metres):
    usable = {i: (math.radians(a), math.radians(o)) for i, a, o in points if i is not None and a is not None and o is not None and abs(a) <= 90 and abs(o) <= 180 and (a, o) != (0, 0)}
    ids, out = sorted(usable), set()
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            (a, o), (b, p) = usable[i], usable[j]
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2
            if 2 * 6_371_000 * math.asin(math.sqrt(h)) <= metres:
                out.add((i, j))
    return out


def near(spark, points, metres=150.0):
    df = spark.createDataFrame([(*p, "x") for p in points], "id long, gps_lat double, gps_lon double, pos string")
    return [tuple(r) for r in nearby.near_pairs(df, metres).collect()]


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    points = []
    for i in range(300):
        a, o = rng.choice([(48.0, 11.0), (-89.9995, 40.0), (10.0, 179.9998), (0.0005, 0.0005)])
        o += rng.uniform(-0.002, 0.002) * (1 if abs(a) < 80 else 9000)
        points.append((i, max(-90.0, a + rng.uniform(-0.002, 0.002)), (o + 180) % 360 - 180))
    got = near(spark, points)
    assert len(got) == len(set(got)) and set(got) == brute(points, 150.0)


def test_same_spot_repeats_and_unusable(spark):
    nan, inf = float("nan"), float("inf")
    points = [(1, 5.0, 5.0), (2, 5.0, 5.0), (2, 5.0, 5.0), (3, 0.0, 0.0), (4, 0.0, 0.0), (5, nan, 5.0), (6, inf, 5.0), (7, 91.0, 5.0), (8, None, 5.0), (None, 5.0, 5.0), (9, 5.0, -180.0), (10, 5.0, 180.0), (11, -0.0, 7.0), (12, 0.0, 7.0)]
    assert sorted(near(spark, points)) == [(1, 2), (9, 10), (11, 12)]
    assert near(spark, []) == []


def test_hot_spot_beyond_a_chunk(spark):
    n = 700
    assert len(set(near(spark, [(i, 5.0, 5.0) for i in range(n)]))) == n * (n - 1) // 2


def test_regions_concave_overlapping_and_across_the_date_line(spark):
    ring = lambda *p: [(float(a), float(o)) for a, o in p]
    regions = spark.createDataFrame(
        [(1, ring((0, 0), (0, 10), (10, 10), (10, 0))), (2, ring((5, 5), (5, 15), (15, 15), (15, 5))), (3, ring((0, 170), (0, -170), (10, -170), (10, 170))), (4, ring((0, 20), (10, 30), (0, 40), (3, 30))), (5, ring((0, 0), (1, 1))), (6, None), (1, ring((0, 0), (0, 10), (10, 10), (10, 0)))],
        "region_id int, ring array<struct<lat double, lon double>>",
    )
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 7.0, 7.0), (3, 5.0, 179.0), (4, 5.0, -175.0), (5, 1.0, 30.0), (6, 6.0, 30.0), (7, 5.0, 169.0), (7, 5.0, 169.0), (8, None, 3.0)], "id long, gps_lat double, gps_lon double")
    got = sorted(tuple(r) for r in nearby.points_in_regions(points, regions).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 3), (4, 3), (6, 4)]
