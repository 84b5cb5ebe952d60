import random

import pytest

from caseloom.llm import groups

SCHEMA = "id long, stack_id long, vstack_id long, phash string, dhash string, group string"


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)

    hashed = []
    ids = {r[0] for r in rows if r[0] is not None}
    for i, s, v, p, d in set(rows):
        if i is None:
            continue
        for x in (s, v):
            if x is not None:
                join(i, x)
        clean = lambda t: int(t.strip(), 16) if t and len(t.strip()) == 16 and all(c in "0123456789abcdefABCDEF" for c in t.strip()) else None
        h = clean(p)
        if h is not None and 12 <= bin(h).count("1") <= 52:
            hashed.append((i, h, clean(d)))
    for k, (i, h, d) in enumerate(hashed):
        for j, g, e in hashed[k + 1 :]:
            b = bin(h ^ g).count("1")
            if b <= 2 or (b <= 6 and d is not None and e is not None and bin(d ^ e).count("1") <= 8):
                if d is not None and e is not None and bin(d ^ e).count("1") > 8:
                    continue
                join(i, j)
    members = {}
    for i in ids:
        members.setdefault(find(i), []).append(i)
    return {i: min(m) for m in members.values() if len(m) > 1 for i in m}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = groups.file_groups(df).collect()
    assert len(out) == len({r.file_id for r in out})
    return {r.file_id: r.group_id for r in out}


def make(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        h, d = rng.choice(base), rng.getrandbits(64) if rng.random() < 0.2 else 0x0123456789ABCDEF
        for _ in range(rng.randrange(9)):
            h ^= 1 << rng.randrange(64)
        for _ in range(rng.randrange(6)):
            d ^= 1 << rng.randrange(64)
        p = rng.choice([f"{h:016x}", f" {h:016X} ", "zz", None]) if rng.random() < 0.3 else f"{h:016x}"
        rows.append((i, rng.choice([None, None, None, rng.randrange(n), n + rng.randrange(20)]), rng.choice([None] * 9 + [rng.randrange(n)]), p, f"{d:016x}" if rng.random() < 0.8 else None))
    return rows


def test_equals_brute_force(spark):
    rows = make(120, 3)
    rows = [(i, None if k % 3 else s, None, p, d) for k, (i, s, v, p, d) in enumerate(rows)]
    assert run(spark, rows + rows[:20]) == brute(rows)


def test_links_through_ids_that_are_gone(spark):
    rows = [(5, 99, None, None, None), (7, None, 99, None, None), (8, 100, None, None, None), (9, 9, None, None, None), (None, 99, None, None, None)]
    assert run(spark, rows) == {5: 5, 7: 5}


def test_empty_and_featureless(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None, None, "0" * 16, None), (2, None, None, "0" * 16, None), (3, None, None, None, None)]) == {}


def test_hot_buckets_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(groups, "HOT_BUCKET", 8)
    monkeypatch.setattr(groups, "_SEEN", 1)
    monkeypatch.setattr(groups, "_BLOCK", 16)
    rng = random.Random(9)
    rows = []
    for i in range(150):  # all share their upper half, so that many buckets hold all of them
        h = 0xF0F0F0F000000000 | rng.getrandbits(32)
        rows.append((i, None, None, f"{h:016x}", "0123456789abcdef"))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("per_partition", [5, 1_000_000])
def test_chains_merge_through_partitions(spark, per_partition):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (1000, 1000), (None, 4)]
    rng.shuffle(edges)
    got = {r.node: r.group for r in groups.connected_groups(spark.createDataFrame(edges, "a long, b long").repartition(7), per_partition).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert groups.connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_star_with_a_hot_middle(spark):
    edges = spark.range(1, 50_000).selectExpr("0L as a", "id as b").repartition(8)
    got = groups.connected_groups(edges, 1000)
    assert got.count() == 50_000 and got.where("`group` <> 0").count() == 0
