"""Points near other points, and points in regions.

Near pairs come from a dual-tree join. Positions are laid in earth-centred metres (so neither poles nor the
date line are special) and every level of an octree is a table of nodes with their tight bounding boxes. Pairs
of nodes are compared level by level: pairs whose boxes are too far apart are discarded, pairs whose boxes are
certainly near are accepted wholesale, the rest go down to their children, until few points are left or the
smallest cells are reached; only there are points compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, unit_xyz, usable_position
from ..session import cut, small

#: log2 of the cell edge in metres, level by level; the first holds the whole earth in one cell.
LEVELS = (24, 21, 18, 15, 12, 9, 7, 5)
#: Pairs of nodes with at most so many pairs of points are compared point by point.
LEAF_PAIRS = 64
#: Files at one position or cell travel in arrays of at most this many.
CHUNK = 256
_AXES = ("x", "y", "z")


def _cell(level: int) -> Column:
    """Key of the cell of (x, y, z) at a level: three 21-bit steps in one integer."""
    steps = [F.floor((F.col(a) + EARTH_RADIUS_M + 64.0) / float(1 << LEVELS[level])).cast("long") for a in _AXES]
    return F.shiftleft(steps[0], 42).bitwiseOR(F.shiftleft(steps[1], 21)).bitwiseOR(steps[2])


def _gap2(a: str, b: str) -> Column:
    """Least possible squared distance of two boxes."""
    return reduce(lambda s, d: s + d * d, [F.greatest(F.lit(0.0), F.col(f"{a}.lo_{i}") - F.col(f"{b}.hi_{i}"), F.col(f"{b}.lo_{i}") - F.col(f"{a}.hi_{i}")) for i in _AXES], F.lit(0.0))


def _span2(a: str, b: str) -> Column:
    """Greatest possible squared distance of two boxes."""
    return reduce(lambda s, d: s + d * d, [F.greatest(F.col(f"{a}.hi_{i}") - F.col(f"{b}.lo_{i}"), F.col(f"{b}.hi_{i}") - F.col(f"{a}.lo_{i}")) for i in _AXES], F.lit(0.0))


def _tree(points: DataFrame) -> DataFrame:
    """All levels of the tree in one table: (level, cell, up, n, bounding box), from points keyed c0, c1, ..."""
    last = len(LEVELS) - 1
    leaves = points.groupBy(*[f"c{k}" for k in range(last + 1)]).agg(
        F.count(F.lit(1)).alias("n"), *[f(i).alias(f"{k}_{i}") for i in _AXES for k, f in (("lo", F.min), ("hi", F.max))]
    )
    steps = [F.struct(F.lit(k).alias("level"), F.col(f"c{k}").alias("cell"), (F.col(f"c{k - 1}") if k else F.lit(None).cast("long")).alias("up")) for k in range(last + 1)]
    boxes = [f(f"{k}_{i}").alias(f"{k}_{i}") for i in _AXES for k, f in (("lo", F.min), ("hi", F.max))]
    lone = leaves.select("n", *[f"{k}_{i}" for i in _AXES for k in ("lo", "hi")], F.explode(F.array(*steps)).alias("at"))
    return lone.groupBy("at.level", "at.cell", "at.up").agg(F.sum("n").alias("n"), *boxes)


def near_position_pairs(positions: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """Dual-tree join of distinct positions (pos, x, y, z) with themselves.

    Returns the pairs (p, q), p < q, unfolded from node pairs accepted wholesale, and those found by comparing
    points in leaves. Together they are every pair of different positions at most ``metres`` of arc apart.
    """
    chord2 = (2 * EARTH_RADIUS_M * math.sin(metres / (2 * EARTH_RADIUS_M))) ** 2
    last = len(LEVELS) - 1
    points = positions.select("pos", *_AXES, *[_cell(k).alias(f"c{k}") for k in range(len(LEVELS))])
    points = cut(points)
    nodes = cut(_tree(points))
    tree = [nodes.where(F.col("level") == k) for k in range(last + 1)]
    node = lambda t: F.struct("cell", "n", *[f"{k}_{i}" for i in _AXES for k in ("lo", "hi")]).alias(t)
    pairs = tree[0].select(node("a"), node("b"))  # the root with itself
    done: list[DataFrame] = []
    for level in range(last + 1):
        if level:
            # The two ends of an uncertain pair are replaced by their children; a parent has a bounded number.
            left = tree[level].select(F.col("up").alias("ua"), node("a"))
            right = tree[level].select(F.col("up").alias("ub"), node("b"))
            pairs = pairs.join(left, "ua").join(right, "ub").where((F.col("ua") != F.col("ub")) | (F.col("a.cell") <= F.col("b.cell")))
        judged = pairs.where(_gap2("a", "b") <= chord2).select(
            "a", "b",
            F.when(_span2("a", "b") <= chord2, "near").when((F.col("a.n") * F.col("b.n") <= LEAF_PAIRS) | F.lit(level == last), "leaf").otherwise("open").alias("state"),
        )
        judged = cut(judged.select(F.col("a.cell").alias("ua"), F.col("b.cell").alias("ub"), "state", (F.col("a.n") * F.col("b.n")).alias("m")))
        done.append(judged.where(F.col("state") != "open").select(F.lit(level).alias("level"), "ua", "ub", "state", "m"))
        pairs = judged.where(F.col("state") == "open").select("ua", "ub")
    closed = reduce(DataFrame.unionByName, done)
    accepted = closed.where((F.col("state") == "near") & ((F.col("m") > 1) | (F.col("ua") != F.col("ub")))).select("level", F.col("ua").alias("a"), F.col("ub").alias("b"))
    # Uncertain leaves: the points of both cells, at whichever level the pair stopped.
    by_level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"c{k}").alias("cell")) for k in range(len(LEVELS))]))
    members = points.select(F.struct("pos", *_AXES).alias("pt"), by_level.alias("at")).select("at.level", "at.cell", "pt")
    leaf = closed.where(F.col("state") == "leaf")
    p = members.select("level", F.col("cell").alias("ua"), F.col("pt").alias("p"))
    q = members.select("level", F.col("cell").alias("ub"), F.col("pt").alias("q"))
    apart2 = reduce(lambda s, d: s + d * d, [F.col(f"p.{i}") - F.col(f"q.{i}") for i in _AXES], F.lit(0.0))
    near = leaf.join(p, ["level", "ua"]).join(q, ["level", "ub"]).where((apart2 <= chord2) & ((F.col("ua") != F.col("ub")) | (F.col("p.pos") < F.col("q.pos"))))
    near = near.select(F.least("p.pos", "q.pos").alias("p"), F.greatest("p.pos", "q.pos").alias("q"))
    cells = members.select("level", "cell", F.col("pt.pos").alias("pos"))
    return accepted.join(cells.select("level", F.col("cell").alias("a"), F.col("pos").alias("pa")), ["level", "a"]).join(
        cells.select("level", F.col("cell").alias("b"), F.col("pos").alias("pb")), ["level", "b"]
    ).where((F.col("a") != F.col("b")) | (F.col("pa") < F.col("pb"))).select(F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q")), near


def distinct_positions(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions with pos, x, y, z; members with pos and chunks of at most CHUNK ids).

    Files at one spot become one position: a spot with a third of all files is one point of the tree. Chunks
    are cut within map tasks first, so a hot spot leaves each task as arrays, not rows.
    """
    key = F.struct((F.col("gps_lat") + 0.0).alias("lat"), (F.col("gps_lon") + 0.0).alias("lon"))
    usable = points.where(usable_position(F.col("gps_lat"), F.col("gps_lon")) & F.col("id").isNotNull()).select("id", (F.col("gps_lat") + 0.0).alias("lat"), (F.col("gps_lon") + 0.0).alias("lon"), key.alias("pos")).distinct()
    xyz = dict(zip(_AXES, unit_xyz(F.col("lat"), F.col("lon"))))
    salted = usable.groupBy("pos", "lat", "lon", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / CHUNK).cast("int")), lambda i: F.slice("ids", i * CHUNK + 1, CHUNK))
    members = salted.select("pos", "lat", "lon", F.explode(slices).alias("ids"))
    positions = members.groupBy("pos").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).select("pos", *[c.alias(a) for a, c in xyz.items()])
    return positions, members


def near_pairs(points: DataFrame, metres: float = 150.0) -> DataFrame:
    """Every pair (left_id < right_id) of points at most ``metres`` apart on the sphere.

    ``points`` has ``id``, ``gps_lat`` and ``gps_lon``; rows with a null id or an unusable position (null,
    NaN, infinite, out of range, both zero) take part in nothing, repeated rows count once, extra columns are
    ignored, and points at the same spot are near each other. An empty table gives an empty table.
    """
    positions, members = distinct_positions(points)
    members = cut(members.select("pos", "ids"))
    accepted, leaf = near_position_pairs(positions, metres)
    p = members.select(F.col("pos").alias("p"), F.col("ids").alias("ps"))
    q = members.select(F.col("pos").alias("q"), F.col("ids").alias("qs"))
    apart = accepted.unionByName(leaf).join(p, "p").join(q, "q").select("ps", "qs")
    # Chunks of one spot with each other; arrays join, ids only unfold afterwards.
    same = p.select(F.col("p").alias("k"), "ps").join(q.select(F.col("q").alias("k"), "qs"), "k").where(F.col("ps")[0] <= F.col("qs")[0])
    same = same.where((F.size("ps") > 1) | (F.size("qs") > 1) | (F.col("ps")[0] != F.col("qs")[0])).select("ps", "qs", (F.col("ps")[0] == F.col("qs")[0]).alias("own"))
    both = apart.withColumn("own", F.lit(False)).unionByName(same)
    ids = both.select(F.explode("ps").alias("i"), "qs", "own").select("i", F.explode("qs").alias("j"), "own").where(~F.col("own") | (F.col("i") < F.col("j")))
    return ids.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"))


_TILE = 1.0  # degrees


def _unwound(ring: list) -> list[tuple[float, float]]:
    """Corners with longitudes carried on, so that neighbours differ by less than half a turn."""
    out: list[tuple[float, float]] = []
    for p in ring:
        if p is None or p["lat"] is None or p["lon"] is None:
            continue
        lat, lon = float(p["lat"]), float(p["lon"])
        if not (math.isfinite(lat) and math.isfinite(lon)):
            continue
        if out:
            lon = out[-1][1] + (lon - out[-1][1] + 180.0) % 360.0 - 180.0
        out.append((lat, lon))
    return out


def _tiles_of(region_id: int, ring: list) -> Iterator[tuple]:
    corners = _unwound(ring)
    if len(corners) < 3:
        return
    edges = [(a, o, b, p) for (a, o), (b, p) in zip(corners, corners[1:] + corners[:1])]
    span = lambda k: range(math.floor(min(c[k] for c in corners) / _TILE), math.floor(max(c[k] for c in corners) / _TILE) + 1)
    for ty in span(0):
        band = [e for e in edges if min(e[0], e[2]) <= (ty + 1) * _TILE and max(e[0], e[2]) >= ty * _TILE]
        for tx in span(1):
            state = "cut" if any(min(e[1], e[3]) <= (tx + 1) * _TILE and max(e[1], e[3]) >= tx * _TILE for e in band) else None
            if not state:
                lat, lon = (ty + 0.5) * _TILE, (tx + 0.5) * _TILE
                odd = sum((o > lon) != (p > lon) and lat < (b - a) * (lon - o) / (p - o) + a for a, o, b, p in edges) % 2
                state = "in" if odd else None
            if state:
                if state == "cut":
                    # Edges beside the tile or below it meet no ray to the north; those above it and across all of it meet every one.
                    lo, hi, top = tx * _TILE, (tx + 1) * _TILE, (ty + 1) * _TILE
                    met = [e for e in edges if min(e[1], e[3]) <= hi and max(e[1], e[3]) >= lo and max(e[0], e[2]) >= ty * _TILE]
                    whole = [min(e[0], e[2]) > top and min(e[1], e[3]) < lo and max(e[1], e[3]) > hi for e in met]
                    own = [dict(zip("aobp", e)) for e, w in zip(met, whole) if not w]
                    yield region_id, ty, tx % 360, float(tx - tx % 360), state, own, sum(whole) % 2 == 1
                else:
                    yield region_id, ty, tx % 360, float(tx - tx % 360), state, None, False


def region_tiles(regions: DataFrame) -> DataFrame:
    """Regions cut to one-degree tiles: (region_id, ty, tx, turn, state, edges, odd).

    State ``in`` where the whole tile lies inside; tiles wholly outside are left out; ``edges`` are, for tiles an
    edge may cross, those that a ray to the north may or may not meet, ``odd`` whether it meets an odd number of the others. Null ids and rings of fewer than three usable corners give nothing; repeated
    regions count once. A ring around a pole is not an area of the lat/lon plane and is not supported.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [t for r in zip(batch["region_id"], batch["ring"]) for t in _tiles_of(*r)]
            yield pd.DataFrame(rows, columns=["region_id", "ty", "tx", "turn", "state", "edges", "odd"])

    wanted = regions.select("region_id", "ring").dropna().distinct()
    return wanted.mapInPandas(run, "region_id int, ty int, tx int, turn double, state string, edges array<struct<a double, o double, b double, p double>>, odd boolean")


def point_in_edges(lat: Column, lon: Column) -> Column:
    """Even-odd rule over the column ``edges``: an odd number of edges crossed by the ray to the north."""
    crosses = lambda e: ((e["o"] > lon) != (e["p"] > lon)) & (lat < (e["b"] - e["a"]) * (lon - e["o"]) / (e["p"] - e["o"]) + e["a"])
    return (F.size(F.filter("edges", crosses)) % 2 == 1) != F.col("odd")


def points_in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(left_id, right_id) of every point and each region that contains it, overlapping ones included.

    Points are as in ``near_pairs``; regions have ``region_id`` and ``ring``. A tile that lies wholly in a region is accepted
    and one wholly outside discarded without a look at its points; only points of cut tiles are tested.
    """
    usable = points.where(usable_position(F.col("gps_lat"), F.col("gps_lon")) & F.col("id").isNotNull()).select("id", "gps_lat", "gps_lon")
    usable = usable.withColumns({"ty": F.floor(F.col("gps_lat") / _TILE).cast("int"), "tx": F.pmod(F.floor(F.col("gps_lon") / _TILE).cast("int"), F.lit(360))})
    turned = F.col("turn") + F.col("tx") + F.pmod(F.col("gps_lon"), F.lit(_TILE))
    hit = usable.join(small(region_tiles(regions), 20_000), ["ty", "tx"]).where((F.col("state") == "in") | point_in_edges(F.col("gps_lat"), turned))
    return hit.select(F.col("id").alias("left_id"), F.col("region_id").cast("long").alias("right_id")).distinct()
