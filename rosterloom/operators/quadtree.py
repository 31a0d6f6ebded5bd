"""Places in a quadtree whose cells split where the places are: nearest neighbours and many polygons.

A place has a Morton key of ``DEPTH`` levels; its cell at a level is a prefix of the key. Cells with
more than ``most`` places are split, two levels at a time and only there, so that a leaf is bounded
however dense its city is (only equal places cannot be split).

Nearest neighbours: counts of all inner cells tell each query the deepest level at which the nine
cells around it hold enough places; that bounds the distance of the k-th one. The circle of this
radius is covered by a few cells, which meet the leaves above or below them by equality of prefixes.

Polygons are cut into cells: those inside need no test, those that an edge crosses test their places.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .relational import cut

DEPTH = 20
MOST = 256
#: Cells that a polygon is cut into at most, roughly.
PIECES = 1024
_SIDE = 1 << DEPTH


def _axis(degrees: Column, low: float, span: float) -> Column:
    return F.greatest(F.least(F.floor((degrees - low) / span * _SIDE), F.lit(_SIDE - 1)), F.lit(0)).cast("long")


def _spread(v: Column) -> Column:
    """The bits of a number with a gap before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton(x: Column, y: Column) -> Column:
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def key(lat: Column, lon: Column) -> Column:
    """The cell of a place at the deepest level."""
    return morton(_axis(lon, -180.0, 360.0), _axis(lat, -90.0, 180.0))


def build(points: DataFrame, lat: str, lon: str, most: int = MOST) -> DataFrame:
    """``points`` with ``key``, and ``level`` and ``cell`` of the leaf that holds each; rows without a place are left out."""
    open_ = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("key", key(F.col(lat), F.col(lon)))
    done = None
    for level in range(0, DEPTH + 1, 2):
        at = F.expr(f"shiftright(key, {2 * (DEPTH - level)})")
        held = open_.withColumn("level", F.lit(level)).withColumn("cell", at)
        heavy = held.groupBy("cell").agg(F.count("*").alias("__n")).filter(F.col("__n") > most) if level < DEPTH else None
        if heavy is None:
            return held if done is None else done.unionByName(held)
        heavy = cut(heavy)
        settled = held.join(heavy, "cell", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if heavy.isEmpty():
            return done
        open_ = cut(held.join(heavy.drop("__n"), "cell", "left_semi").drop("level", "cell"))
    return done


def nodes(tree: DataFrame) -> DataFrame:
    """(level, cell, n): the places of every leaf and every cell above one."""
    leaves = tree.groupBy("level", "cell").agg(F.count("*").alias("n"))
    above = leaves.select(F.explode(F.expr("transform(sequence(0, level), u -> struct(u as level, shiftright(cell, 2 * (level - u)) as cell))")).alias("a"), "n")
    return above.select("a.*", "n").groupBy("level", "cell").agg(F.sum("n").alias("n"))


def _cells_of_box(south: Column, west: Column, north: Column, east: Column, level: Column) -> Column:
    """The cells at a level that a box touches; a box over the date line is two."""
    width = F.expr(f"shiftleft(1L, {DEPTH})") / F.pow(F.lit(2.0), level)
    row = lambda c: F.floor(_axis(c, -90.0, 180.0) / width).cast("long")
    column = lambda c: F.floor((c + 180.0) / 360.0 * F.pow(F.lit(2.0), level)).cast("long")
    rows = F.sequence(row(south), row(north))
    wrap = F.pow(F.lit(2.0), level).cast("long")
    columns = F.array_distinct(F.transform(F.sequence(column(west), F.least(column(east), column(west) + wrap - 1)), lambda c: F.pmod(c, wrap)))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: morton(x, y))))


def nearest(queries: DataFrame, tree: DataFrame, id_: str, lat: str, lon: str, k: int = 10) -> DataFrame:
    """(q, id, miles, place): the k places nearest to each query, by id among those equally near to a millionth of a mile.

    ``queries`` has (q, q_lat, q_lon). Fewer than k places give fewer rows.
    """
    counts = cut(nodes(tree))
    ask = cut(queries.select("q", F.col("q_lat").cast("double").alias("q_lat"), F.col("q_lon").cast("double").alias("q_lon")).filter("q_lat is not null and q_lon is not null"))
    # the deepest level at which the cells around a query hold enough; none: the whole tree
    x, y = _axis(F.col("q_lon"), -180.0, 360.0), _axis(F.col("q_lat"), -90.0, 180.0)
    levels = ask.select("q", F.explode(F.sequence(F.lit(2), F.lit(DEPTH))).alias("level"), x.alias("x"), y.alias("y"))
    around = levels.withColumn("s", F.lit(DEPTH) - F.col("level"))
    cell = "transform(array(-1L, 0L, 1L), dx -> pmod(shiftright(x, s) + dx, shiftleft(1L, level)))"
    around = around.withColumn("xs", F.array_distinct(F.expr(cell))).withColumn("ys", F.expr("filter(transform(array(-1L, 0L, 1L), dy -> shiftright(y, s) + dy), v -> v between 0 and shiftleft(1L, level) - 1)"))
    around = around.select("q", "level", F.explode("xs").alias("cx"), "ys").select("q", "level", "cx", F.explode("ys").alias("cy")).select("q", "level", morton(F.col("cx"), F.col("cy")).alias("cell"))
    held = around.join(counts, ["level", "cell"]).groupBy("q", "level").agg(F.sum("n").alias("n")).filter(F.col("n") >= k).groupBy("q").agg(F.max("level").alias("level"))
    located = ask.join(held, "q", "left")
    # no place of the nine cells is farther than two cells of latitude and two of longitude at its widest
    side = F.pow(F.lit(2.0), -F.col("level"))
    bound = F.lit(geo.EARTH_MILES) * F.radians(2 * side * 180.0 + 2 * side * 360.0) * 1.000001
    located = located.withColumn("radius", bound)
    dlat = F.degrees(F.col("radius") / geo.EARTH_MILES)
    top = F.greatest(F.abs(F.col("q_lat") + dlat), F.abs(F.col("q_lat") - dlat))
    # the widest the circle is in longitude; a circle over a pole has every longitude
    angle = F.col("radius") / geo.EARTH_MILES
    ratio = F.sin(F.least(angle, F.lit(math.pi / 2))) / F.cos(F.radians(F.least(top, F.lit(89.9))))
    wide = F.when((top >= 89.9) | (ratio >= 1) | (angle >= math.pi / 2), 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001)
    dlon = F.least(wide, F.lit(180.0))
    cover_level = F.greatest(F.least(F.floor(F.log2(180.0 / F.greatest(dlat, F.lit(1e-9)))), F.floor(F.log2(360.0 / F.greatest(dlon, F.lit(1e-9)))), F.lit(DEPTH)).cast("int"), F.lit(0))
    south, north = F.greatest(F.col("q_lat") - dlat, F.lit(-90.0)), F.least(F.col("q_lat") + dlat, F.lit(90.0))
    boxed = located.select("q", "q_lat", "q_lon", F.coalesce(cover_level, F.lit(0)).alias("u"), south.alias("south"), north.alias("north"), (F.col("q_lon") - dlon).alias("west"), (F.col("q_lon") + dlon).alias("east"))
    whole = F.array(F.lit(0).cast("long"))
    cover = boxed.withColumn("cells", F.when((F.col("u") == 0) | F.col("south").isNull(), whole).otherwise(_cells_of_box(F.col("south"), F.col("west"), F.col("north"), F.col("east"), F.col("u"))))
    cover = cover.select("q", "q_lat", "q_lon", "u", F.explode("cells").alias("c"))
    leaves = tree.select("level", "cell").distinct()
    below = leaves.select("level", "cell", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("u")).withColumn("c", F.expr("shiftright(cell, 2 * (level - u))"))
    inside = cover.join(below, ["u", "c"]).select("q", "q_lat", "q_lon", "level", "cell")
    upper = cover.select("q", "q_lat", "q_lon", F.explode(F.expr("filter(sequence(0, u), v -> v < u)")).alias("level"), "u", "c").withColumn("cell", F.expr("shiftright(c, 2 * (u - level))"))
    outside = upper.join(leaves, ["level", "cell"]).select("q", "q_lat", "q_lon", "level", "cell")
    pairs = inside.unionByName(outside).distinct()
    met = pairs.join(tree.select("level", "cell", F.col(id_).alias("id"), F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon")), ["level", "cell"])
    rated = met.select("q", "id", geo.miles(F.col("q_lat"), F.col("q_lon"), F.col("p_lat"), F.col("p_lon")).alias("miles"))
    # a millionth of a mile is no difference: equal places stay equal however a distance is worked out
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.round("miles", 6), "id"))
    return rated.withColumn("place", place).filter(F.col("place") <= k)


def _pieces(rings: pd.DataFrame) -> pd.DataFrame:
    """(pid, level, cell, whole) of polygons: cells inside and cells that an edge may cross."""
    out = []
    for pid, lats, lons in zip(rings["pid"], rings["lats"], rings["lons"]):
        y, x = (np.asarray(lats) + 90) / 180, (np.asarray(lons) + 180) / 360
        if len(y) < 3:
            continue
        y2, x2 = np.roll(y, -1), np.roll(x, -1)
        size = max(y.max() - y.min(), x.max() - x.min(), 2.0**-DEPTH)
        level = int(np.clip(math.floor(math.log2(math.sqrt(PIECES) / 2 / size)), 0, DEPTH)) // 2 * 2
        n = 1 << level
        rows, columns = (np.arange(int(min(v.min() * n, n - 1)), int(min(v.max() * n, n - 1)) + 1) for v in (y, x))
        cy, cx = (a.ravel() for a in np.meshgrid(rows, columns, indexing="ij"))
        low_y, low_x = cy / n, cx / n
        crossed = np.zeros(len(cy), bool)
        for a, b, c, d in zip(y, x, y2, x2):  # boxes that an edge's box and line both meet, a little widened
            e = 1e-9
            near = (max(a, c) >= low_y - e) & (min(a, c) <= low_y + 1 / n + e) & (max(b, d) >= low_x - e) & (min(b, d) <= low_x + 1 / n + e)
            sides = [(c - a) * (low_x + u / n - b) - (d - b) * (low_y + v / n - a) for u in (0, 1) for v in (0, 1)]
            crossed |= near & (np.min(sides, axis=0) <= e) & (np.max(sides, axis=0) >= -e)
        my, mx = low_y + 0.5 / n, low_x + 0.5 / n
        odd = np.zeros(len(cy), bool)
        for a, b, c, d in zip(y, x, y2, x2):
            if a != c:
                odd ^= ((a > my) != (c > my)) & (mx < (d - b) * (my - a) / (c - a) + b)
        keep = crossed | odd
        code = np.zeros(len(cy), np.int64)
        for bit in range(level):
            code |= ((cx >> bit) & 1) << (2 * bit) | ((cy >> bit) & 1) << (2 * bit + 1)
        out += [(pid, level, int(k), bool(w)) for k, w in zip(code[keep], ~crossed[keep])]
    return pd.DataFrame(out, columns=["pid", "level", "cell", "whole"])


def in_polygons(points: DataFrame, polygons: DataFrame, id_: str, lat: str, lon: str) -> DataFrame:
    """(pid, id): the places inside each polygon by ray casting, as ``geo.in_polygon`` decides it.

    ``polygons`` has (pid, lats, lons), arrays of a ring's corners; fewer than three are no polygon.
    """
    kind = polygons.schema["pid"].dataType.simpleString()
    cells = cut(polygons.select("pid", "lats", "lons").mapInPandas(lambda frames: (_pieces(f) for f in frames), f"pid {kind}, level int, cell bigint, whole boolean"))
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # of eleven even levels at most
    placed = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(id_).alias("id"), F.col(lat).alias("y"), F.col(lon).alias("x"), key(F.col(lat), F.col(lon)).alias("key"))
    placed = placed.select("id", "y", "x", "key", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")).alias("level")).withColumn("cell", F.expr(f"shiftright(key, 2 * ({DEPTH} - level))"))
    met = placed.join(cells, ["level", "cell"])
    sure = met.filter("whole").select("pid", "id")
    edge = met.filter("not whole").join(polygons.select("pid", "lats", "lons"), "pid")
    crossing = """aggregate(sequence(1, size(lats)), false, (odd, i) -> odd != (
        ((element_at(lats, i) > y) != (element_at(lats, if(i = size(lats), 1, i + 1)) > y))
        and x < (element_at(lons, if(i = size(lats), 1, i + 1)) - element_at(lons, i)) * (y - element_at(lats, i)) / nullif(element_at(lats, if(i = size(lats), 1, i + 1)) - element_at(lats, i), 0d) + element_at(lons, i)))"""
    return sure.unionByName(edge.filter(F.coalesce(F.expr(crossing), F.lit(False))).select("pid", "id"))
