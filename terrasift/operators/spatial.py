"""Grids, bounding boxes, polygons and lines on plain columns. Angles are degrees; planar steps are in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .shared import stored


def grid(points: DataFrame, x: str, y: str, size: float, weight: str) -> DataFrame:
    """cell_x, cell_y, n, weight: points counted and weighed by cell; money-like weights are summed as decimals."""
    cells = points.groupBy(S.cell(x, size).alias("cell_x"), S.cell(y, size).alias("cell_y"))
    return cells.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(weight).cast("decimal(18,4)")).cast("double").alias("weight"))


def intensity(cells: DataFrame, count_share: float = 0.75) -> DataFrame:
    """Adds ``intensity``: shares of the largest count and weight. The one row of maxima is broadcast."""
    most = cells.agg(F.greatest(F.max("n"), F.lit(1)).alias("_n"), F.greatest(F.max("weight"), F.lit(1.0)).alias("_w"))
    value = count_share * F.col("n") / F.col("_n") + (1 - count_share) * F.col("weight") / F.col("_w")
    return cells.join(F.broadcast(most)).withColumn("intensity", F.round(value, 4)).drop("_n", "_w")


def overlaps(west: float, south: float, east: float, north: float, prefix: str = "") -> Column:
    """Whether a row's box meets the window: four comparisons that reach the Parquet scan."""
    c = lambda n: F.col(f"{prefix}{n}")
    return (c("min_lon") <= east) & (c("max_lon") >= west) & (c("min_lat") <= north) & (c("max_lat") >= south)


def box(points: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of an array of struct(x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"), F.array_max(xs).alias("max_lon"), F.array_max(ys).alias("max_lat"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting against a closed ring, an array of struct(x, y): odd crossings are inside."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e):
        (ax, ay), (bx, by) = ((e[k]["x"], e[k]["y"]) for k in "ab")
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def assign_polygon(points: DataFrame, polygons: DataFrame, x: str, y: str, polygon_key: str, ring: str, cell: float) -> DataFrame:
    """Adds the polygon of each point, the smallest key where several hold it, null where none does.

    Polygons are dealt to the grid cells their boxes touch and listed by cell, as many as overlap there; the lists are
    written, so points meet them in one join of which Spark can split a busy cell.
    """
    edge = box(F.col(ring))
    at = lambda a, b: F.sequence(F.floor(a / cell).cast("bigint"), F.floor(b / cell).cast("bigint"))
    dealt = polygons.withColumn("_b", edge).withColumn("_i", F.explode(at(F.col("_b.min_lon"), F.col("_b.max_lon")))).withColumn("_j", F.explode(at(F.col("_b.min_lat"), F.col("_b.max_lat"))))
    lists = stored(dealt.groupBy("_i", "_j").agg(F.collect_list(F.struct(F.col(polygon_key).alias("polygon"), F.col(ring).alias("ring"))).alias("_near")))
    own = points.withColumns({"_i": F.floor(F.col(x) / cell).cast("bigint"), "_j": F.floor(F.col(y) / cell).cast("bigint")})
    holding = F.filter("_near", lambda p: inside(F.col(x), F.col(y), p["ring"]))
    return own.join(lists, ["_i", "_j"], "left").withColumn(polygon_key, F.array_min(F.transform(holding, lambda p: p["polygon"]))).drop("_i", "_j", "_near")


def square(x, y, size: float, wider: float = 0.0) -> Column:
    """The closed ring around a cell's middle, half a cell and ``wider`` to each side; null where a coordinate is null."""
    x, y, half = S.col(x), S.col(y), size / 2 + wider
    corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
    return F.when(x.isNotNull() & y.isNotNull(), F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners]))


def meets(ring: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a closed ring's area and a window have a point in common: an edge passes the window, or it lies inside."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def passes(e):
        """The part of the edge that is within both ranges, as a stretch of its length, is not empty."""
        low, high = F.lit(0.0), F.lit(1.0)
        for k, least, most in (("x", west, east), ("y", south, north)):
            a, d = e["a"][k], e["b"][k] - e["a"][k]
            first, last = (least - a) / F.nullif(d, F.lit(0.0)), (most - a) / F.nullif(d, F.lit(0.0))
            flat = F.when((a >= least) & (a <= most), F.lit(0.0)).otherwise(F.lit(2.0))
            low, high = F.greatest(low, F.when(d == 0, flat).otherwise(F.least(first, last))), F.least(high, F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(first, last)))
        return low <= high

    return F.exists(edges, passes) | inside(F.lit(west), F.lit(south), ring)


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(t, x, y, d2): the nearest place on the segment a-b and its squared planar distance."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(S.clamp(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), 0.0, 1.0), F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(t.alias("t"), x.alias("x"), y.alias("y"), (F.pow(px - x, 2) + F.pow(py - y, 2)).alias("d2"))


def snap(edges: DataFrame, lon: float, lat: float, farthest_miles: float = 0.5) -> DataFrame:
    """The edge nearest to a point with where it meets it: one row, or none beyond ``farthest_miles``."""
    at = project(F.lit(lon), F.lit(lat), F.col("src_x"), F.col("src_y"), F.col("dst_x"), F.col("dst_y"))
    high = farthest_miles / 68.0  # a degree of latitude is longer than this many miles
    wide = high / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + high))))
    near = edges.filter((F.least("src_x", "dst_x") <= lon + wide) & (F.greatest("src_x", "dst_x") >= lon - wide) & (F.least("src_y", "dst_y") <= lat + high) & (F.greatest("src_y", "dst_y") >= lat - high))
    best = near.withColumn("at", at).orderBy("at.d2", "src_x", "src_y", "dst_x", "dst_y").limit(1)
    return best.filter(S.miles(F.lit(lat), F.lit(lon), "at.y", "at.x") <= farthest_miles)


def nearest_edges(points: DataFrame, edges: DataFrame, key: str, x: str, y: str, edge_key: str, farthest: float) -> DataFrame:
    """key, edge_key, t, d2: for each point the nearest edge within ``farthest`` (in the units of the coordinates).

    An edge is dealt to the cells, ``farthest`` wide, that its widened box touches, so a point only looks in its own.
    Equal places are one, and so are equal edges, by their smallest key. Pairs are gone through twice, for the least
    distance and for who has it, as a minimum of numbers needs no sort of all pairs.
    """
    ends = ["src_x", "src_y", "dst_x", "dst_y"]
    at = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - farthest) / farthest).cast("bigint"), F.floor((F.greatest(a, b) + farthest) / farthest).cast("bigint")))
    lines = edges.groupBy(*ends).agg(F.min(edge_key).alias("edge"))
    dealt = lines.withColumn("_i", at("src_x", "dst_x")).withColumn("_j", at("src_y", "dst_y"))
    stops = points.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    own = stops.select("_x", "_y").distinct().withColumns({"_i": F.floor(F.col("_x") / farthest).cast("bigint"), "_j": F.floor(F.col("_y") / farthest).cast("bigint")})
    met = own.join(dealt, ["_i", "_j"]).withColumn("at", project(*(F.col(c) for c in ("_x", "_y", *ends))))
    met = met.select("_x", "_y", "edge", "at.t", "at.d2").filter(F.col("d2") <= farthest * farthest)
    least = met.groupBy("_x", "_y").agg(F.min("d2").alias("least"))
    nearest = met.join(least, ["_x", "_y"]).filter("d2 = least").groupBy("_x", "_y").agg(F.min(F.struct("d2", "edge", "t")).alias("b"))
    best = stops.join(nearest, ["_x", "_y"]).groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, F.col("b.edge").alias(edge_key), "b.t", "b.d2")


def samples(ax: Column, ay: Column, bx: Column, by: Column, steps: int = 10) -> Column:
    """Places along a segment, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct((ax + (bx - ax) * i / steps).alias("x"), (ay + (by - ay) * i / steps).alias("y")))


def exposure(edges: DataFrame, edge_key: str, cells: DataFrame, size: float, hot: str = "hot", steps: int = 10) -> DataFrame:
    """edge_key, mean_intensity, max_intensity, hot_share over places along each edge. ``cells``: i, j, intensity, ``hot``."""
    places = edges.select(edge_key, F.explode(samples(*(F.col(c) for c in ("src_x", "src_y", "dst_x", "dst_y")), steps)).alias("p"))
    places = places.withColumns({"i": S.cell_index("p.x", size), "j": S.cell_index("p.y", size)}).join(cells, ["i", "j"], "left")
    value = F.coalesce("intensity", F.lit(0.0))
    return places.groupBy(edge_key).agg(F.round(F.avg(value), 6).alias("mean_intensity"), F.max(value).alias("max_intensity"), F.round(F.avg(F.when(F.col(hot), 1.0).otherwise(0.0)), 6).alias("hot_share"))


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Line simplification that keeps every vertex farther than ``tolerance`` from its chord."""
    return [points[i] for i in kept_places(points, tolerance)]


def kept_places(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    if len(points) < 3:
        return list(range(len(points)))
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy

        def off(p, ax=ax, ay=ay, dx=dx, dy=dy, length=length):
            t = min(1.0, max(0.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / length)) if length else 0.0
            return (p[0] - ax - t * dx) ** 2 + (p[1] - ay - t * dy) ** 2

        far = max(range(a + 1, b), key=lambda i: off(points[i]), default=None)
        if far is not None and off(points[far]) > tolerance * tolerance:
            keep.add(far)
            todo += [(a, far), (far, b)]
    return sorted(keep)


def claim_by_priority(pieces: DataFrame, feature: str, place: list[str], order: list[Column]) -> DataFrame:
    """Each shared piece of line goes to one feature, the first in ``order``."""
    return pieces.withColumn("_nth", F.row_number().over(Window.partitionBy(*place).orderBy(*order, F.col(feature)))).filter("_nth = 1").drop("_nth")
