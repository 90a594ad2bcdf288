"""A route over a line network, around cells dense with incidents if asked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.lines import parsed_points
from . import graph as G
from .layers import corridor, hot_cells
from .linework import meeting
from .relational import floor_index_percentile
from .shared import stored
from .spatial import claim_by_priority, overlaps, project, snap

MILES_AN_HOUR = 10.0
WIDER = 0.0004  # degrees that a route keeps off a hot cell
NEAREST_MILES = 0.05


class NoRoute(ValueError):
    """Why there is no route: too close, no network near by, or not connected."""


@dataclass
class Route:
    nodes: list[tuple[float, float]]
    miles: float
    blocked_edges: int

    @property
    def minutes(self) -> float:
        return round(self.miles / MILES_AN_HOUR * 60, 1)


def network(routes: DataFrame, city: str, cell: float = 0.01) -> DataFrame:
    """Edges of a city's lines, split where they cross; nodes are coordinates to seven places, named ``x,y``."""
    lines = routes.filter(F.col("city") == city).select(parsed_points(F.col("geometry_json")).alias("points"))
    return named(G.noded(G.line_edges(lines, "points"), cell))


def facilities(routes: DataFrame, city: str, nodes: list[tuple[float, float]]) -> DataFrame:
    """The different layers of a city whose lines come within the box of a route."""
    xs, ys = zip(*nodes)
    return routes.filter((F.col("city") == city) & overlaps(min(xs), min(ys), max(xs), max(ys))).select("layer_type", "layer_label").distinct().orderBy("layer_label")


def analysis(routes: DataFrame, incidents: DataFrame, city: str, start: tuple[float, float], end: tuple[float, float], size: float = 0.0025, percent: float = 90, wider: float = WIDER) -> dict[str, DataFrame]:
    """What a map of an avoidance shows in the corridor between two points: cells, hot cells, open and blocked edges."""
    west, south, east, north = corridor(*start, *end)
    cells = hot_cells(incidents, city, size)
    threshold = floor_index_percentile(cells, "intensity", percent)
    cells = cells.withColumns({"lon": F.col("i") * size, "lat": F.col("j") * size, "hot": F.col("intensity") >= F.lit(threshold)})
    inside = cells.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north)).orderBy(F.col("intensity").desc(), "i", "j")
    edges, a = with_stop(network(routes, city), *start)
    edges, b = with_stop(edges, *end)
    edges = stored(edges.withColumn("edge_key", F.concat_ws("|", "src", "dst")))
    stops = edges.sparkSession.createDataFrame([(a,), (b,)], "node string")
    met = meeting(edges, "edge_key", cells.filter("hot"), size, wider).withColumn("hot", F.lit(True))
    touched = G.chains(edges.join(met, "edge_key", "left").na.fill(False, ["hot"]), stops)
    here = (F.greatest("src_x", "dst_x") >= west) & (F.least("src_x", "dst_x") <= east) & (F.greatest("src_y", "dst_y") >= south) & (F.least("src_y", "dst_y") <= north)
    left = G.without_blocked(touched, F.col("hot"))
    return {"cells": inside, "hot": inside.filter("hot"), "open": left.filter(here), "blocked": touched.join(left.select("edge_key"), "edge_key", "left_anti").filter(here)}


def named(edges: DataFrame) -> DataFrame:
    node = lambda s: F.concat_ws(",", F.format_string("%.7f", f"{s}_x"), F.format_string("%.7f", f"{s}_y"))
    return edges.withColumns({"src": node("src"), "dst": node("dst")})


def with_stop(edges: DataFrame, lon: float, lat: float) -> tuple[DataFrame, str]:
    """Splits the nearest edge where the point meets it."""
    at = snap(edges, lon, lat).select("src", "dst", "src_x", "src_y", "dst_x", "dst_y", F.round("at.x", 7).alias("x"), F.round("at.y", 7).alias("y")).first()
    if at is None:
        raise NoRoute("no network near the point")
    halves = [(at["src_x"], at["src_y"], at["x"], at["y"]), (at["x"], at["y"], at["dst_x"], at["dst_y"])]
    spark = edges.sparkSession
    new = spark.createDataFrame([h for h in halves if h[:2] != h[2:]], "src_x double, src_y double, dst_x double, dst_y double").withColumn("miles", S.miles("src_y", "src_x", "dst_y", "dst_x"))
    rest = edges.filter((F.col("src") != at["src"]) | (F.col("dst") != at["dst"]))
    return rest.unionByName(named(new), allowMissingColumns=True), f"{at['x']:.7f},{at['y']:.7f}"


def unblocked(edges: DataFrame, incidents: DataFrame, city: str, size: float, percent: float, stops: list[str], wider: float = WIDER) -> tuple[DataFrame, int]:
    """Without every chain of edges that meets the square of a hot cell, ``wider`` to each side; counts each undirected
    edge once. Stops end chains."""
    cells = hot_cells(incidents, city, size)
    threshold = floor_index_percentile(cells, "intensity", percent)
    cells = cells.withColumn("hot", F.col("intensity") >= F.lit(threshold))
    edges = stored(edges.withColumn("edge_key", F.concat_ws("|", "src", "dst")))
    touched = edges.join(meeting(edges, "edge_key", cells.filter("hot"), size, wider).withColumn("hot", F.lit(True)), "edge_key", "left")
    ends = edges.sparkSession.createDataFrame([(s,) for s in stops], "node string")
    left = stored(G.without_blocked(G.chains(touched, ends), F.coalesce("hot", F.lit(False))))
    return left, edges.count() - left.count()


def route(routes: DataFrame, city: str, start: tuple[float, float], end: tuple[float, float], incidents: DataFrame | None = None, size: float = 0.0025, percent: float = 90, rounds: int | None = None, wider: float = WIDER) -> Route:
    """The shortest route between two (lon, lat) points; with ``incidents`` it keeps off the densest cells."""
    spark = routes.sparkSession
    apart = spark.range(1).select(S.miles(F.lit(start[1]), F.lit(start[0]), F.lit(end[1]), F.lit(end[0]))).first()[0]
    if apart < NEAREST_MILES:
        raise NoRoute("start and end are the same place")
    edges, a = with_stop(network(routes, city), *start)
    edges, b = with_stop(edges, *end)
    blocked = 0
    if incidents is not None:
        edges, blocked = unblocked(edges, incidents, city, size, percent, [a, b], wider)
    paths = G.shortest_paths(edges.select("src", "dst", F.col("miles").alias("weight")), a, rounds)
    path = G.path_to(paths, b)
    if not path:
        raise NoRoute("start and end are not connected")
    total = paths.filter(F.col("node") == b).select("distance").first()[0]
    return Route([tuple(map(float, n.split(","))) for n in path], total, blocked)


def used_layers(route_nodes: DataFrame, routes: DataFrame, within: float = 2e-7, cell: float = 0.01) -> DataFrame:
    """layer_type, n: of the layers that hold a route's edge the one of highest priority. ``route_nodes``: nth, lon, lat.

    A line holds an edge if both ends lie on one of its segments, so parts of a segment that was split at a crossing or
    a stop are found, and lines that only touch an end are not. ``within`` allows for seven places on either side.
    Segments are dealt to the cells their boxes touch; an edge looks in the cell of its middle.
    """
    from ..sources.lines import PRIORITY

    at = lambda c: F.floor(c / cell).cast("bigint")
    touched = lambda a, b: F.explode(F.sequence(at(F.least(a, b) - within), at(F.greatest(a, b) + within)))
    before = route_nodes.select((F.col("nth") + 1).alias("nth"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    steps = route_nodes.select("nth", "lon", "lat").join(before, "nth").withColumns({"_i": at((F.col("lon") + F.col("_x")) / 2), "_j": at((F.col("lat") + F.col("_y")) / 2)})
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    edges = G.line_edges(routes.select("layer_type", parsed_points(F.col("geometry_json")).alias("points")), "points", "layer_type")
    edges = edges.withColumn("p", F.coalesce(F.try_element_at(rank, F.col("layer_type")), F.lit(0)))
    dealt = edges.withColumn("_i", touched("src_x", "dst_x")).withColumn("_j", touched("src_y", "dst_y"))
    off = lambda x, y: project(*map(F.col, (x, y, "src_x", "src_y", "dst_x", "dst_y")))["d2"]
    held = steps.join(dealt, ["_i", "_j"]).filter((off("lon", "lat") <= within * within) & (off("_x", "_y") <= within * within))
    return claim_by_priority(held, "layer_type", ["nth"], [F.col("p").desc()]).groupBy("layer_type").agg(F.count(F.lit(1)).alias("n"))
