"""Simplification that keeps shared borders: neighbours keep the same vertices, so no gap or overlap opens between them.

Where borders part is seen from the vertices alone: a vertex with other than two different neighbours, over all rings,
is a node. Rings are cut at nodes; a stretch between two nodes is simplified in a direction that does not depend on the
ring, so all rings that share it keep the same vertices, and no ring has to meet its neighbours for that. A ring that
would lose its area makes three of its vertices nodes for everyone. Vertices meet by place and rings by their own row;
no task holds more than a ring or the different neighbours of a vertex, which are counted in part before they shuffle.

Defined results: rings stay where they are null, hold a null coordinate or have fewer than three different vertices; an
open ring is closed; repeated rows are simplified alike; a border counts as shared where its vertices are equal, a vertex
that only lies on another's edge is none of its; other columns are returned as they are; no rows in, no rows out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .spatial import kept_places


def _open(xs, ys) -> tuple[list[int], list[tuple[float, float]]] | None:
    """Places and points of a ring without repeats in a row and without its closing point; None if it must stay as it is."""
    if xs is None or any(v is None or v != v for v in [*xs, *ys]):
        return None
    points = [(x + 0.0, y + 0.0) for x, y in zip(xs, ys)]  # no negative zero
    places = [i for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
    while len(places) > 1 and points[places[-1]] == points[places[0]]:
        places.pop()
    points = [points[i] for i in places]
    return (places, points) if len(set(points)) > 2 else None


def _corners(points: list[tuple[float, float]]) -> list[int]:
    """Three vertices that depend on the shape only: the least, the one farthest from it, the one farthest from both."""
    order = sorted(range(len(points)), key=points.__getitem__)
    a = order[0]
    ax, ay = points[a]
    b = max(order, key=lambda i: (points[i][0] - ax) ** 2 + (points[i][1] - ay) ** 2)
    dx, dy = points[b][0] - ax, points[b][1] - ay
    c = max((i for i in order if points[i] not in (points[a], points[b])), key=lambda i: abs((points[i][0] - ax) * dy - (points[i][1] - ay) * dx))
    return [a, b, c]


def kept_of_ring(xs, ys, nodes, tolerance: float) -> list[int] | None:
    """Places of the ring's vertices that stay, the first of them again at the end; None: all stay. ``nodes``: places."""
    if (ring := _open(xs, ys)) is None:
        return None
    places, points = ring
    n, marked = len(points), {(xs[i] + 0.0, ys[i] + 0.0) for i in nodes} if nodes is not None else set()
    cuts = [i for i, p in enumerate(points) if p in marked] or sorted(_corners(points))
    kept = set(cuts)
    for first, last in zip(cuts, [*cuts[1:], cuts[0] + n]):
        stretch = [i % n for i in range(first, last + 1)]
        if [points[i] for i in stretch] > [points[i] for i in reversed(stretch)]:
            stretch.reverse()
        kept.update(stretch[i] for i in kept_places([points[i] for i in stretch], tolerance))
    found = [places[i] for i in sorted(kept)]
    return [*found, found[0]]


def _keeps(tolerance: float):
    @F.pandas_udf("array<int>")
    def keeps(xs: pd.Series, ys: pd.Series, nodes: pd.Series) -> pd.Series:
        return pd.Series([kept_of_ring(*ring, tolerance) for ring in zip(xs, ys, nodes)], dtype=object)

    return keeps


def _spare():
    @F.pandas_udf("array<int>")
    def spare(xs: pd.Series, ys: pd.Series) -> pd.Series:
        rings = (_open(x, y) for x, y in zip(xs, ys))
        return pd.Series([r and [r[0][i] for i in _corners(r[1])] for r in rings], dtype=object)

    return spare


def simplify_shared(shapes: DataFrame, tolerance: float, ring: str = "ring") -> DataFrame:
    """``shapes`` with ``ring`` (array of struct(x, y)) simplified: no vertex that goes is farther than ``tolerance`` from
    what stays of its stretch."""
    columns = shapes.columns
    rows = stored(shapes.select(F.struct(*(f"`{c}`" for c in columns)).alias("row"), F.monotonically_increasing_id().alias("id")))
    v = F.col("row")[ring]
    xs, ys = F.transform(v, lambda p: p["x"] + 0.0), F.transform(v, lambda p: p["y"] + 0.0)
    points = F.transform(v, lambda p: F.struct((p["x"] + 0.0).alias("x"), (p["y"] + 0.0).alias("y")))
    whole = rows.filter(~F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull()))
    steps = whole.select(F.explode(F.arrays_zip(points.alias("a"), F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1)).alias("b"))).alias("e")).filter("e.a <> e.b")
    ends = steps.select(F.explode(F.array(F.struct("e.a", "e.b"), F.struct(F.col("e.b").alias("a"), F.col("e.a").alias("b")))).alias("e"))
    nodes = stored(ends.groupBy(F.col("e.a.x").alias("x"), F.col("e.a.y").alias("y")).agg(F.count_distinct("e.b").alias("n")).filter("n <> 2").select("x", "y"))
    vertices = whole.select("id", F.posexplode(points).alias("at", "p")).select("id", "at", "p.x", "p.y")

    def judged(nodes: DataFrame) -> DataFrame:
        marks = vertices.join(nodes, ["x", "y"], "left_semi").groupBy("id").agg(F.collect_list("at").alias("nodes"))
        return rows.join(marks, "id", "left").withColumn("kept", _keeps(tolerance)(xs, ys, "nodes"))

    flat = judged(nodes).filter(F.size("kept") < 4).select(F.explode(_spare()(xs, ys)).alias("i"), points.alias("v"))
    more = stored(flat.select(F.col("v")[F.col("i")].alias("p")).select("p.x", "p.y"))
    done = judged(nodes.unionByName(more).distinct())
    thin = F.when(F.col("kept").isNull(), v).otherwise(F.transform("kept", lambda i: v[i]))
    return done.select(F.struct(*[(thin if c == ring else F.col("row")[c]).alias(c) for c in columns]).alias("row")).select("row.*")
