"""Networks as edge tables: building, chains, blocked parts, shortest paths, directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import linework
from .relational import islands
from .shared import discard, stored


def undirected(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """src < dst and the least weight of duplicates; loops go."""
    low, high = F.least(a, b), F.greatest(a, b)
    return edges.filter(F.col(a) != F.col(b)).groupBy(low.alias("src"), high.alias("dst")).agg(F.min(weight).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def line_edges(lines: DataFrame, points: str, *carry: str) -> DataFrame:
    """src_x, src_y, dst_x, dst_y, miles of the consecutive vertices of lines, each undirected edge once, the shortest kept."""
    v = F.col(points)
    steps = lines.select(*carry, F.explode(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("e"))
    r = lambda c: F.round(c, 7)
    flat = steps.select(*carry, r("e.a.x").alias("src_x"), r("e.a.y").alias("src_y"), r("e.b.x").alias("dst_x"), r("e.b.y").alias("dst_y"))
    flat = flat.filter("src_x != dst_x or src_y != dst_y").withColumn("miles", S.miles("src_y", "src_x", "dst_y", "dst_x"))
    return flat.groupBy(*carry, "src_x", "src_y", "dst_x", "dst_y").agg(F.min("miles").alias("miles"))


def noded(edges: DataFrame, cell: float) -> DataFrame:
    """Splits straight edges (src_x, src_y, dst_x, dst_y) where they cross, touch or overlap one another; adds miles."""
    return linework.noded(edges, cell).withColumn("miles", S.miles("src_y", "src_x", "dst_y", "dst_x"))


def shortest_paths(edges: DataFrame, start, rounds: int | None = None) -> DataFrame:
    """node, distance, previous: from ``start`` to every node it reaches. ``edges``: src, dst, weight, undirected.

    Each round relaxes the frontier, the nodes whose distance fell in the round before, and keeps of what it reaches
    the nodes that are new or nearer now. Frontiers are written one after another and hold few nodes more than once;
    they are folded into one distance for each node when they have grown as large as the folded part. It ends when no
    distance falls, which takes at most as many rounds as there are nodes unless a cycle has a negative sum; it raises
    beyond that, or beyond ``rounds``.
    """
    spark = edges.sparkSession
    steps = stored(both_ways(edges.select("src", "dst", "weight")))
    kind = edges.schema["src"].dataType.simpleString()
    known = stored(spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("previous")))
    frontier, parts, held, folded = known, [known], 1, 1
    most = rounds if rounds is not None else steps.count() + 1
    for _ in range(most):
        reached = frontier.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"))
        reached = reached.agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("previous"))).alias("b")).select("node", "b.*")
        was = reduce(DataFrame.unionByName, parts).select("node", F.col("distance").alias("was"))
        if len(parts) > 1:
            was = was.groupBy("node").agg(F.min("was").alias("was"))
        frontier = stored(reached.join(was, "node", "left").filter("was is null or distance < was").select("node", "distance", "previous"))
        n = frontier.count()
        if not n:
            out = stored(_nearest(parts))
            discard(steps, frontier, *parts)
            return out
        parts.append(frontier)
        held += n
        if held > 2 * folded or len(parts) > 16:
            whole = stored(_nearest(parts))
            discard(*parts[:-1])  # the last one is the next round's frontier
            parts, folded = [whole], whole.count()
            held = folded
    raise RuntimeError(f"shortest paths not settled after {most} rounds")


def _nearest(parts: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("node").agg(F.min(F.struct("distance", "previous")).alias("b")).select("node", "b.*")


def path_to(paths: DataFrame, end) -> list:
    """The nodes from the start to ``end``; empty if it is not reached.

    By doubling: each round replaces a node's pointer by its pointer's pointer and adds what that leads to, to the
    nodes on the path, so a path of n nodes takes log n joins. Only its own nodes are collected.
    """
    jump = stored(paths.select("node", F.col("previous").alias("to")))
    on = stored(jump.filter(F.col("node") == F.lit(end)).select("node"))
    n = 0
    while (now := on.count()) > n:
        n = now
        led = on.join(jump, "node").filter("to is not null").select(F.col("to").alias("node"))
        on, old = stored(on.unionByName(led).distinct()), on
        twice = jump.select("node", F.col("to").alias("half")).join(jump.select(F.col("node").alias("half"), "to"), "half", "left").select("node", "to")
        jump, old_jump = stored(twice.filter("to is not null")), jump
        discard(old, old_jump)
    rows = paths.join(on, "node").select("node", "previous").collect()
    previous = {r["node"]: r["previous"] for r in rows}
    out, at = [], end if end in previous else None
    while at is not None:
        out.append(at)
        at = previous[at]
    return out[::-1]


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) for every node that is not the smallest of its component, b being that smallest node.

    ``pairs``: links (a, b), a > b. Large and small star contractions take turns. What a join looks up is written
    before it, so that either side of the join is a plain exchange and Spark can split a node with many links.
    """
    pairs, before = stored(pairs.select("a", "b")), None
    for _ in range(max_rounds):
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            return pairs
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = stored(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        discard(pairs, least, large, lowest)
        pairs = after
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def contracted(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for the nodes of ``links`` (a, b, of any direction) that aren't their own root; one root a component.

    For paths of hashed numbers: each round a node goes over to the least of itself and its neighbours, and what is left
    are the links between these. About half of the nodes are left by a round, so all rounds together move about twice
    what the first does, where star contractions move all in each. Then roots go back the other way, round by round.
    """
    moves: list[DataFrame] = []
    links = stored(links.select("a", "b"))
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        least = both_ways(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to"))
        moves.append(stored(least.filter("to < node")))
        to = moves[-1]
        near = links.join(to.withColumnsRenamed({"node": "a", "to": "x"}), "a", "left").select(F.coalesce("x", "a").alias("a"), "b")
        left = near.join(to.withColumnsRenamed({"node": "b", "to": "x"}), "b", "left").select("a", F.coalesce("x", "b").alias("b"))
        links, old = stored(left.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), links
        discard(old)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    root = moves.pop() if moves else links.select(F.col("a").alias("node"), F.col("b").alias("to"))
    while moves:
        to = moves.pop()
        further = root.select(F.col("node").alias("to"), F.col("to").alias("root"))
        own = to.join(further, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
        root, old = stored(own.unionByName(root).distinct()), root  # a node may have moved in both rounds
        discard(to, old)
    return root.select("node", F.col("to").alias("root"))


def chains(edges: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Adds ``chain`` to undirected edges: edges that meet at a node of degree two, not in ``boundary``, share one.

    The label is an edge number of the chain; ``contracted`` finds it, whatever the chain's length.
    """
    numbered = stored(edges.withColumn("edge", F.xxhash64("src", "dst")))
    ends = numbered.select(F.explode(F.array("src", "dst")).alias("node"), "edge")
    inner = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("edge").alias("a"), F.min("edge").alias("b")).filter("degree = 2 and a != b")
    if boundary is not None:
        inner = inner.join(boundary.select("node"), "node", "left_anti")
    label = contracted(inner.select("a", "b")).select(F.col("node").alias("edge"), F.col("root").alias("chain"))
    return numbered.join(label, "edge", "left").withColumn("chain", F.coalesce("chain", "edge")).drop("edge")


def without_blocked(chained: DataFrame, blocked: Column) -> DataFrame:
    """Drops every edge of a chain in which any edge is blocked."""
    return chained.join(chained.filter(blocked).select("chain").distinct(), "chain", "left_anti")


def directions(path: DataFrame, key: str, order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Legs of an ordered path: bearing, miles and turn from the leg before."""
    w = Window.partitionBy(key).orderBy(order)
    legs = path.withColumns({"_x": F.lead(lon).over(w), "_y": F.lead(lat).over(w)}).filter("_x is not null")
    legs = legs.withColumns({"bearing": S.bearing(lat, lon, "_y", "_x"), "miles": S.miles(lat, lon, "_y", "_x")}).drop("_x", "_y")
    return legs.withColumn("turn", F.coalesce(S.turn(F.lag("bearing").over(w), "bearing"), F.lit("start")))


def collapsed(legs: DataFrame, key: str, order: str, most: int = 20) -> DataFrame:
    """Runs of straight legs become one; at most ``most`` instructions for each path."""
    runs = islands(legs.withColumn("_turn", F.when(F.col("turn") == "straight", "straight").otherwise(F.concat("turn", F.lit("#"), F.col(order).cast("string")))), [key], [F.col(order)], "_turn")
    out = runs.groupBy(key, "island").agg(F.min(order).alias(order), F.min_by("turn", order).alias("turn"), F.sum("miles").alias("miles"))
    return out.filter(F.col("island") <= most)
