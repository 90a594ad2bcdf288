"""Registered queries: grids, distances, polygons and networks, each with its DuckDB oracle.

Quantity and discount of a line item stand for the two coordinates of an incident, its price for the weight.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as G
from ..operators import linework, routing
from ..operators import relational as R
from ..operators import spatial as P
from ..operators.shared import stored
from .relational_queries import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT cell_x, cell_y, n, round(weight, 2) AS weight FROM (SELECT round(l_quantity / 5.0) * 5.0 AS cell_x, round(l_extendedprice / 10000.0) * 10000.0 AS cell_y, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS weight FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 GROUP BY 1, 2)")
def grid_heatmap(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_quantity").between(5.0, 45.0)).withColumn("y", F.col("l_extendedprice") / 2000)
    cells = P.grid(rows, "l_quantity", "y", 5.0, "l_extendedprice")
    return cells.select("cell_x", (F.col("cell_y") * 2000).alias("cell_y"), "n", F.round("weight", 2).alias("weight"))


_HOT = """WITH cells AS (SELECT round(l_quantity / 2.0) * 2.0 AS cell_x, round(l_linenumber / 2.0) * 2.0 AS cell_y, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2),
rated AS (SELECT *, round(0.75 * n / greatest(max(n) OVER (), 1) + 0.25 * weight / greatest(max(weight) OVER (), 1.0), 4) AS intensity FROM cells),
ranked AS (SELECT *, row_number() OVER (ORDER BY intensity) - 1 AS at_, count(*) OVER () AS total FROM rated)
SELECT cell_x, cell_y, n, intensity FROM rated WHERE intensity >= (SELECT intensity FROM ranked WHERE at_ = CAST(floor(0.9 * (total - 1)) AS BIGINT))"""


@query(_HOT)
def hotspot_cells(spark, d):
    cells = P.intensity(P.grid(table(spark, d, "lineitem"), "l_quantity", "l_linenumber", 2.0, "l_extendedprice"))
    threshold = R.floor_index_percentile(cells, "intensity", 90)
    return cells.filter(F.col("intensity") >= threshold).select("cell_x", "cell_y", "n", "intensity")


_MILES = "2 * 3958.7613 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({q} - {p}) / 2), 2))))"


@query(f"SELECT l_orderkey, l_linenumber, round({_MILES.format(a='40.0', b='(40.0 + l_quantity / 100)', p='-80.0', q='(-80.0 + l_tax)')}, 6) AS miles FROM lineitem")
def haversine_pairs(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.miles(F.lit(40.0), F.lit(-80.0), F.lit(40.0) + F.col("l_quantity") / 100, F.lit(-80.0) + F.col("l_tax")), 6).alias("miles"))


_LEGS = """WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, 40 + l_quantity / 100 AS lat, -80 + l_extendedprice / 1000000 AS lon FROM lineitem),
q AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY nth)),
b AS (SELECT l_orderkey, nth, (degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360 AS bearing FROM q WHERE lat2 IS NOT NULL),
t AS (SELECT *, (bearing - lag(bearing) OVER (PARTITION BY l_orderkey ORDER BY nth) + 540) % 360 - 180 AS delta FROM b),
n AS (SELECT *, CASE WHEN delta IS NULL THEN 'start' WHEN delta > 55 THEN 'right' WHEN delta > 25 THEN 'slight right' WHEN delta < -55 THEN 'left' WHEN delta < -25 THEN 'slight left' ELSE 'straight' END AS turn FROM t)"""


def _legs(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (40 + F.col("l_quantity") / 100).alias("lat"), (-80 + F.col("l_extendedprice") / 1000000).alias("lon"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return G.directions(lines.withColumn("nth", F.row_number().over(w).cast("bigint")), "l_orderkey", "nth")


@query(_LEGS + " SELECT l_orderkey, nth, turn, round(bearing, 4) AS bearing FROM n")
def bearing_turns(spark, d):
    return _legs(spark, d).select("l_orderkey", "nth", "turn", F.round("bearing", 4).alias("bearing"))


@query(_LEGS + """, r AS (SELECT *, CASE WHEN turn = 'straight' AND lag(turn) OVER w = 'straight' THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY nth)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY nth ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT l_orderkey, CAST(island AS BIGINT) AS island, min(nth) AS nth, min_by(turn, nth) AS turn FROM i WHERE island <= 20 GROUP BY l_orderkey, island""")
def run_collapse(spark, d):
    return G.collapsed(_legs(spark, d), "l_orderkey", "nth").select("l_orderkey", "island", "nth", "turn")


@query("""SELECT l_orderkey, min(l_quantity) AS min_lon, min(l_extendedprice) AS min_lat, max(l_quantity) AS max_lon, max(l_extendedprice) AS max_lat FROM lineitem GROUP BY 1
HAVING min(l_quantity) <= 20 AND max(l_quantity) >= 10 AND min(l_extendedprice) <= 20000 AND max(l_extendedprice) >= 10000""")
def feature_bbox(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))).alias("points"))
    return lines.select("l_orderkey", P.box(F.col("points")).alias("b")).select("l_orderkey", "b.*").filter(P.overlaps(10.0, 10000.0, 20.0, 20000.0))


_RINGS = {1: [(5, 1000), (30, 8000), (20, 60000), (8, 40000), (5, 1000)], 2: [(28, 20000), (45, 30000), (40, 90000), (25, 70000), (28, 20000)]}


def _ring_sql(ring) -> str:
    return " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / nullif({by} - {ay}, 0) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in ((tuple(f"{float(v)!r}::DOUBLE" for v in a), tuple(f"{float(v)!r}::DOUBLE" for v in b)) for a, b in zip(ring, ring[1:])))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice AS y FROM lineitem),
t AS (SELECT *, CASE WHEN ({_ring_sql(_RINGS[1])}) % 2 = 1 THEN 1 WHEN ({_ring_sql(_RINGS[2])}) % 2 = 1 THEN 2 END AS tract FROM p) SELECT tract, count(*) AS n FROM t GROUP BY 1""")
def point_in_polygon(spark, d):
    points = table(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    rings = spark.createDataFrame([(k, [(float(x), y / 1000) for x, y in v]) for k, v in _RINGS.items()], "tract int, ring array<struct<x:double,y:double>>")
    return P.assign_polygon(points, rings, "l_quantity", "y", "tract", "ring", 10.0).groupBy("tract").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_partkey, l_suppkey, l_orderkey, p FROM (SELECT l_partkey, l_suppkey, l_orderkey, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS p,
row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END DESC, l_orderkey) AS nth FROM lineitem) WHERE nth = 1""")
def priority_overlap(spark, d):
    priority = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", priority.alias("p"))
    return P.claim_by_priority(rows, "l_orderkey", ["l_partkey", "l_suppkey"], [F.col("p").desc()])


@query("SELECT least(c_nationkey, s) AS src, greatest(c_nationkey, s) AS dst, min(p) AS weight FROM (SELECT c_nationkey, o_orderkey % 25 AS s, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey) WHERE c_nationkey <> s GROUP BY 1, 2")
def graph_edges_min(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("bigint").alias("a"), (F.col("o_orderkey") % 25).alias("b"), "o_totalprice")
    return G.undirected(rows, "a", "b", "o_totalprice")


#: Edges of a network of suppliers and the parts they ship: sparse, with many nodes of degree two.
_NETWORK = "SELECT least(a, b) AS src, greatest(a, b) AS dst, min(w) AS weight FROM (SELECT o_custkey AS a, (o_custkey * 7 + o_orderkey % 3) % (SELECT count(*) FROM customer) AS b, CAST(1 + o_custkey % 5 AS DOUBLE) AS w FROM orders) WHERE a <> b GROUP BY 1, 2"


def _network(spark, d):
    n = table(spark, d, "customer").count()
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % n).alias("b"), (1 + F.col("o_custkey") % 5).cast("double").alias("w"))
    return G.undirected(rows, "a", "b", "w")


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_NETWORK}), both_ways AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
walk(node, distance) USING KEY (node) AS (SELECT 0::BIGINT AS node, 0::DOUBLE AS distance UNION
SELECT dst, min(w.distance + weight) FROM walk w JOIN both_ways ON src = w.node LEFT JOIN recurring.walk r ON r.node = dst WHERE r.node IS NULL OR w.distance + weight < r.distance GROUP BY dst)
SELECT node, distance FROM walk""")
def shortest_path(spark, d):
    """From customer 0 to all it reaches, over the weighted network of all orders."""
    return G.shortest_paths(_network(spark, d), 0).select("node", "distance")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS chain, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, o_orderstatus FROM orders),
flagged AS (SELECT DISTINCT chain FROM e WHERE o_orderstatus = 'P' AND nth <= 3) SELECT chain, count(*) - 1 AS edges FROM e WHERE chain NOT IN (SELECT chain FROM flagged) GROUP BY 1 HAVING count(*) > 1""")
def chain_contraction(spark, d):
    """Each customer's orders in time form a path; the path is one chain, and goes whole if an early part is blocked."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.lead("o_orderkey").over(w).alias("next"), F.lead("o_orderstatus").over(w).alias("next_status"), F.row_number().over(w).alias("nth"))
    hot = ((F.col("o_orderstatus") == "P") & (F.col("nth") <= 3)) | ((F.col("next_status") == "P") & (F.col("nth") + 1 <= 3))
    edges = orders.filter("next is not null").select(F.least("o_orderkey", "next").alias("src"), F.greatest("o_orderkey", "next").alias("dst"), "o_custkey", hot.alias("hot"))
    left = G.without_blocked(stored(G.chains(edges)), F.col("hot"))
    return left.groupBy("chain").agg(F.min("o_custkey").alias("c"), F.count(F.lit(1)).alias("edges")).select(F.col("c").alias("chain"), "edges")


@query("""WITH q AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part), e AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS ax, s_acctbal / 500 AS ay, CAST(s_suppkey % 50 + 3 AS DOUBLE) AS bx, s_acctbal / 500 + 2 AS by_ FROM supplier),
t AS (SELECT s_suppkey, greatest(0.0, least(1.0, ((12.5 - ax) * 3 + (9.25 - ay) * 2) / 13.0)) AS t, ax, ay FROM e) SELECT s_suppkey, round(t, 6) AS t FROM t ORDER BY pow(12.5 - (ax + t * 3), 2) + pow(9.25 - (ay + t * 2), 2), s_suppkey LIMIT 1""")
def snap_nearest_edge(spark, d):
    ax, ay = (F.col("s_suppkey") % 50).cast("double"), F.col("s_acctbal") / 500
    edges = table(spark, d, "supplier").select("s_suppkey", ax.alias("src_x"), ay.alias("src_y"), (ax + 3).alias("dst_x"), (ay + 2).alias("dst_y"))
    return P.snap(edges, 12.5, 9.25, 2000.0).select("s_suppkey", F.round("at.t", 6).alias("t"))


@query("""WITH q AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part WHERE p_partkey % 50 = 0), e AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS ax, s_acctbal / 500 AS ay FROM supplier),
t AS (SELECT p_partkey, s_suppkey, greatest(0.0, least(1.0, ((x - ax) * 3 + (y - ay) * 2) / 13.0)) AS t, x, y, ax, ay FROM q, e), d AS (SELECT *, pow(x - (ax + t * 3), 2) + pow(y - (ay + t * 2), 2) AS d2 FROM t)
SELECT p_partkey, s_suppkey, round(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d2, s_suppkey) AS nth FROM d WHERE d2 <= 4) WHERE nth = 1""")
def snap_nearest_edges(spark, d):
    """Every part whose id is divisible by 50 is a stop; an edge is near if it is at most 2 away."""
    ax, ay = (F.col("s_suppkey") % 50).cast("double"), F.col("s_acctbal") / 500
    edges = table(spark, d, "supplier").select("s_suppkey", ax.alias("src_x"), ay.alias("src_y"), (ax + 3).alias("dst_x"), (ay + 2).alias("dst_y"))
    stops = table(spark, d, "part").filter("p_partkey % 50 = 0").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return P.nearest_edges(stops, edges, "p_partkey", "x", "y", "s_suppkey", 2.0).select("p_partkey", "s_suppkey", F.round("t", 6).alias("t"))


@query("""WITH c AS (SELECT CAST(floor(l_quantity / 5.0 + 0.5) AS BIGINT) AS i, CAST(floor(l_linenumber / 5.0 + 0.5) AS BIGINT) AS j, round(count(*) / 100.0, 4) AS intensity FROM lineitem GROUP BY 1, 2),
s AS (SELECT s_suppkey, k, CAST(s_suppkey % 40 AS DOUBLE) + 10.0 * k / 10 AS x, CAST(s_suppkey % 5 AS DOUBLE) + 2.0 * k / 10 AS y FROM supplier, range(11) r(k)),
m AS (SELECT s_suppkey, coalesce(intensity, 0) AS v FROM s LEFT JOIN c ON i = CAST(floor(x / 5.0 + 0.5) AS BIGINT) AND j = CAST(floor(y / 5.0 + 0.5) AS BIGINT))
SELECT s_suppkey, round(avg(v), 6) AS mean_intensity, max(v) AS max_intensity FROM m GROUP BY 1""")
def edge_exposure(spark, d):
    cells = table(spark, d, "lineitem").groupBy(S.cell_index("l_quantity", 5.0).alias("i"), S.cell_index("l_linenumber", 5.0).alias("j")).agg(F.round(F.count(F.lit(1)) / 100, 4).alias("intensity")).withColumn("hot", F.col("intensity") > 1)
    ax, ay = (F.col("s_suppkey") % 40).cast("double"), (F.col("s_suppkey") % 5).cast("double")
    edges = table(spark, d, "supplier").select("s_suppkey", ax.alias("src_x"), ay.alias("src_y"), (ax + 10).alias("dst_x"), (ay + 2).alias("dst_y"))
    return P.exposure(edges, "s_suppkey", cells, 5.0).drop("hot_share")


@query("""SELECT DISTINCT l_returnflag AS layer_type, l_linestatus AS layer_label FROM (SELECT l_returnflag, l_linestatus, min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e
FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus) WHERE a <= 12 AND b >= 10 AND c <= 11000 AND e >= 10000""")
def facilities_near_route(spark, d):
    boxes = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("layer_type"), F.col("l_linestatus").alias("layer_label"))
    boxes = boxes.agg(F.min("l_quantity").alias("min_lon"), F.max("l_quantity").alias("max_lon"), F.min("l_extendedprice").alias("min_lat"), F.max("l_extendedprice").alias("max_lat"))
    return routing.facilities(boxes.withColumn("city", F.lit("one")), "one", [(10.0, 10000.0), (12.0, 11000.0)])


@query("""WITH e AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS ax, p_retailprice / 100 AS ay FROM part), f AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS cx, s_acctbal / 500 AS cy FROM supplier),
t AS (SELECT p_partkey, s_suppkey, ((cx - ax) * 5.0 - (cy - ay) * 1.0) / (4.0 * 5.0 - 3.0 * 1.0) AS t, ((cx - ax) * 3.0 - (cy - ay) * 4.0) / (4.0 * 5.0 - 3.0 * 1.0) AS u FROM e, f)
SELECT p_partkey, count(*) AS crossings FROM t WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 GROUP BY 1""")
def line_crossings(spark, d):
    """Two families of parallel lines: how many of the other a line crosses. Equal lines are one and are counted; a line
    of the second family lies in the grid cell of its start, one of the first looks in all cells where such a start may be."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("ax"), (F.col("p_retailprice") / 100).alias("ay"))
    b = table(spark, d, "supplier").select((F.col("s_suppkey") % 50).cast("double").alias("cx"), (F.col("s_acctbal") / 500).alias("cy"))
    b = b.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    at = lambda v: F.floor(v / 4).cast("bigint")
    starts = lambda v, least, most: F.explode(F.sequence(at(v + least - 0.001), at(v + most + 0.001)))
    a = part.select("ax", "ay").distinct().withColumn("i", starts(F.col("ax"), -1, 4)).withColumn("j", starts(F.col("ay"), -5, 3))
    met = a.join(b.withColumns({"i": at(F.col("cx")), "j": at(F.col("cy"))}), ["i", "j"])
    px, py = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    hits = met.filter((((px * 5.0 - py) / 17.0) > 0) & (((px * 5.0 - py) / 17.0) < 1) & (((px * 3.0 - py * 4.0) / 17.0) >= 0) & (((px * 3.0 - py * 4.0) / 17.0) <= 1))
    return part.join(hits.groupBy("ax", "ay").agg(F.sum("n").alias("n")), ["ax", "ay"]).groupBy("p_partkey").agg(F.sum("n").alias("crossings"))


_STRAIGHT = """SELECT s_suppkey, CAST(s_suppkey % 40 AS DOUBLE) AS ax, CAST(s_suppkey % 7 AS DOUBLE) AS ay, CAST(s_suppkey % 40 + 10 + s_suppkey % 23 AS DOUBLE) AS bx, CAST(s_suppkey % 7 + s_suppkey % 5 - 2 AS DOUBLE) AS by_ FROM supplier"""


def _straight(spark, d):
    k = F.col("s_suppkey")
    ends = {"src_x": k % 40, "src_y": k % 7, "dst_x": k % 40 + 10 + k % 23, "dst_y": k % 7 + k % 5 - 2}
    return table(spark, d, "supplier").select("s_suppkey", *[c.cast("double").alias(n) for n, c in ends.items()])


def _cells(spark, d):
    cells = table(spark, d, "lineitem").groupBy(S.cell_index("l_quantity", 3.0).alias("i"), S.cell_index("l_linenumber", 3.0).alias("j")).agg(F.round(F.count(F.lit(1)) / 100, 4).alias("intensity"))
    return cells.withColumn("hot", F.col("i") % 4 == 1)


_CELLS_SQL = "SELECT CAST(floor(l_quantity / 3.0 + 0.5) AS BIGINT) AS i, CAST(floor(l_linenumber / 3.0 + 0.5) AS BIGINT) AS j, round(count(*) / 100.0, 4) AS intensity, floor(l_quantity / 3.0 + 0.5) % 4 = 1 AS hot FROM lineitem GROUP BY ALL"
#: Of each edge and cell the stretch of the edge within the cell, widened by a margin: Liang and Barsky's clipping.
_CLIP = """clip AS (SELECT s_suppkey, i, j, intensity, hot,
  greatest(0, CASE WHEN bx = ax THEN CASE WHEN abs(i * 3.0 - ax) <= {h} THEN 0 ELSE 2 END ELSE least((i * 3.0 - {h} - ax) / (bx - ax), (i * 3.0 + {h} - ax) / (bx - ax)) END,
    CASE WHEN by_ = ay THEN CASE WHEN abs(j * 3.0 - ay) <= {h} THEN 0 ELSE 2 END ELSE least((j * 3.0 - {h} - ay) / (by_ - ay), (j * 3.0 + {h} - ay) / (by_ - ay)) END) AS s,
  least(1, CASE WHEN bx = ax THEN 1 ELSE greatest((i * 3.0 - {h} - ax) / (bx - ax), (i * 3.0 + {h} - ax) / (bx - ax)) END,
    CASE WHEN by_ = ay THEN 1 ELSE greatest((j * 3.0 - {h} - ay) / (by_ - ay), (j * 3.0 + {h} - ay) / (by_ - ay)) END) AS t
  FROM e, c)"""


@query(f"""WITH e AS ({_STRAIGHT}), c AS ({_CELLS_SQL}), {_CLIP.format(h='1.5')},
kept AS (SELECT s_suppkey, intensity, hot, t - s AS share FROM clip JOIN e USING (s_suppkey) WHERE t > s AND NOT (by_ = ay AND (ay / 3.0 - 0.5) = floor(ay / 3.0 - 0.5) AND j <> floor(ay / 3.0 + 0.5)))
SELECT e.s_suppkey, round(coalesce(sum(intensity * share), 0), 9) AS mean_intensity, coalesce(max(intensity) FILTER (share > 1e-9), 0) AS max_intensity, round(coalesce(sum(share) FILTER (hot), 0), 9) AS hot_share
FROM e LEFT JOIN kept USING (s_suppkey) GROUP BY 1""")
def edge_exposure_by_length(spark, d):
    """What each line passes of the cells, weighted by the length in each."""
    found = linework.exposure_by_length(_straight(spark, d), "s_suppkey", _cells(spark, d), 3.0)
    return found.select("s_suppkey", F.round("mean_intensity", 9).alias("mean_intensity"), "max_intensity", F.round("hot_share", 9).alias("hot_share"))


@query(f"WITH e AS ({_STRAIGHT}), c AS ({_CELLS_SQL}), {_CLIP.format(h='1.7')} SELECT DISTINCT s_suppkey FROM clip WHERE hot AND s <= t")
def edges_meeting_cells(spark, d):
    """Lines that meet the square of a hot cell, widened by 0.2."""
    return linework.meeting(_straight(spark, d), "s_suppkey", _cells(spark, d).filter("hot"), 3.0, 0.2)


_CROSSING = """pairs AS (SELECT a.ax + (a.bx - a.ax) * ((b.ax - a.ax) * (b.by_ - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / ((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax)) AS x,
  a.ay + (a.by_ - a.ay) * ((b.ax - a.ax) * (b.by_ - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / ((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax)) AS y,
  ((b.ax - a.ax) * (b.by_ - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / ((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax)) AS t,
  ((b.ax - a.ax) * (a.by_ - a.ay) - (b.ay - a.ay) * (a.bx - a.ax)) / ((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax)) AS u
  FROM e a, e b WHERE (a.bx - a.ax) * (b.by_ - b.ay) <> (a.by_ - a.ay) * (b.bx - b.ax))"""


@query(f"""WITH e AS (SELECT DISTINCT ax, ay, bx, by_ FROM ({_STRAIGHT})), {_CROSSING},
spots AS (SELECT DISTINCT round(x, 7) AS x, round(y, 7) AS y FROM (SELECT x, y FROM pairs WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 UNION ALL SELECT ax, ay FROM e UNION ALL SELECT bx, by_ FROM e)),
held AS (SELECT e.*, x, y, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)) AS t FROM e JOIN spots ON x BETWEEN ax AND bx AND abs(ay + (by_ - ay) * (x - ax) / (bx - ax) - y) <= 1e-7),
steps AS (SELECT x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM held WINDOW w AS (PARTITION BY ax, ay, bx, by_ ORDER BY t))
SELECT DISTINCT round(x, 5) AS src_x, round(y, 5) AS src_y, round(x2, 5) AS dst_x, round(y2, 5) AS dst_y FROM steps WHERE x2 IS NOT NULL""")
def noded_network(spark, d):
    """The pieces between all places where lines cross, touch or overlap."""
    return G.noded(_straight(spark, d), 8.0).select(*[F.round(c, 5).alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")])


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS feature, l_suppkey % 50 AS y, l_returnflag AS layer, CAST(l_partkey % 60 AS DOUBLE) AS a, l_partkey % 60 + l_quantity AS b FROM lineitem),
bounds AS (SELECT y, a AS x FROM e UNION SELECT y, b FROM e), parts AS (SELECT y, x, lead(x) OVER (PARTITION BY y ORDER BY x) AS x2 FROM bounds),
owned AS (SELECT p.y, p.x, p.x2, min(layer) AS layer FROM parts p JOIN e ON e.y = p.y AND e.a <= p.x AND e.b >= p.x2 WHERE p.x2 IS NOT NULL GROUP BY ALL)
SELECT layer, round(sum(x2 - x), 4) AS length FROM owned GROUP BY layer""")
def length_by_priority(spark, d):
    """On fifty straight lines each layer keeps what no layer before it covers."""
    k = F.col("l_partkey") % 60
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("feature"), (F.col("l_suppkey") % 50).cast("double").alias("src_y"), F.col("l_returnflag").alias("layer"), k.cast("double").alias("src_x"), (k + F.col("l_quantity")).alias("dst_x"))
    merged = linework.stretches(rows, ["src_y", "layer"], "src_x", "dst_x").withColumns({"dst_y": F.col("src_y"), "feature": F.concat_ws("/", "src_y", "layer", "src_x")})
    left = linework.uncovered(merged, "feature", ["layer"], 20.0)
    return left.groupBy("layer").agg(F.round(F.sum((F.col("u") - F.col("t")) * (F.col("dst_x") - F.col("src_x"))), 4).alias("length"))
