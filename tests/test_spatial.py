"""Layers, networks and routes on small maps, and incremental loading."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from terrasift.operators import graph as G
from terrasift.operators import layers, routing
from terrasift.operators import spatial as P
from terrasift.operators.changes import TableStore
from terrasift.plans import spatial_queries
from terrasift.sources import lines
from terrasift.sources.schema import SCHEMAS
from terrasift.streaming.incremental import upsert_stream, watch


@pytest.fixture(scope="module")
def routes(spark):
    made = [("bike lanes", [(-80.0, 40.4), (-79.99, 40.4), (-79.98, 40.4)]), ("trails", [(-79.98, 40.4), (-79.98, 40.41), (-79.96, 40.41)]), ("sharrows", [(-80.0, 40.4), (-79.99, 40.4)]), ("trails", [(-80.0, 40.4), (-80.0, 40.42), (-79.96, 40.42), (-79.96, 40.41)]), ("trails", [(-70.0, 40.0), (-70.01, 40.0)])]
    out = None
    for i, (folder, points) in enumerate(made):
        raw = spark.createDataFrame([(points, str(i))], "points array<struct<x:double,y:double>>, name string")
        one = lines.lines(raw, "pittsburgh", folder, f"f{i}")
        out = one if out is None else out.unionByName(one)
    return out.cache()


def incident(spark, places):
    return spark.createDataFrame([("pittsburgh", x, y, w) for x, y, w in places], "city string, lon double, lat double, severity_weight double")


def test_heat_and_lines(spark, routes):
    cells, more = layers.heat(incident(spark, [(-80.0, 40.0, 2.0), (-80.0001, 40.0, 3.0), (-79.0, 40.0, 1.0), (0.0, 0.0, 9.0)]), -81, 39, -78, 41, 0.01, most=1)
    assert [(r["n"], r["weight"]) for r in cells.collect()] == [(2, 5.0)] and more
    found, more = layers.lines(routes, -80.1, 40.3, -79.97, 40.405)
    assert found.count() == 4 and not more
    own = {r["layer_type"]: len(r["pieces"]) for r in layers.lines(routes, -80.1, 40.3, -79.985, 40.405, exclusive=True)[0].collect()}
    assert own["bike_lanes"] == 2 and "sharrows" not in own


def test_choropleth(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0001), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    geometry = spark.createDataFrame([("a", ring), ("b", [(x + 10, y) for x, y in ring])], "tract_fips string, ring array<struct<x:double,y:double>>")
    attributes = spark.createDataFrame([("a", 5.0)], "tract_fips string, risk_score double").withColumns({c: F.lit(None).cast("string") for c in ("county_name", "state_name", "risk_ratng", "risk_npctl", "eal_valt", "sovi_ratng", "resl_ratng")})
    found, more = layers.choropleth(geometry, attributes, 0.5, 0.5, 2, 2)
    r = found.collect()
    assert len(r) == 1 and len(r[0]["ring"]) == 5 and r[0]["risk_score"] == 5.0 and not more


def test_points_in_polygons(spark):
    polygons = spark.createDataFrame([("p", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]), ("q", [(3.0, 3.0), (9.0, 3.0), (9.0, 9.0), (3.0, 3.0)])], "tract string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 8.0, 4.0), (3, 20.0, 20.0), (4, 3.9, 3.5), (5, None, 1.0)], "id int, x double, y double")
    found = {r["id"]: r["tract"] for r in P.assign_polygon(points, polygons, "x", "y", "tract", "ring", 2.0).collect()}
    assert found == {1: "p", 2: "q", 3: None, 4: "p", 5: None}  # the smallest key where two hold it


def test_shortest_paths_equal_dijkstra(spark):
    edges = {(a, b): (a * 7 + b * 3) % 11 + 1 for a, b in itertools.combinations(range(12), 2) if (a * b) % 3 == 1}
    df = spark.createDataFrame([(a, b, float(w)) for (a, b), w in edges.items()], "src long, dst long, weight double")
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    start = min(near)
    best, todo = {}, [(0, start)]
    while todo:
        d, x = heapq.heappop(todo)
        if x not in best:
            best[x] = d
            for y, w in near[x]:
                heapq.heappush(todo, (d + w, y))
    paths = G.shortest_paths(df, start)
    assert {r["node"]: r["distance"] for r in paths.collect()} == best
    end = max(best, key=best.get)
    path = G.path_to(paths, end)
    assert path[0] == start and path[-1] == end and G.path_to(paths, 99) == []


def test_shortest_path_has_no_horizon(spark, monkeypatch):
    line = spark.createDataFrame([(i, i + 1, 2.0) for i in range(30)], "src bigint, dst bigint, weight double")
    monkeypatch.setattr(spatial_queries, "_network", lambda spark, d: line)
    assert {r["node"]: r["distance"] for r in spatial_queries.shortest_path(spark, "").collect()} == {i: 2.0 * i for i in range(31)}
    with pytest.raises(RuntimeError):
        G.shortest_paths(line, 0, rounds=5)


def test_a_long_chain_is_one(spark):
    rng = random.Random(4)
    names = rng.sample(range(10**6), 3001)
    df = spark.createDataFrame([(min(e), max(e), i == 1500) for i, e in enumerate(zip(names, names[1:]))], "src bigint, dst bigint, hot boolean")
    chained = G.chains(df).cache()
    assert chained.count() == 3000 and chained.select("chain").distinct().count() == 1
    assert G.without_blocked(chained, F.col("hot")).count() == 0


def test_chains(spark):
    df = spark.createDataFrame([(1, 2, False), (2, 3, True), (3, 4, False), (4, 5, False), (4, 6, False), (7, 8, False), (8, 9, False), (7, 9, True)], "src int, dst int, hot boolean")
    chained = G.chains(df)
    groups = {}
    for r in chained.collect():
        groups.setdefault(r["chain"], set()).add((r["src"], r["dst"]))
    assert sorted(map(sorted, groups.values())) == [[(1, 2), (2, 3), (3, 4)], [(4, 5)], [(4, 6)], [(7, 8), (7, 9), (8, 9)]]
    assert {(r["src"], r["dst"]) for r in G.without_blocked(chained, F.col("hot")).collect()} == {(4, 5), (4, 6)}
    cut = G.chains(df, spark.createDataFrame([(3,)], "node int"))
    assert cut.select("chain").distinct().count() == 5


def test_routes(spark, routes):
    short = routing.route(routes, "pittsburgh", (-80.0, 40.4), (-79.96, 40.41))
    assert short.nodes[1] == (-79.99, 40.4) and short.miles == pytest.approx(2.8, abs=0.3) and short.minutes > 0
    hot = incident(spark, [(-79.99, 40.4, 9.0)] * 20 + [(-79.5, 40.0 + i / 100, 1.0) for i in range(30)])
    around = routing.route(routes, "pittsburgh", (-80.0, 40.4), (-79.96, 40.41), hot, percent=99)
    assert around.blocked_edges > 0 and (-80.0, 40.42) in around.nodes
    nodes = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(short.nodes)], "nth int, lon double, lat double")
    assert {r["layer_type"]: r["n"] for r in routing.used_layers(nodes, routes).collect()} == {"bike_lanes": 2, "trails": 2}
    halves = spark.createDataFrame([(0, -80.0, 40.4), (1, -79.9933333, 40.4), (2, -79.99, 40.4), (3, -79.99, 40.3)], "nth int, lon double, lat double")
    assert {r["layer_type"]: r["n"] for r in routing.used_layers(halves, routes).collect()} == {"bike_lanes": 2}
    legs = G.collapsed(G.directions(nodes.withColumn("k", F.lit(1)), "k", "nth"), "k", "nth")
    assert [r["turn"] for r in legs.orderBy("nth").collect()][0] == "start"
    for a, b in (((-80.0, 40.4), (-80.0, 40.4)), ((-80.0, 40.4), (0.0, 0.0)), ((-80.0, 40.4), (-70.0, 40.0))):
        with pytest.raises(routing.NoRoute):
            routing.route(routes, "pittsburgh", a, b)


def test_new_files_upsert(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    store = TableStore(spark, str(tmp_path / "store"))

    def load():
        upsert_stream(watch(spark, str(folder), "id int, v string"), store, "t", ["id"], str(tmp_path / "ck"), history="h", history_keys=["id", "v"]).awaitTermination()

    (folder / "a.csv").write_text("id,v\n1,a\n2,b\n")
    load()
    (folder / "b.csv").write_text("id,v\n2,c\n")
    load()
    load()
    assert {(r["id"], r["v"]) for r in store.read("t").collect()} == {(1, "a"), (2, "c")} and store.read("h").count() == 3


def test_schemas_have_their_keys():
    from terrasift.sources.schema import KEYS

    assert all(k is None or k in SCHEMAS[t] for t, k in KEYS.items()) and len(SCHEMAS["nri_tracts"]) == 34 and len(SCHEMAS["sold_homes"]) == 36


def test_noding(spark):
    edges = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0), (0.0, 2.0, 2.0, 0.0), (1.5, 0.0, 1.5, 1.5), (5.0, 5.0, 6.0, 5.0)], "src_x double, src_y double, dst_x double, dst_y double")
    got = {(r["src_x"], r["src_y"], r["dst_x"], r["dst_y"]) for r in G.noded(edges, 0.7).collect()}
    assert got == {(0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 1.5, 1.5), (1.5, 1.5, 2.0, 2.0), (0.0, 2.0, 1.0, 1.0), (1.0, 1.0, 1.5, 0.5), (1.5, 0.5, 2.0, 0.0), (1.5, 0.0, 1.5, 0.5), (1.5, 0.5, 1.5, 1.5), (5.0, 5.0, 6.0, 5.0)}


def test_avoidance_view(spark, routes):
    hot = incident(spark, [(-79.99, 40.4, 9.0)] * 20 + [(-79.5, 40.0 + i / 100, 1.0) for i in range(30)])
    view = routing.analysis(routes, hot, "pittsburgh", (-80.0, 40.4), (-79.96, 40.41), percent=99)
    assert view["hot"].count() == 1 and view["blocked"].count() >= 2 and view["open"].count() >= 2
    assert [r["layer_type"] for r in routing.facilities(routes, "pittsburgh", [(-80.0, 40.399), (-79.99, 40.401)]).collect()] == ["bike_lanes", "sharrows", "trails"]


def test_windows_meet_shapes_not_boxes(spark):
    from pyspark.sql import functions as F

    triangle = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    df = spark.createDataFrame([(triangle,)], "ring array<struct<x:double,y:double>>")
    windows = {(8, 8, 9, 9): False, (4, 4, 9, 9): True, (1, 1, 2, 2): True, (-5, -5, 20, 20): True, (-2, 3, -1, 4): False, (-1, 3, 12, 4): True, (5, 5, 6, 6): True, (5.1, 5.1, 6, 6): False}
    found = df.select(*[P.meets(F.col("ring"), *map(float, w)).alias(str(i)) for i, w in enumerate(windows)]).first()
    assert list(found) == list(windows.values())


def test_long_weighted_paths(spark):
    """Longer ways that are nearer come late; a path of many nodes is walked whole."""
    edges = [(i, i + 1, 1.0) for i in range(60)] + [(0, 60, 100.0), (0, 30, 29.5)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    paths = G.shortest_paths(df, 0)
    distances = {r["node"]: r["distance"] for r in paths.collect()}
    assert distances == {i: min(i, 29.5 + abs(30 - i)) for i in range(61)}
    assert G.path_to(paths, 60) == [0, *range(30, 61)] and G.path_to(paths, 0) == [0] and G.path_to(paths, 99) == []
    with pytest.raises(RuntimeError):
        G.shortest_paths(df, 0, rounds=3)


def test_square(spark):
    cells = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "x double, y double").withColumns({"r": P.square("x", "y", 1.0), "w": P.square("x", "y", 1.0, 0.25)})
    has = lambda ring, x: P.inside(F.lit(x), F.lit(2.0), F.col(ring))
    a, b = cells.select("r", has("r", 1.4), has("r", 1.6), has("w", 1.6), has("w", 1.8)).collect()
    assert tuple(a)[1:] == (True, False, True, False) and len(a["r"]) == 5 and a["r"][0] == a["r"][4] and b["r"] is None
