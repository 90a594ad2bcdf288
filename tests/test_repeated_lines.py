"""Lines, stops and edges that are repeated under other keys: equal ones meet once, and results equal the SQL."""

import pytest
from pyspark.sql import functions as F

from terrasift.operators import spatial as P
from terrasift.plans import registry
from tests.compare import database, same
from tests.conftest import DATA


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("copies")
    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey")):
        rows = spark.read.parquet(str(DATA / "sf0.01" / f"{name}.parquet"))
        spark.range(7).select(F.col("id").alias("copy")).crossJoin(rows).withColumn(key, F.col(key) + F.col("copy") * 5000).drop("copy").write.parquet(f"{folder}/{name}.parquet")
    return folder


def most_rows(df):
    """The largest number of rows that a join of the plan returns."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        while "Adaptive" in p.nodeName() or "QueryStage" in p.nodeName():
            p = p.executedPlan() if "Adaptive" in p.nodeName() else p.plan()
        if "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.mark.parametrize("name", ["line_crossings", "snap_nearest_edges"])
def test_query_equals_sql_on_copies(spark, copies, name):
    assert same(registry.QUERIES[name](spark, str(copies)).toPandas(), database(copies).execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["line_crossings", "snap_nearest_edges"])
def test_copies_make_no_more_pairs(spark, copies, name):
    one, seven = (most_rows(registry.QUERIES[name](spark, str(d))) for d in (DATA / "sf0.01", copies))
    assert 0 < seven <= 7 * one


def test_pairs_of_different_places_are_not_sorted(spark):
    """A minimum of structs is a sort aggregate: it held all pairs of a task."""
    stops = spark.range(300).select("id", (F.col("id") % 17 / 7).alias("x"), (F.col("id") / 300).alias("y"))
    edges = spark.range(200).select(F.col("id").alias("edge_id"), (F.col("id") % 13 / 9).alias("src_x"), (F.col("id") / 200).alias("src_y"), (F.col("id") % 11 / 5).alias("dst_x"), (F.col("id") % 7 / 4).alias("dst_y"))
    found = {r["id"]: (r["edge_id"], r["d2"]) for r in P.nearest_edges(stops, edges, "id", "x", "y", "edge_id", 1.0).collect()}
    near = stops.crossJoin(edges).withColumn("at", P.project(*(F.col(c) for c in ("x", "y", "src_x", "src_y", "dst_x", "dst_y")))).filter("at.d2 <= 1")
    wanted = {r["id"]: (r["b"]["edge_id"], r["b"]["d2"]) for r in near.groupBy("id").agg(F.min(F.struct("at.d2", "edge_id")).alias("b")).collect()}
    assert found == wanted and len(found) == 300
    plan = P.nearest_edges(stops, edges, "id", "x", "y", "edge_id", 1.0)._jdf.queryExecution().sparkPlan().toString()
    assert "min(d2" in plan and plan.index("SortAggregate") < plan.index("min(d2")
