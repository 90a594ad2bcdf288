"""The inverted-file index: recall against exact search, every row indexed, lists pruned, vectors without a cosine."""

import pytest
from pyspark.sql import functions as F

from terrasift.operators import retrieval
from terrasift.operators.vector_index import VectorIndex, _blocks, fit, recall
from terrasift.plans import registry
from tests.conftest import DATA


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(str(DATA / "sf0.1" / "embeddings.parquet"))


@pytest.fixture(scope="module")
def index(spark, items, tmp_path_factory):
    return VectorIndex.build(items, "embedding", "vec_id", f"file://{tmp_path_factory.mktemp('ivf')}/i", extra=["label"])


def pairs(df):
    return sorted((r["query"], r["nth"], r["vec_id"], r["score"]) for r in df.collect())


def test_every_row_is_indexed_and_recall_is_measured(spark, items, index):
    assert index.rows.count() == items.count() and index.rows.filter("list < 0").count() == 0
    asked = items.filter("vec_id % 50 = 0")
    exact = retrieval.nearest_each(items, "embedding", asked, 10, "vec_id")
    probes = index.probes_for(asked, exact, 0.9)
    few, less, enough = (recall(index.nearest_each(asked, 10, p), exact, "vec_id") for p in (1, probes - 1, probes))
    print(f"{len(index.centres)} lists, {probes} probes, recall {enough}")
    assert few < less < 0.9 <= enough and probes < len(index.centres)
    assert pairs(index.nearest_each(asked, 10, len(index.centres))) == pairs(exact)


def test_registered_query_keeps_recall(spark):
    folder = str(DATA / "sf0.1")
    found, exact = (registry.QUERIES[n](spark, folder) for n in ("cosine_index_topk", "cosine_topk_each"))
    assert recall(found, exact, "vec_id") >= 0.9 and found.groupBy("query").count().filter("count <> 10").count() == 0


def test_a_reopened_index_prunes_and_filters(spark, items, index):
    again = VectorIndex.open(spark, index.path, "vec_id", "embedding")
    query = items.filter("vec_id = 100").first()["embedding"]
    one = again.nearest(query, 5, 4)
    assert one.first()["vec_id"] == 100 and "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString() or "PartitionFilters: [list" in one._jdf.queryExecution().toString()
    assert len(one.inputFiles()) > 0 and set(r[0] for r in again.nearest(query, 5, 99, F.col("label") == 3).select("label").collect()) == {3}
    exact = retrieval.nearest(items, "embedding", query, 5, "vec_id")
    assert [r["vec_id"] for r in again.nearest(query, 5, len(again.centres)).collect()] == [r["vec_id"] for r in exact.collect()]


def test_vectors_without_a_cosine_copies_and_ties(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [float("nan"), 1.0]), (None, [1.0, 0.0])]
    items = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, v array<float>, list string").drop("list")
    index = VectorIndex.build(items, "v", "id", f"file://{tmp_path}/i", lists=2)
    assert index.rows.count() == len(rows) and {r["id"] for r in index.rows.filter("list = -1").collect()} == {4, 5, 6, 7, 8, 9}
    found = [tuple(r) for r in index.nearest_each(items.filter("id < 4 or id is null").union(items.filter("id = 4")), 3, 2).orderBy("query", "nth").collect()]
    assert [r[1:] for r in found if r[0] == 1] == [(None, 1.0, 1), (1, 1.0, 2), (2, 1.0, 3)]
    assert [r[1:] for r in found if r[0] == 3] == [(3, 1.0, 1), (3, 1.0, 2), (None, 0.0, 3)]
    assert not any(r[0] == 4 for r in found) and index.nearest([0.0, 0.0], 3, 2).count() == 0


def test_empty_tables_and_skewed_copies(spark, tmp_path):
    none = spark.createDataFrame([], "id bigint, v array<double>")
    index = VectorIndex.build(none, "v", "id", f"file://{tmp_path}/none")
    assert index.rows.count() == 0 if index.centres.size else len(index.centres) == 0
    copies = spark.range(3000).select("id", F.array(F.lit(1.0), (F.col("id") % 3 == 0).cast("double") * F.col("id")).alias("v"))
    index = VectorIndex.build(copies, "v", "id", f"file://{tmp_path}/copies", lists=4)
    found = index.nearest_each(copies.filter("id % 500 = 1"), 3, 4)
    assert pairs(found.withColumnRenamed("id", "vec_id")) == pairs(retrieval.nearest_each(copies, "v", copies.filter("id % 500 = 1"), 3, "id").withColumnRenamed("id", "vec_id"))


def test_fit_keeps_as_many_centres_as_there_are_vectors():
    assert fit([[1.0, 0.0], [0.0, 2.0]], 5).shape == (2, 2)


def test_sets_of_searches_are_not_broadcast(spark, items, index):
    """The blocks of searches, repeated for each list, were a side of a join that Spark could send through the driver."""
    found = index.nearest_each(items.filter("vec_id % 50 = 0"), 10, len(index.centres))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_block_gets_only_its_own_lists(spark, items, index):
    """All probed lists of a search went to each of its blocks, where a block only needs those that lie in it."""
    asked, lists = items.filter("vec_id % 50 = 0").select("vec_id", "embedding"), len(index.centres)
    blocks = [[0], [0], [1], [2, 3, 4], *([5 + i // 4] for i in range(lists - 4))]
    for probes in (1, 7, lists):
        near = {r["vec_id"]: r["lists"] for r in index._deal(asked, probes).collect()}
        wanted = {(q, b): sorted(i for i in own if b in blocks[i]) for q, own in near.items() for i in own for b in blocks[i]}
        sent = index._deal(asked, probes, blocks).collect()
        assert {(r["vec_id"], r["at"]): r["lists"] for r in sent} == wanted and len(sent) == len(wanted) >= asked.count()


def test_many_blocks_and_parts_find_what_one_does(spark, items, index, monkeypatch):
    from terrasift.operators import vector_index

    asked = items.filter("vec_id % 50 = 0")
    wanted, few = pairs(retrieval.nearest_each(items, "embedding", asked, 10, "vec_id")), pairs(index.nearest_each(asked, 10, 5))
    for module in (retrieval, vector_index):
        monkeypatch.setattr(module, "ROWS", 30)
        monkeypatch.setattr(module, "SEARCHES", 7)
    assert pairs(retrieval.nearest_each(items, "embedding", asked, 10, "vec_id")) == wanted == pairs(index.nearest_each(asked, 10, len(index.centres)))
    assert pairs(index.nearest_each(asked, 10, 5)) == few


def test_lists_share_blocks_and_long_lists_have_several(monkeypatch):
    from terrasift.operators import vector_index

    monkeypatch.setattr(vector_index, "ROWS", 10)
    assert _blocks({0: 4, 1: 5, 2: 3, 3: 25, 5: 1}, 6) == [[0], [0], [1], [2, 3, 4], [5], [5]]
