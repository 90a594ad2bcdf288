"""Each stage over null, empty, long and repeated rows with clashing columns, and over no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import DATA
from tests.llm.test_operators import ODD, SCHEMA

DIR = str(DATA / "sf0.001")
#: How many rows of each id stay: of the first stage those with a letter, of the next two one of equal (near) texts.
STAY = {
    "language": {1: 1, 2: 2, 6: 1, 7: 1, 8: 1, 9: 1, None: 1},
    "exact": {1: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 1},
    "near": {1: 1, 3: 1, 6: 1, 8: 1, 9: 1, None: 1},
    "leaks": {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 2},
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("gone_id", "fp", "kept", "component_id", "score", "lang_pred", "n_chars")}).cache()


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_odd_rows(spark, odd, name, stage):
    out = stage(spark, odd, DIR)
    if name == "tokens":
        assert out.count() == len(ODD)
        return
    assert out.columns == odd.columns
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == STAY[name]


def test_ids_and_rows_that_repeat(spark):
    """No text goes for its id; of equal rows one stays; rows without an id are judged like others."""
    rows = [(1, "same text here"), (2, "same text here"), (2, "another unique text"), (3, "twice"), (3, "twice"), (None, "no id"), (None, "no  id"), (None, "no id"), (None, "other words")]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA).repartition(3)
    wanted = Counter([(1, "same text here"), (2, "another unique text"), (3, "twice"), (None, "other words")])
    for stage in (P.exact_stage, P.near_stage):
        left = Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, DIR).collect())
        no_id = [t for i, t in left.elements() if i is None and t.startswith("no")]
        assert len(no_id) == 1 and left - Counter([(None, no_id[0])]) == wanted


def test_leaks_go_by_row(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(1, item, "en", "a"), (1, "clean", "en", "a"), (None, item, "en", "a"), (None, "clean too", "en", "a")], SCHEMA)
    assert {(r["doc_id"], r["text"]) for r in P.leak_stage(spark, docs, DIR).collect()} == {(1, "clean"), (None, "clean too")}


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_no_rows(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), DIR).count() == 0


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_columns_of_any_name_come_back(spark, name, stage):
    """Dots, blanks, backticks, and the names that stages use inside."""
    clash = ["a.b", "_row key", "_hash of text", "_own", "row", "own", "key", "h", "x y", "tick`s", "Component_ID", "s", "t", "gid"]
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "some  words of a text"), (3, "other words of this one")], "doc_id bigint, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("a")}).select("*", *[F.lit(n).alias(c) for n, c in enumerate(clash)])
    out = stage(spark, docs, DIR)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(tuple(r)[4:] == tuple(range(len(clash))) for r in rows)


def test_hashes_of_many_ranges_read_the_documents_twice(spark, monkeypatch):
    from terrasift.llm import bloom_dedup

    texts = [f"text {i % 700}" for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"] for r in bloom_dedup.first_of_each(docs, max_filter_bytes=1 << 13, slots_per_row=1024).collect()}
    assert bloom_dedup.plan(1000, 1024, 1 << 13)[0] >= 8 and kept == set(range(700))
