"""Tables in buckets: what a write touches, repeats, races, interruptions; and order statistics of skewed groups."""

import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrasift.operators import buckets, selection
from terrasift.operators.buckets import BucketStore, in_chunks
from terrasift.operators.relational import floor_index_percentile
from terrasift.streaming.incremental import upsert_stream, watch


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, f"file://{tmp_path}/store", count=16)


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, v string")


def as_dict(df):
    rows = df.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["v"] for r in rows}


def test_an_upsert_rewrites_only_its_buckets(spark, store):
    store.upsert("t", table(spark, [(i, "a") for i in range(2000)]), ["id"])
    before = store.manifest("t").buckets
    assert len(before) == 16
    got = store.upsert("t", table(spark, [(7, "b"), (7, "c"), (None, "none")]), ["id"], order=[F.col("v").desc()])
    after = store.manifest("t").buckets
    assert sum(before[b] != after[b] for b in before) <= 2
    found = as_dict(got)
    assert found[7] == "c" and found[8] == "a" and found[None] == "none" and len(found) == 2001
    assert as_dict(store.insert_ignore("t", table(spark, [(7, "d"), (5000, "new")]), ["id"])) == found | {5000: "new"}
    wider = store.upsert("t", table(spark, [(5001, "w")]).withColumn("more", F.lit(1)), ["id"])
    assert wider.filter("more = 1").count() == 1 and wider.filter("more is null").count() == 2002
    with pytest.raises(ValueError):
        store.upsert("t", table(spark, [(1, "x")]), ["v"])


def test_kept_values_and_empty_writes(spark, store):
    assert store.upsert("t", table(spark, []), ["id"]).count() == 0
    store.upsert("t", table(spark, [(1, "old"), (2, "old")]), ["id"])
    assert as_dict(store.upsert("t", table(spark, [(1, None), (2, "new"), (3, None)]), ["id"], keep=["v"])) == {1: "old", 2: "new", 3: None}
    assert as_dict(store.upsert("t", table(spark, []), ["id"])) == {1: "old", 2: "new", 3: None}
    with pytest.raises(FileNotFoundError):
        store.read("nothing")


def test_a_repeated_batch_changes_nothing(spark, store):
    store.upsert("t", table(spark, [(1, "a")]), ["id"], source="s", batch=0)
    store.upsert("t", table(spark, [(1, "b")]), ["id"], source="s", batch=1)
    version = store.manifest("t").version
    assert as_dict(store.upsert("t", table(spark, [(1, "again")]), ["id"], source="s", batch=1)) == {1: "b"} and store.manifest("t").version == version
    assert as_dict(store.upsert("t", table(spark, [(1, "other")]), ["id"], source="r", batch=0)) == {1: "other"}


def test_writers_that_meet_both_count(spark, store, monkeypatch):
    store.upsert("t", table(spark, [(i, "a") for i in range(50)]), ["id"])
    other, real = BucketStore(spark, store.root, count=16), BucketStore._commit
    late = []

    def slow(self, name, new):
        if self is store and not late:
            late.append(1)
            other.upsert("t", table(spark, [(3, "other"), (4, "other")]), ["id"])
        return real(self, name, new)

    monkeypatch.setattr(BucketStore, "_commit", slow)
    found = as_dict(store.upsert("t", table(spark, [(4, "mine")]), ["id"]))
    assert found[3] == "other" and found[4] == "mine" and len(found) == 50
    monkeypatch.setattr(BucketStore, "_commit", lambda self, name, new: False)
    with pytest.raises(buckets.Overtaken):
        store.upsert("t", table(spark, [(1, "x")]), ["id"])


def test_old_versions_go_and_readers_keep_theirs(spark, store):
    store.upsert("t", table(spark, [(i, "0") for i in range(40)]), ["id"])
    early = store.read("t")
    for n in range(1, buckets.KEPT_VERSIONS):
        store.upsert("t", table(spark, [(i, str(n)) for i in range(40)]), ["id"])
    assert set(as_dict(early).values()) == {"0"}
    for n in range(5):
        store.upsert("t", table(spark, [(i, str(n)) for i in range(40)]), ["id"])
    root = Path(store.root.removeprefix("file:")) / "t"
    assert len(list((root / "manifests").glob("[0-9]*.json"))) == buckets.KEPT_VERSIONS
    assert len(list((root / "data").glob("*/_bucket=*"))) == len(store.manifest("t").buckets) * buckets.KEPT_VERSIONS


def test_an_interrupted_run_goes_on(spark, store):
    rows, asked = table(spark, [(i, None) for i in range(60)]), []

    def work(part):
        ids = [r["id"] for r in part.collect()]
        asked.append(ids)
        if len(asked) == 3:
            raise ConnectionError("gone")
        return part.withColumn("v", F.lit("done"))

    with pytest.raises(ConnectionError):
        in_chunks(store, "t", rows, "id", work, 6)
    flushed = as_dict(store.read("t"))
    assert set(flushed) == set(asked[0]) | set(asked[1])
    again = len(asked)
    assert in_chunks(store, "t", rows, "id", work, 6) == 4
    assert not set(flushed) & {i for ids in asked[again:] for i in ids} and set(as_dict(store.read("t"))) == set(range(60))
    assert in_chunks(store, "t", rows, "id", work, 6) == 0


def test_stream_into_buckets(spark, store, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()

    def load():
        upsert_stream(watch(spark, str(folder), "id bigint, v string"), store, "t", ["id"], str(tmp_path / "ck"), history="h", history_keys=["id", "v"]).awaitTermination()

    (folder / "a.csv").write_text("id,v\n1,a\n2,b\n")
    load()
    (folder / "b.csv").write_text("id,v\n2,c\n")
    load()
    load()
    assert as_dict(store.read("t")) == {1: "a", 2: "c"} and store.read("h").count() == 3 and store.manifest("t").version == 1


# order statistics


def groups(seed):
    rng = random.Random(seed)
    out = [("hot", rng.choice([0.0, rng.gauss(0, 1), 10.0 ** rng.randrange(-3, 6), -(10.0 ** rng.randrange(3))])) for _ in range(3000)]
    out += [("same", 5.0)] * 400 + [(None, float(rng.randrange(9))) for _ in range(101)] + [("one", 1.5), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("far", -1.7e308), ("far", 1.7e308), ("far", 0.0)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parts, few", [(1024, 100_000), (64, 200)])
def test_ranks_of_skewed_groups(spark, parts, few):
    rows = groups(3)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5).cache()
    sets = {}
    for k, v in rows:
        if v is not None and v == v:
            sets.setdefault(k, []).append(v)
    wanted = [(k, r) for k, vs in sets.items() for r in {0, len(vs) // 2, len(vs) - 1, len(vs), -1}] + [("none", 0), ("absent", 0)]
    got = selection.at_ranks(df, ["k"], "v", spark.createDataFrame(wanted, "k string, rank bigint"), parts, few).collect()
    assert {(r["k"], r["rank"]): r["value"] for r in got} == {(k, r): sorted(sets[k])[r] for k, r in wanted if 0 <= r < len(sets.get(k, ()))} and len(got) == len({(r["k"], r["rank"]) for r in got})


def test_quantiles_equal_percentile(spark):
    rows = groups(4)
    df = spark.createDataFrame([r for r in rows if r[0] != "nan"], "k string, v double").repartition(5).cache()
    got = {(r["k"], r["share"]): r["value"] for r in selection.quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], parts=256, few=500).collect()}
    for k, values in df.groupBy("k").agg(F.percentile("v", [0.0, 0.25, 0.5, 0.9, 1.0])).collect():
        for share, value in zip([0.0, 0.25, 0.5, 0.9, 1.0], values or [None] * 5):
            assert got[k, share] == (None if value is None else pytest.approx(value, rel=1e-12))
    whole = [v for k, v in rows if k in ("same", None)]
    assert selection.quantiles(df.filter("k = 'same' or k is null"), [], "v", [0.5]).first()["value"] == statistics.median(whole)
    assert selection.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_floor_index(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    assert [floor_index_percentile(df, "v", p) for p in (10, 50, 89, 90, 100)] == [5.0, 5.0, 8.0, 9.0, 9.0] and floor_index_percentile(df.limit(0), "v", 90) is None
