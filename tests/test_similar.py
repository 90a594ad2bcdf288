"""Similarity joins: equal word sets are compared once, and pairs, best matches and copies equal all pairs."""

from pyspark.sql import functions as F

from terrasift.functions import scalar as S
from terrasift.operators import relational as R
from terrasift.plans import registry
from tests.compare import database, same
from tests.conftest import DATA

NAMES = ["red bolt", "bolt red", "red rod", "blue rod", "tin", "tin can lid", "can lid", "red bolt"]


def brute(rows, least):
    sets = {k: (b, set(n.split())) for k, b, n in rows}
    return {(x, y): len(sets[x][1] & sets[y][1]) / len(sets[x][1] | sets[y][1]) for x in sets for y in sets if sets[x][0] == sets[y][0] and len(sets[x][1] & sets[y][1]) >= least * len(sets[x][1] | sets[y][1])}


def test_pairs_and_best_equal_all_pairs(spark):
    rows = [(i, "ab"[i % 2], NAMES[i * 5 % 8]) for i in range(30)] + [(31, "c", "tin")]
    df = spark.createDataFrame(rows, "k int, b string, n string").select("k", "b", S.words("n").alias("w"))
    for least in (0.3, 0.5):
        args = (df, df.withColumnRenamed("k", "o"), ["b"], "k", "o", "w", least, S.jaccard)
        wanted = brute(rows, least)
        found = [tuple(r) for r in R.similar_pairs(*args).collect()]
        assert len(found) == len(wanted) and {(x, y): s for x, y, s in found} == wanted
        best = {}
        for (x, y), s in sorted(wanted.items(), key=lambda e: (-e[1], e[0][1])):
            if x != y:
                best.setdefault(x, (y, s))
        assert {r["k"]: (r["o"], r["score"]) for r in R.most_similar(*args).collect()} == best


def test_copies_are_compared_once(spark):
    """2,000 copies of two names made 4,000,000 pairs to score; their classes make four."""
    scored = spark.sparkContext.accumulator(0)
    same_ = F.udf(lambda a, b: scored.add(1) or float(a == b), "double").asNondeterministic()
    df = spark.range(2000).select("id", F.lit(1).alias("b"), F.array(F.lit("x"), (F.col("id") % 2).cast("string")).alias("w"))
    best = R.most_similar(df, df.withColumnRenamed("id", "o"), ["b"], "id", "o", "w", 0.3, same_)
    assert {r["id"]: r["o"] for r in best.collect()} == {i: i % 2 if i > 1 else i + 2 for i in range(2000)} and scored.value < 100


def test_queries_equal_sql_on_copies(spark, tmp_path):
    part = spark.read.parquet(str(DATA / "sf0.001" / "part.parquet"))
    spark.range(7).select(F.col("id").alias("copy")).crossJoin(part).withColumn("p_partkey", F.col("p_partkey") + F.col("copy") * 1000).drop("copy").write.parquet(f"{tmp_path}/part.parquet")
    con = database(tmp_path)
    for name in ("fuzzy_block_best", "jaccard_pairs"):
        assert same(registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLE_SQL[name]).df())
