"""The near stage's links against brute-force Jaccard over all pairs of texts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import DATA
from tests.llm.test_operators import SCHEMA, words_of
from terrasift.llm import set_join


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def brute(texts, similarity=0.8):
    """id -> smallest id of its component."""
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {i: top(i) for i in sets}


def texts(seed):
    """Copies with one to six changed words, chains of copies of copies, one passage in many texts, short texts."""
    rng = random.Random(seed)
    passage, out = words_of(rng, 60, 500), []
    for _ in range(12):
        text = words_of(rng, rng.randrange(30, 200), 500)
        for _ in range(rng.randrange(1, 6)):
            out.append(list(text))
            text = list(text)
            for _ in range(rng.randrange(1, 7)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(999)}"
    out += [words_of(rng, 40 - i, 500) + passage for i in range(40)]
    out += [passage[:-1] + [f"end{i}"] for i in range(15)] + [["a", "b"], ["A", "b"], ["c"], [], []]
    rng.shuffle(out)
    return [(3 * i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed, sample, covering", [(1, 16, True), (2, 1, True), (3, 2, False)])
def test_near_copies_equal_brute_force(spark, monkeypatch, seed, sample, covering):
    monkeypatch.setattr(set_join, "_SAMPLE", sample)
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA).repartition(3)
    wanted = brute(rows)
    assert len(set(wanted.values())) < len(rows) - 20
    assert {r["doc_id"]: r["component_id"] for r in set_join.similar_sets(docs, words=5, similarity=0.8, join_empty=True, covering=covering).collect()} == wanted


def test_near_stage_removes_copies_of_four_fifths(spark):
    rng = random.Random(9)
    base = words_of(rng, 120, 500)
    changed = [w if i not in (30, 90) else "changed" for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base), "en", "a"), (2, " ".join(changed), "en", "a"), (3, " ".join(words_of(rng, 120, 500)), "en", "a")], SCHEMA)
    assert {r["doc_id"] for r in P.near_stage(spark, docs, "").collect()} == {1, 3}


def test_near_stage_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").filter(F.col("doc_id").isNotNull())
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in P.near_stage(spark, docs, "").collect()} == {i for i, c in wanted.items() if i == c}
