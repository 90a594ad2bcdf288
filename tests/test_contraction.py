"""Components by contraction: one root for each, every other node once, and far less left by each round."""

import random

from terrasift.operators import graph as G


def test_contraction_equals_components(spark):
    rng = random.Random(7)
    names = rng.sample(range(10**6), 400)
    paths = [(names[i], names[i + 1]) for i in range(300) if i % 23]
    other = [tuple(rng.sample(names[300:], 2)) for _ in range(60)]
    links = [(max(e), min(e)) for e in paths + other]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    least = {r["a"]: r["b"] for r in G.components(df).collect()}
    rows = G.contracted(df).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(roots)
    nodes = {n for e in links for n in e}
    groups = lambda label: {frozenset(n for n in nodes if label.get(n, n) == k) for k in {label.get(n, n) for n in nodes}}
    assert groups(roots) == groups(least)
    assert G.contracted(df.filter("a < 0")).count() == 0
