"""Shared borders after simplification: the same vertices on both sides, areas that add up, rings that keep an area."""

import math
import random

from pyspark.sql import functions as F

from terrasift.operators.borders import simplify_shared
from terrasift.operators.layers import choropleth_notes

SHAPE = "id string, ring array<struct<x:double,y:double>>"


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def edges(ring):
    return {frozenset(e) for e in zip(ring, ring[1:])}


def wiggly(a, b, rng, steps=12, size=0.03):
    """Points from a to b, b left out, with noise; the same both ways."""
    return [a] + [(a[0] + (b[0] - a[0]) * t / steps + rng.uniform(-size, size), a[1] + (b[1] - a[1]) * t / steps + rng.uniform(-size, size)) for t in range(1, steps)]


def quilt(n, seed=1):
    rng, sides, out = random.Random(seed), {}, {}

    def side(a, b):
        if (b, a) in sides:
            own = sides[b, a]
            return [b for b in [a, *reversed(own[1:])]]
        return sides.setdefault((a, b), wiggly(a, b, rng))

    for i in range(n):
        for j in range(n):
            corners = [(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0)]
            ring = [p for a, b in zip(corners, corners[1:] + corners[:1]) for p in side(a, b)]
            k = rng.randrange(len(ring))  # rings begin anywhere, a third of them run backwards
            ring = ring[k:] + ring[:k]
            out[f"{i}-{j}"] = ring[::-1] if rng.random() < 0.33 else ring
    return {k: [*r, r[0]] for k, r in out.items()}


def simplified(spark, rings, tolerance):
    found = simplify_shared(spark.createDataFrame([(k, r) for k, r in rings.items()], SHAPE), tolerance).collect()
    return {r["id"]: r["ring"] and [tuple(p) for p in r["ring"]] for r in found}


def test_neighbours_share_all_vertices_and_no_gap_opens(spark):
    rings = quilt(5)
    found = simplified(spark, rings, 0.04)
    assert found.keys() == rings.keys() and sum(map(len, found.values())) < sum(map(len, rings.values())) * 0.6
    uses = [e for r in found.values() for e in edges(r)]
    inner, outline = {e for e in uses if uses.count(e) == 2}, [e for e in uses if uses.count(e) == 1]
    assert inner and all(uses.count(e) <= 2 for e in uses)
    ends = [p for e in outline for p in e]
    assert all(ends.count(p) == 2 for p in ends)  # what only one ring has is a closed outline
    for p in (q for e in outline for q in e):  # and lies on the outside of the quilt
        assert min(p[0], p[1], 5 - p[0], 5 - p[1]) < 0.05
    for k, r in found.items():
        assert r[0] == r[-1] and set(r) <= set(rings[k]) and math.copysign(1, area(r)) == math.copysign(1, area(rings[k]))


def test_islands_holes_and_rings_that_would_vanish(spark):
    circle = [(math.cos(i / 50 * math.pi), math.sin(i / 50 * math.pi)) for i in range(100)]
    hole, island = [*circle, circle[0]], [*circle[37:], *circle[:38]][::-1]
    lens = [(5.0, 0.0), (6.0, 0.01), (7.0, 0.0), (6.0, -0.01), (5.0, 0.0)]
    above = [(5.0, 0.0), (6.0, 0.01), (7.0, 0.0), (6.0, 3.0), (5.0, 0.0)]
    below = [(5.0, 0.0), (6.0, -0.01), (7.0, 0.0), (6.0, -3.0), (5.0, 0.0)]
    rings = {"hole": hole, "island": island, "lens": lens, "above": above, "below": below}
    found = simplified(spark, rings, 0.1)
    assert 3 < len(found["hole"]) < 30 and edges(found["hole"]) == edges(found["island"])
    assert len(set(found["lens"])) >= 3 and area(found["lens"]) != 0
    shared = edges(found["lens"]) & (edges(found["above"]) | edges(found["below"]))
    assert shared == edges(found["lens"])  # what one keeps its neighbour keeps
    assert abs(sum(abs(area(found[k])) for k in ("lens", "above", "below")) - 6.0) < 1e-9


def test_defined_results(spark):
    rings = {"null": None, "empty": [], "line": [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], "gap": [(0.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 0.0)], "open": [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "zero": [(-0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (-0.0, 0.0)]}
    found = simplified(spark, rings, 0.1)
    assert {k: found[k] for k in ("null", "empty", "line", "gap")} == {k: rings[k] for k in ("null", "empty", "line", "gap")}
    assert found["open"] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)] == found["zero"]
    twice = spark.createDataFrame([(1, "a b", rings["zero"])] * 2, "id int, `row` string, ring array<struct<x:double,y:double>>").withColumnRenamed("id", "kept")
    assert simplify_shared(twice, 0.1).count() == 2 and simplify_shared(twice, 0.1).columns == ["kept", "row", "ring"] and simplify_shared(twice.limit(0), 0.1).count() == 0


def test_notes_of_a_choropleth(spark):
    rows = spark.createDataFrame([("1", None, None, None)], "tract_fips string, county_name string, state_name string, risk_score double")
    bare, none = choropleth_notes(rows, True).first(), choropleth_notes(rows.limit(0), False).first()
    assert bare["tract_count"] == 1 and bare["truncated"] and bare["warning"] and none["tract_count"] == 0 and none["warning"] is None
    assert choropleth_notes(rows.withColumn("county_name", F.lit("x")), False).first()["warning"] is None
