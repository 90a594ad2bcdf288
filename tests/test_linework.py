"""Cells along segments, nodes and coverage against brute force on random lines."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from terrasift.operators import graph as G
from terrasift.operators import layers, linework, routing
from terrasift.sources import lines

ENDS = "src_x double, src_y double, dst_x double, dst_y double"


def some_segments(seed, n=60):
    """Also upright, level, on grid lines, through corners, of no length, longer than many cells."""
    rng = random.Random(seed)
    place = lambda: rng.choice([rng.uniform(-9, 9), float(rng.randrange(-9, 9)), rng.randrange(-9, 9) + 0.5])
    out = [(place(), place(), place(), place()) for _ in range(n)]
    out += [(x, y, x, place()) for x, y, *_ in out[:8]] + [(x, y, place(), y) for x, y, *_ in out[:8]]
    return [*out, (1.0, 1.0, 1.0, 1.0), (0.5, 0.5, 0.5, 0.5), (-0.5, -0.5, 3.5, 3.5), (0.5, 2.0, 0.5, -2.0)]


def clip(e, i, j, half):
    """Exact stretch of the segment within the closed square around (i, j), or None."""
    low, high = Fraction(0), Fraction(1)
    ax, ay, bx, by = map(Fraction, e)
    for a, b, c in ((ax, bx, i), (ay, by, j)):
        near, far = c - Fraction(half) - a, c + Fraction(half) - a
        if a == b:
            if not near <= 0 <= far:
                return None
        else:
            s, t = sorted((near / (b - a), far / (b - a)))
            low, high = max(low, s), min(high, t)
    return (low, high) if low <= high else None


def test_lengths_in_cells_equal_clipping(spark):
    edges = some_segments(1)
    df = spark.createDataFrame([(n, *e) for n, e in enumerate(edges)], "n int, " + ENDS)
    for n, parts in df.select("n", linework.traversal(*(F.col(c) for c in linework._ENDS), 1.0).alias("p")).collect():
        assert math.isclose(sum(p["share"] for p in parts), 1.0)
        for p in parts:
            got = clip(edges[n], p["i"], p["j"], 0.5)
            assert got is not None
            if edges[n][:2] != edges[n][2:]:
                assert math.isclose(float(got[1] - got[0]), p["share"], abs_tol=1e-12)
        cells = [(p["i"], p["j"]) for p in parts]
        assert len(set(cells)) == len(cells)


@pytest.mark.parametrize("wider", [0.0, 0.25])
def test_squares_met_equal_clipping(spark, wider):
    edges = some_segments(2)
    df = spark.createDataFrame([(n, *e) for n, e in enumerate(edges)], "n int, " + ENDS)
    for n, cells in df.select("n", linework.squares_met(*(F.col(c) for c in linework._ENDS), 1.0, wider).alias("c")).collect():
        found = [(c["i"], c["j"]) for c in cells]
        wanted = {(i, j) for i in range(-12, 12) for j in range(-12, 12) if clip(edges[n], i, j, 0.5 + wider)}
        assert len(found) == len(set(found))
        # a square that a slanted line only touches with a corner may fall to rounding
        for i, j in wanted ^ set(found):
            assert clip(edges[n], i, j, 0.5 + wider - 1e-9) is None and clip(edges[n], i, j, 0.5 + wider + 1e-9)


def test_exposure_weighs_by_length(spark):
    edges = spark.createDataFrame([("long", 0.0, 0.0, 40.0, 0.0), ("dot", 1.0, 0.0, 1.0, 0.0), ("far", 0.0, 9.0, 1.0, 9.0)], "k string, " + ENDS)
    cells = spark.createDataFrame([(1, 0, 2.0, True), (23, 0, 8.0, False)], "i bigint, j bigint, intensity double, hot boolean")
    found = {r["k"]: tuple(r)[1:] for r in linework.exposure_by_length(edges, "k", cells, 1.0).collect()}
    assert found == {"long": (0.25, 8.0, 0.025), "dot": (2.0, 2.0, 1.0), "far": (0.0, 0.0, 0.0)}


def pieces(df):
    return {tuple(r[c] for c in linework._ENDS) for r in df.collect()}


def test_overlaps_and_near_crossings_share_nodes(spark):
    rows = [(0.0, 0.0, 4.0, 0.0), (1.0, 0.0, 6.0, 0.0), (3.0, 0.0, 3.0, 2.0), (3.0, 0.0, 2.0, 0.0), (10.0, 0.0, 12.0, 2.0), (10.0, 2.0, 12.0, 0.0), (11.00000002, 0.0, 11.00000002, 3.0), (7.0, 7.0, 7.0, 7.0)]
    for cell in (0.7, 5.0):
        got = pieces(linework.noded(spark.createDataFrame(rows, ENDS), cell))
        level = {(0.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 4.0), (4.0, 6.0)}
        assert {(a, c) for a, b, c, d in got if b == d == 0 and c <= 6} == level
        assert (3.0, 0.0, 3.0, 2.0) in got
        star = {e for e in got if (11.0, 1.0) in (e[:2], e[2:])}
        assert len(star) == 6 and len(got) == 5 + 1 + 6


def test_nodes_of_random_lines(spark):
    """No two pieces have more in common than an end, and nothing of the lines is lost."""
    rng = random.Random(7)
    rows = [tuple(float(rng.randrange(12)) for _ in range(4)) for _ in range(30)]
    rows = [r for r in rows if r[:2] != r[2:]]
    got = sorted(pieces(linework.noded(spark.createDataFrame(rows, ENDS), 3.0)))
    for n, (ax, ay, bx, by) in enumerate(got):
        for cx, cy, ex, ey in got[n + 1 :]:
            dx, dy, ox, oy = bx - ax, by - ay, ex - cx, ey - cy
            cross = dx * oy - dy * ox
            if abs(cross) > 1e-6 * math.hypot(dx, dy) * math.hypot(ox, oy):
                t, u = ((cx - ax) * oy - (cy - ay) * ox) / cross, ((cx - ax) * dy - (cy - ay) * dx) / cross
                inner = [1e-5 < x * w < w - 1e-5 for x, w in ((t, math.hypot(dx, dy)), (u, math.hypot(ox, oy)))]
                other = [-1e-9 <= x <= 1 + 1e-9 for x in (t, u)]
                assert not (all(other) and any(inner)), (got[n], (cx, cy, ex, ey))
    for row in rows:
        ax, ay, bx, by = row
        whole = math.hypot(bx - ax, by - ay)
        off = lambda x, y, ax=ax, ay=ay, bx=bx, by=by, whole=whole: abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / whole
        at = lambda x, y, ax=ax, ay=ay, bx=bx, by=by, whole=whole: ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / whole**2
        on = [e for e in got if off(*e[:2]) < 1e-6 and off(*e[2:]) < 1e-6 and -1e-6 < min(at(*e[:2]), at(*e[2:])) and max(at(*e[:2]), at(*e[2:])) < 1 + 1e-6]
        assert math.isclose(sum(math.hypot(c - a, d - b) for a, b, c, d in on), whole, rel_tol=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_what_is_covered_adds_up_to_the_union(spark, seed):
    rng = random.Random(seed)
    carriers = [(0.0, 0.0, 1.0, 0.0), (0.0, 1.0, 0.6, 0.8), (3.0, 0.0, 0.0, 1.0), (0.0, 5.0, -0.8, 0.6)]  # a place and a unit vector
    rows, spans = [], []
    for n in range(40):
        c = rng.randrange(4)
        x, y, dx, dy = carriers[c]
        a, b = rng.sample(range(30), 2)
        rows.append((f"f{n:02}", rng.randrange(3), x + a * dx, y + a * dy, x + b * dx, y + b * dy))
        spans.append((c, min(a, b), max(a, b)))
    df = spark.createDataFrame(rows, "feature string, nth int, " + ENDS)
    left = linework.uncovered(df, "feature", ["nth"], 4.0).collect()
    order = sorted(range(40), key=lambda i: (rows[i][1], rows[i][0]))
    taken, wanted = set(), {}
    for i in order:
        c, a, b = spans[i]
        units = {(c, k) for k in range(a, b)}
        wanted[rows[i][0]] = len(units - taken)
        taken |= units
    got = dict.fromkeys(wanted, 0.0)
    for r in left:
        got[r["feature"]] += (r["u"] - r["t"]) * math.hypot(r["dst_x"] - r["src_x"], r["dst_y"] - r["src_y"])
    assert all(math.isclose(got[f], w, abs_tol=1e-5) for f, w in wanted.items())
    assert math.isclose(sum(got.values()), len(taken), abs_tol=1e-4)


def test_lines_that_overlap_in_part_are_shown_once(spark):
    made = [("bike lanes", [(-80.0, 40.4), (-79.99, 40.4)]), ("sharrows", [(-80.01, 40.4), (-79.98, 40.4)]), ("trails", [(-79.995, 40.39), (-79.995, 40.41)])]
    out = None
    for i, (folder, points) in enumerate(made):
        one = lines.lines(spark.createDataFrame([(points, str(i))], "points array<struct<x:double,y:double>>, name string"), "pittsburgh", folder, f"f{i}")
        out = one if out is None else out.unionByName(one)
    own = {r["layer_type"]: [(round(p["e"]["a"]["x"], 6), round(p["e"]["b"]["x"], 6)) for p in r["pieces"]] for r in layers.exclusive_pieces(out).collect()}
    assert own == {"bike_lanes": [(-80.0, -79.99)], "sharrows": [(-80.01, -80.0), (-79.99, -79.98)], "trails": [(-79.995, -79.995)]}


def test_a_hot_cell_between_samples_blocks_a_long_edge(spark):
    edges = routing.named(spark.createDataFrame([(-80.0, 40.001, -79.0, 40.001)], ENDS).withColumn("miles", F.lit(50.0)))
    hot = spark.createDataFrame([("pittsburgh", -79.5325, 40.0, 9.0)] * 20 + [("pittsburgh", -70.0, 40.0 + i / 100, 1.0) for i in range(30)], "city string, lon double, lat double, severity_weight double")
    left, blocked = routing.unblocked(edges, hot, "pittsburgh", 0.0025, 99, [])
    assert blocked == 1 and left.count() == 0
    aside = hot.withColumn("lat", F.col("lat") + 0.0015)  # beside the cell's square, within the margin
    assert routing.unblocked(edges, aside, "pittsburgh", 0.0025, 99, [])[1] == 1
    assert routing.unblocked(edges, aside, "pittsburgh", 0.0025, 99, [], wider=0.0)[1] == 0


def test_noded_network_is_routable_along_overlaps(spark):
    edges = G.noded(spark.createDataFrame([(0.0, 0.0, 2.0, 0.0), (1.0, 0.0, 3.0, 0.0)], ENDS), 1.0)
    paths = G.shortest_paths(routing.named(edges).select("src", "dst", F.col("miles").alias("weight")), "0.0000000,0.0000000")
    assert paths.count() == 4
