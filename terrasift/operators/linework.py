"""Exact work with straight segments: grid cells along them, their common nodes, and what of them is covered.

A segment has two ends, ``a`` and ``b``; a cell (i, j) of a grid of ``size`` is the square around (i * size, j * size).
All is stated as expressions over sequences, so a segment costs as much as the cells it passes, not as its box holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .shared import stored

_ENDS = ("src_x", "src_y", "dst_x", "dst_y")


def _whole(c: Column) -> Column:
    return c.cast("bigint")


def _nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _between(a: Column, b: Column) -> Column:
    """The lines of the grid, at whole numbers, that lie strictly between two places, as shares of the way."""
    low, high = _whole(F.floor(F.least(a, b))) + 1, _whole(F.ceil(F.greatest(a, b))) - 1
    return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (k - a) / (b - a))).otherwise(_nothing("double"))


def traversal(ax: Column, ay: Column, bx: Column, by: Column, size: float) -> Column:
    """array of struct(i, j, share): the cells along a segment, in order, and the share of its length in each.

    A segment of no length is wholly in the cell of its place. What lies on a border belongs to the cell above or to
    the right, as ``scalar.cell_index`` has it.
    """
    (ux, vx), (uy, vy) = ((a / size + 0.5, b / size + 0.5) for a, b in ((ax, bx), (ay, by)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _between(ux, vx), _between(uy, vy))))
    at = lambda u, v, t: _whole(F.floor(u + (v - u) * t))
    cell = lambda t, share: F.struct(at(ux, vx, t).alias("i"), at(uy, vy, t).alias("j"), share.alias("share"))
    parts = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda s, t: cell((s + t) / 2, t - s))
    return F.when((ax == bx) & (ay == by), F.array(cell(F.lit(0.0), F.lit(1.0)))).otherwise(parts)


def squares_met(ax: Column, ay: Column, bx: Column, by: Column, size: float, wider: float = 0.0) -> Column:
    """array of struct(i, j): the cells whose closed square, ``wider`` to each side, has a point of the segment.

    Column by column: within the strip of a column the segment is one stretch, and the squares it meets are those of
    the stretch's range.
    """
    half = size / 2 + wider
    first = lambda low: _whole(F.ceil((low - half) / size))
    last = lambda high: _whole(F.floor((high + half) / size))
    dx, dy = bx - ax, by - ay

    def squares(i: Column) -> Column:
        s, t = ((i * size + w - ax) / F.nullif(dx, F.lit(0.0)) for w in (-half, half))
        s, t = F.when(dx == 0, 0.0).otherwise(S.clamp(F.least(s, t), 0.0, 1.0)), F.when(dx == 0, 1.0).otherwise(S.clamp(F.greatest(s, t), 0.0, 1.0))
        # the ends themselves where the strip holds them, so that nothing is lost to rounding
        y, z = F.when(s == 0, ay).otherwise(ay + dy * s), F.when(t == 1, by).otherwise(ay + dy * t)
        low, high = first(F.least(y, z)), last(F.greatest(y, z))
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda j: F.struct(i.alias("i"), j.alias("j")))).otherwise(_nothing("struct<i:bigint,j:bigint>"))

    low, high = first(F.least(ax, bx)), last(F.greatest(ax, bx))
    return F.flatten(F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), squares)).otherwise(_nothing("array<struct<i:bigint,j:bigint>>")))


def _ends_of(edges: str = "") -> list[Column]:
    return [F.col(f"{edges}{c}") for c in _ENDS]


def exposure_by_length(edges: DataFrame, edge_key: str, cells: DataFrame, size: float, hot: str = "hot") -> DataFrame:
    """edge_key, mean_intensity, max_intensity, hot_share: means and shares weighted by the length in each cell.

    ``cells``: i, j, intensity, ``hot``; a cell that is not there has intensity 0 and is not hot.
    """
    passed = edges.select(edge_key, F.explode(traversal(*_ends_of(), size)).alias("c")).select(edge_key, "c.*").filter("share > 1e-12")  # a corner, by rounding, is no stretch
    told = passed.join(cells.select("i", "j", "intensity", hot), ["i", "j"], "left").withColumn("value", F.coalesce("intensity", F.lit(0.0)))
    weighed = F.sum(F.when(F.col(hot), F.col("share")).otherwise(0.0)) / F.sum("share")
    return told.groupBy(edge_key).agg(F.round(F.sum(F.col("value") * F.col("share")) / F.sum("share"), 12).alias("mean_intensity"), F.max("value").alias("max_intensity"), F.round(weighed, 12).alias("hot_share"))


def meeting(edges: DataFrame, edge_key: str, cells: DataFrame, size: float, wider: float = 0.0) -> DataFrame:
    """edge_key of the edges that meet the square of any of the cells (i, j), ``wider`` to each side."""
    met = edges.select(edge_key, F.explode(squares_met(*_ends_of(), size, wider)).alias("c")).select(edge_key, "c.*")
    return met.join(cells.select("i", "j").distinct(), ["i", "j"], "left_semi").select(edge_key).distinct()


def _dealt(rows: DataFrame, cell: float, wider: float) -> DataFrame:
    return rows.withColumn("_c", F.explode(squares_met(*_ends_of(), cell, wider))).select("*", "_c.i", "_c.j").drop("_c")


def _met_by(x: Column, y: Column, half: float, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the segment has a point in the closed square around (x, y)."""
    low, high = F.lit(0.0), F.lit(1.0)
    for p, a, b in ((x, ax, bx), (y, ay, by)):
        s, t = (p - half - a) / F.nullif(b - a, F.lit(0.0)), (p + half - a) / F.nullif(b - a, F.lit(0.0))
        flat = F.abs(a - p) <= half
        low = F.greatest(low, F.coalesce(F.least(s, t), F.when(flat, F.lit(0.0)).otherwise(F.lit(2.0))))
        high = F.least(high, F.coalesce(F.greatest(s, t), F.lit(1.0)))
    return low <= high


def noded(edges: DataFrame, cell: float, places: int = 7) -> DataFrame:
    """src_x, src_y, dst_x, dst_y: the edges split at every place where they meet one another, each piece once.

    Snap rounding: ends and crossings are rounded to ``places``, and every edge that passes the small square of a
    rounded place gets a node there. So lines that cross in nearly one place share one node, an end that touches a line
    splits it, and parallel lines that overlap in part break into the same pieces, which are then one. Edges and places
    meet in the cells that the edges pass; a cell compares all its edges with one another, so ``cell`` should be about
    as long as an edge.
    """
    grid = 10.0**-places
    r = lambda c: F.round(c, places)
    low, high = (F.struct(r(f"{k}_x").alias("x"), r(f"{k}_y").alias("y")) for k in ("src", "dst"))
    rows = edges.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")).distinct().filter("a != b")
    rows = rows.select(F.col("a.x").alias("src_x"), F.col("a.y").alias("src_y"), F.col("b.x").alias("dst_x"), F.col("b.y").alias("dst_y"))
    dealt = stored(_dealt(rows, cell, grid))
    ends = F.array(*[F.struct(F.col(f"{k}_x").alias("x"), F.col(f"{k}_y").alias("y")) for k in ("src", "dst")])
    spots = stored(rows.select(F.explode(ends).alias("p")).unionByName(_crossings(dealt, r)).distinct().select("p.x", "p.y"))
    own = spots.withColumns({"i": _whole(F.floor(F.col("x") / cell + 0.5)), "j": _whole(F.floor(F.col("y") / cell + 0.5))})
    met = dealt.join(own, ["i", "j"]).filter(_met_by(F.col("x"), F.col("y"), grid / 2, *_ends_of()))
    dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    t = ((F.col("x") - F.col("src_x")) * dx + (F.col("y") - F.col("src_y")) * dy) / (dx * dx + dy * dy)
    along = met.groupBy(*_ENDS).agg(F.array_sort(F.collect_set(F.struct(t.alias("t"), "x", "y"))).alias("p"))
    step = lambda a, b: F.struct(*[F.struct(v["x"].alias("x"), v["y"].alias("y")).alias(k) for k, v in (("a", a), ("b", b))])
    pieces = along.select(F.explode(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), step)).alias("e"))
    flat = pieces.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()
    return flat.select(F.col("a.x").alias("src_x"), F.col("a.y").alias("src_y"), F.col("b.x").alias("dst_x"), F.col("b.y").alias("dst_y"))


def _crossings(dealt: DataFrame, rounded) -> DataFrame:
    """p: the rounded places where two edges of a cell that aren't parallel have a point in common."""
    other = dealt.select("i", "j", *[F.col(c).alias(f"o_{c}") for c in _ENDS])
    (ax, ay, bx, by), (cx, cy, ex, ey) = _ends_of(), _ends_of("o_")
    dx, dy, ox, oy, px, py = bx - ax, by - ay, ex - cx, ey - cy, cx - ax, cy - ay
    cross = F.nullif(dx * oy - dy * ox, F.lit(0.0))
    once = F.struct(ax, ay, bx, by) < F.struct(cx, cy, ex, ey)
    pairs = dealt.join(other, ["i", "j"]).filter(once).withColumns({"t": (px * oy - py * ox) / cross, "u": (px * dy - py * dx) / cross})
    return pairs.filter("t >= 0 and t <= 1 and u >= 0 and u <= 1").select(F.struct(rounded(ax + dx * F.col("t")).alias("x"), rounded(ay + dy * F.col("t")).alias("y")).alias("p"))


def uncovered(segments: DataFrame, feature: str, order: list[str], cell: float, within: float = 2e-7) -> DataFrame:
    """The columns of ``segments`` with ``t``, ``u``: stretches, as shares of the way, that no feature before covers.

    ``segments``: src_x ... dst_y, the ``feature`` they belong to, and ``order``, columns of which the smaller comes
    before; at equal order the smaller feature does. A segment covers another where it runs along the other's own line,
    ``within`` to either side, so lines that cross or touch cover nothing. What is covered is subtracted as intervals
    on the segment's line; segments meet in the cells that they pass.
    """
    keys = [*_ENDS, feature, *order]
    rows = stored(segments.withColumn("_row", F.struct(*keys)))
    lines = rows.select("_row", *_ENDS, F.struct(*order, feature).alias("_rank")).distinct().filter("src_x != dst_x or src_y != dst_y")
    dealt = stored(_dealt(lines, cell, within))
    other = dealt.select("i", "j", F.col("_rank").alias("_before"), *[F.col(c).alias(f"o_{c}") for c in _ENDS])
    (ax, ay, bx, by), (cx, cy, ex, ey) = _ends_of(), _ends_of("o_")
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    off = lambda x, y: ((x - ax) * dy - (y - ay) * dx) / length
    at = lambda x, y: ((x - ax) * dx + (y - ay) * dy) / (length * length)
    near = dealt.join(other, ["i", "j"]).filter(F.col("_before") < F.col("_rank"))
    near = near.withColumns({"_d": length, "_p": at(cx, cy), "_q": at(ex, ey), "_f": off(cx, cy), "_g": off(ex, ey)})
    near = near.withColumns({"_s": F.greatest(F.lit(0.0), F.least("_p", "_q")), "_t": F.least(F.lit(1.0), F.greatest("_p", "_q"))})
    # the other's line may reach far: how far it is off counts where both run
    gap = lambda v: F.abs(F.expr(f"_f + (_g - _f) * ({v} - _p) / nullif(_q - _p, 0.0D)"))
    covers = near.filter(((F.col("_t") - F.col("_s")) * F.col("_d") > within) & (gap("_s") <= within) & (gap("_t") <= within))
    held = covers.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct(F.col("_s").alias("s"), F.col("_t").alias("t"), F.col("_d").alias("d")))).alias("_held"))
    out = rows.join(stored(held), "_row", "left").withColumn("_left", F.explode(_gaps(F.col("_held"), within)))
    return out.select(*segments.columns, F.col("_left.s").alias("t"), F.col("_left.t").alias("u"))


def _gaps(held: Column, within: float) -> Column:
    """What sorted intervals leave of [0, 1]. Gaps shorter than ``within``, a length, are closed."""
    none = _nothing("struct<s:double,t:double>")
    start = F.struct(F.lit(0.0).alias("to"), none.alias("left"))

    def add(acc, x):
        wide = (x["s"] - acc["to"]) * x["d"] > within
        left = F.when(wide, F.concat(acc["left"], F.array(F.struct(acc["to"].alias("s"), x["s"].alias("t"))))).otherwise(acc["left"])
        return F.struct(F.greatest(acc["to"], x["t"]).alias("to"), left.alias("left"))

    def end(acc):
        last = F.when((1 - acc["to"]) * F.get(held, F.lit(0))["d"] > within, F.array(F.struct(acc["to"].alias("s"), F.lit(1.0).alias("t")))).otherwise(none)
        return F.concat(acc["left"], last)

    return F.when(held.isNull(), F.array(F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")))).otherwise(F.aggregate(held, start, add, end))


def stretches(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """The keys, ``low`` and ``high`` of the unions of intervals that overlap or touch, for each of the keys."""
    before = Window.partitionBy(*keys).orderBy(low, high)
    far = F.max(high).over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.select(*keys, low, high).withColumn("_new", F.when(far >= F.col(low), 0).otherwise(1))
    numbered = fresh.withColumn("_nth", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_nth").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_nth")
