"""Exact order statistics of any number of groups, without bringing a group's values together.

Selection by histograms: the values of each group are counted in equal parts of the range that still holds the wanted
rank, for all groups in one pass; the part that holds it becomes the next range, from its least to its greatest value.
Ranges shrink a thousandfold a round; a range of one value is the answer, and one of few values is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stored

PARTS = 1024
FEW = 100_000  # values that one task may sort


def _keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_k``, all keys as one value, in which nulls are equal."""
    return rows.withColumn("_k", F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all")))


def at_ranks(rows: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, parts: int = PARTS, few: int = FEW) -> DataFrame:
    """keys, rank, value: the value at each of the ranks, from 0, that ``wanted`` (keys, rank) names. Nulls and NaN
    don't count; a rank beyond the group's values has no row."""
    values = _keyed(rows, keys).select("_k", F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    bounds = values.groupBy("_k").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
    todo = stored(_keyed(wanted, keys).select("_k", F.col("rank").cast("bigint").alias("rank")).distinct().join(bounds, "_k").filter("rank >= 0 and rank < n").withColumn("below", F.lit(0).cast("bigint")))
    found, narrowed = [], []
    while True:
        found.append(todo.filter("lo = hi").select("_k", "rank", F.col("lo").alias("value")))
        short = todo.filter(f"lo < hi and n <= {few}")
        inside = values.join(short.select("_k", "lo", "hi", "below").distinct(), "_k").filter("_v >= lo and _v <= hi")
        placed = inside.withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("_k", "lo", "hi").orderBy("_v")) - 1)
        found.append(stored(placed.join(short.select("_k", "lo", "hi", "rank"), ["_k", "lo", "hi", "rank"], "left_semi").select("_k", "rank", F.col("_v").alias("value"))))
        todo = todo.filter(f"lo < hi and n > {few}")
        if todo.isEmpty():
            break
        ranges = stored(todo.select("_k", "lo", "hi", "below").distinct())
        inside = values.join(ranges, "_k").filter("_v >= lo and _v <= hi")
        part = F.least(F.lit(parts - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * parts).cast("int"))
        counts = inside.groupBy("_k", "lo", "hi", "below", part.alias("part")).agg(F.count(F.lit(1)).alias("own"), F.min("_v").alias("first"), F.max("_v").alias("last"))
        before = Window.partitionBy("_k", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("start", F.col("below") + F.coalesce(F.sum("own").over(before), F.lit(0)))
        chosen = todo.select("_k", "rank", "lo", "hi").join(counts, ["_k", "lo", "hi"]).filter("rank >= start and rank < start + own")
        todo = stored(chosen.select("_k", "rank", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("own").alias("n"), F.col("start").alias("below")))
        # from now on only what lies in a range is read
        ranges_now = todo.filter("lo < hi").select("_k", "lo", "hi").distinct()
        values = stored(values.join(ranges_now, "_k").filter("_v >= lo and _v <= hi").select("_k", "_v"))
        narrowed += [ranges, values]
    out = stored(reduce(DataFrame.unionByName, found).distinct())
    discard(*narrowed)
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "rank", "value")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], **sizes) -> DataFrame:
    """keys, share, value: continuous quantiles, between the two values next to share * (n - 1); null where a group has
    no value."""
    counted = stored(_keyed(rows, keys).groupBy("_k").agg(F.count_if(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("n")))
    spots = counted.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares))))).withColumn("at", F.col("share") * (F.col("n") - 1))
    spots = spots.withColumns({"low": F.floor("at").cast("bigint"), "high": F.ceil("at").cast("bigint")})
    ranks = spots.select("_k", F.explode(F.array("low", "high")).alias("rank")).distinct()
    named = ranks.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "rank")
    got = _keyed(at_ranks(rows, keys, value, named, **sizes), keys).select("_k", "rank", F.col("value").alias("v"))
    low = spots.join(got.withColumnsRenamed({"rank": "low", "v": "a"}), ["_k", "low"], "left")
    both = low.join(got.withColumnsRenamed({"rank": "high", "v": "b"}), ["_k", "high"], "left")
    between = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise(F.col("a") * (F.col("high") - F.col("at")) + F.col("b") * (F.col("at") - F.col("low")))
    return both.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "share", between.alias("value"))
