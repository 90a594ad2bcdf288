"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host if the share of that host's pages that hold it exceeds a ratio. Lines are compared
without white space at either end; blank lines are never boilerplate. A host's boilerplate lines are few, whatever
its size: pages hold a mean of m different lines, so at most m / ratio lines can exceed the ratio.

Defined results: null texts hold one empty line; pages with a null host form a host of their own; a page that holds
a line twice counts once, repeated rows count each; hosts where a line is on fewer than ``min_pages`` pages lose
nothing, so a host of one page keeps all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _digest(line: F.Column) -> F.Column:
    """The MD5 of a line's content; null if it is blank."""
    text = F.regexp_replace(line, _ENDS, "")
    return F.when(text != "", F.unhex(F.md5(F.encode(text, "UTF-8"))))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """host, found: the digests of the host's boilerplate lines. ``pages``: host, lines."""
    lines = pages.select("host", F.explode(F.array_distinct(F.transform("lines", _digest))).alias("line")).filter("line is not null")
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("host", "of")
    often = held.join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") / F.col("total") > ratio)
    return often.groupBy("host").agg(F.collect_set("line").alias("found"))


def drop_boilerplate(pages: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """One row for each row of ``pages``: doc_id, n_lines, n_dropped, kept_text."""
    rows = pages.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    # written first: its size is then known, so a small one is broadcast and the texts do not shuffle
    found = stored(boilerplate(rows, ratio, min_pages)).withColumnRenamed("host", "of")
    rows = rows.join(found, F.col("host").eqNullSafe(F.col("of")), "left").withColumn("digests", F.transform("lines", _digest))
    here = F.when(F.col("found").isNotNull(), F.array_intersect("digests", "found"))
    rows = rows.select("doc_id", "lines", "digests", here.alias("here"))
    kept = F.when(F.size("here") > 0, F.filter("lines", lambda line, i: F.coalesce(~F.array_contains("here", F.get("digests", i)), F.lit(True)))).otherwise(F.col("lines"))
    rows = rows.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.concat_ws("\n", "kept").alias("kept_text"))
