"""Exact dedup by two passes over a Bloom filter.

Pass one hashes every text into the slots of a filter that tells slots hit once from slots hit at least twice. Pass
two looks each text's slots up: a text with any slot hit once is certainly unique and passes straight through; only
the others, true repeats and a few false positives, shuffle by their SHA-256 and are settled exactly.

A filter's size is bounded. Where the rows need more slots, the texts' hashes are dealt into ranges, as many as it
takes, and each range has its own filter, one at a time; the rows of a range are written together, so a range reads no
other range's rows and all ranges together read the hashes once.

Defined results: a null text counts as empty; ids that are null sort after all others, and a group of null ids only
has a null ``keep_id`` and keeps its rows; rows that repeat an id and its text whole are each returned, marked alike;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, id_and_text, new_path, quoted, remove, ship, stored, whole_row

_CHUNK = 1 << 16
_AT_ONCE = 1 << 20  # hashes marked together


def normalised(text: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def plan(rows: int, slots_per_row: int = 16, max_bytes: int = 64 << 20) -> tuple[int, int]:
    """(ranges, slots of each range's filter): at least ``slots_per_row`` slots for each row, in filters of at most
    ``max_bytes`` of bits; slots and ranges are powers of two."""
    needed = max(16, (slots_per_row * max(rows, 1) - 1).bit_length())
    most = max(16, (8 * max_bytes).bit_length() - 1)
    return 1 << max(0, needed - most), 1 << min(needed, most)


def _positions(h: np.ndarray, slots: int, hashes: int) -> np.ndarray:
    """Double hashing of 64-bit hashes: one column of slot numbers for each of ``hashes``."""
    h = h.astype(np.int64, copy=False).view(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    k = np.arange(hashes, dtype=np.uint64)
    return ((h[:, None] + k[None, :] * step[:, None]) & np.uint64(slots - 1)).astype(np.int64)


def _mark(slots: int, hashes: int):
    """For runs of rows: of each chunk of slots those hit by one row and those hit by more."""

    def told(parts):
        at = _positions(np.concatenate(parts), slots, hashes)
        at.sort(axis=1)  # a row counts once for each of its different slots
        at = at[np.hstack([np.ones((len(at), 1), bool), at[:, 1:] != at[:, :-1]])]
        at, n = np.unique(at, return_counts=True)
        cuts = np.flatnonzero(np.diff(at // _CHUNK)) + 1
        rows = [
            (int(a[0] // _CHUNK), (a % _CHUNK)[c == 1].astype(np.uint16).tobytes(), (a % _CHUNK)[c > 1].astype(np.uint16).tobytes())
            for a, c in zip(np.split(at, cuts), np.split(n, cuts))
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["chunk", "once", "more"])

    def run(batches):
        parts, size = [], 0
        for b in batches:
            column = b.column(0).flatten() if pa.types.is_list(b.column(0).type) else b.column(0)
            parts.append(column.to_numpy(zero_copy_only=False))
            size += len(column)
            if size >= _AT_ONCE:
                yield told(parts)
                parts, size = [], 0
        if size:
            yield told(parts)

    return run


def _merge(least: int):
    """Bit maps of the slots hit by at least ``least`` rows, 1 or 2, from marks sorted by chunk; holds one chunk."""

    def told(chunk, hits):
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([np.packbits(hits >= least).tobytes()], pa.binary())], ["chunk", "bits"])

    def run(batches):
        at, hits = None, None
        for b in batches:
            for chunk, once, more in zip(*(b.column(i).to_pylist() for i in range(3))):
                if chunk != at:
                    if at is not None and (hits >= least).any():
                        yield told(at, hits)
                    at, hits = chunk, np.zeros(_CHUNK, np.uint8)
                once, more = np.frombuffer(once, np.uint16), np.frombuffer(more, np.uint16)
                hits[once] = np.minimum(hits[once] + 1, 2)
                hits[more] = 2
        if at is not None and (hits >= least).any():
            yield told(at, hits)

    return run


def hit_slots(hashes: DataFrame, slots: int, k: int, least: int) -> np.ndarray:
    """The bit map of the slots that at least ``least`` rows, 1 or 2, hit. ``hashes`` has one column, of bigints or of
    arrays of them. Chunks are merged by the executors; the driver gets the map once."""
    marks = hashes.mapInArrow(_mark(slots, k), "chunk bigint, once binary, more binary")
    out = np.zeros(slots // 8, np.uint8)
    for row in marks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge(least), "chunk bigint, bits binary").collect():
        at = row["chunk"] * (_CHUNK // 8)
        out[at : at + _CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def repeated_slots(hashes: DataFrame, slots: int, k: int) -> np.ndarray:
    """Pass one: the slots that two or more rows hit."""
    return hit_slots(hashes, slots, k, 2)


def hit(h: np.ndarray, bits: np.ndarray, slots: int, hashes: int) -> np.ndarray:
    """Which of the hashes have all their slots in the bit map."""
    at = _positions(h, slots, hashes)
    return ((bits[at >> 3] >> (7 - (at & 7))) & 1).astype(bool).all(axis=1)


def _maybe_repeated(bits, slots: int, hashes: int):
    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(hit(h.to_numpy(), bits.value, slots, hashes))

    return maybe


def key_filter(keys: DataFrame, on: str, hashes: int = 3, max_filter_bytes: int = 64 << 20, hashed: bool = False):
    """(broadcast bit map, slots, hashes): a Bloom filter, of bounded size, of the hashes of the column ``on``, which
    ``hashed`` says it holds. Beyond its bound (3.4e7 keys) it lets more and more other rows through."""
    _, slots = plan(keys.count(), 16, max_filter_bytes)
    bits = hit_slots(keys.select(F.col(on) if hashed else F.xxhash64(on)), slots, hashes, 1)
    return keys.sparkSession.sparkContext.broadcast(bits), slots, hashes


def split_by_keys(rows: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that may have one of the ``keys``, rows that certainly have none, keys), so that a join with the keys
    shuffles few other rows. ``keys`` has the one column ``on``, distinct."""
    keys = stored(keys)
    if keys.isEmpty():
        return rows.filter(F.lit(False)), rows, keys
    maybe = _maybe_repeated(*key_filter(keys, on))(F.xxhash64(on))
    return rows.filter(maybe), rows.filter(~maybe), keys


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows that have none of the keys, not null. Most of them never shuffle."""
    maybe, others, keys = split_by_keys(rows, keys, on)
    return maybe.join(keys, on, "left_anti").unionByName(others)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 16, hashes: int = 3, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: one of each group of equal texts, one of its smallest id.

    The documents are read twice, whatever the number of ranges: for their hashes, and to part those whose hash occurs
    more than once from the others, which never move. The former meet by partial aggregates, so no group is collected.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(whole_row(docs), F.xxhash64(normalised(text_col)).alias("h"))
    path = new_path(spark, "hashes")
    rows.select("h").write.parquet(path)
    read = spark.read.schema("h bigint").parquet(path)
    ranges, slots = plan(read.count(), slots_per_row, max_filter_bytes)
    parts = []
    for n in range(ranges):  # one filter is held at a time
        own = read.filter(_lot("h", ranges) == n)
        bits = spark.sparkContext.broadcast(repeated_slots(own, slots, hashes))
        parts.append(stored(own.filter(_maybe_repeated(bits, slots, hashes)("h"))))
        bits.destroy()
    again = reduce(DataFrame.unionByName, parts).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    maybe, others, _ = split_by_keys(rows, again, "h")
    remove(spark, path)
    discard(*parts)
    order = F.struct(F.col(f"row.{quoted(id_col)}").isNull(), F.col(f"row.{quoted(id_col)}"), F.col(f"row.{quoted(text_col)}"))
    settled = maybe.groupBy(F.sha2(F.encode(normalised(f"row.{quoted(text_col)}"), "UTF-8"), 256)).agg(F.min_by("row", order).alias("row"))
    return settled.select("row.*").unionByName(others.select("row.*"))


def _lot(h: str, ranges: int) -> F.Column:
    """Slots come from a hash's low bits and steps from its high ones, ranges from those between."""
    return F.shiftrightunsigned(h, 29).bitwiseAND(ranges - 1).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 16, hashes: int = 3, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    ship(spark)
    norm = id_and_text(docs, id_col, text_col).select("doc_id", normalised("text").alias("norm"))
    hashed = norm.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"))
    ranges, slots = plan(docs.count(), slots_per_row, max_filter_bytes)
    path, schema = new_path(spark, "hashes"), hashed.withColumn("lot", F.lit(0)).schema
    hashed.withColumn("lot", _lot("h", ranges)).write.partitionBy("lot").parquet(path)
    parts = []
    for n in range(ranges):
        own = spark.read.schema(schema).parquet(path).filter(F.col("lot") == n)
        bits = spark.sparkContext.broadcast(repeated_slots(own.select("h"), slots, hashes))
        parts.append(stored(own.select("doc_id", "text_sha256", _maybe_repeated(bits, slots, hashes)("h").alias("maybe"))))
        bits.destroy()
    remove(spark, path)
    keyed = reduce(DataFrame.unionByName, parts)
    maybe = keyed.filter("maybe").select("doc_id", "text_sha256")
    # written first, so that the join has a plain exchange on either side and Spark can split a large group
    groups = stored(maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    settled = maybe.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    alone = keyed.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return settled.unionByName(alone)
