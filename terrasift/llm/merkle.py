"""Fixity audit of WARC replicas by Merkle trees.

Records are ordered by their id. A leaf holds a record's SHA-256 and length; a node covers the FANOUT aligned children
below it and holds the SHA-256 of their digests in order, their bytes and their number. Two replicas are compared from
the roots down; only children of nodes that differ are looked at, and the byte offset of a range is its parent's
offset plus the bytes of the siblings before it, so no global ordering or running total over all records is needed.

Defined results: null fields count as empty; records with a null id form one leaf before all others; records that
share an id form one leaf, and are told apart by digest with their number in each replica; two empty replicas, or
replicas that agree, give no rows; columns other than the stated ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 6
FANOUT = 1 << BITS
_NO_ID = -(1 << 63)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """key, record: each row as a WARC/1.1 resource record."""
    url, body = (F.coalesce(F.col(c), F.lit("")) for c in (url_col, body_col))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("key"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """key, digest, bytes: one row for each record."""
    return records.select("key", F.sha2(F.encode("record", "UTF-8"), 256).alias("digest"), F.octet_length("record").cast("bigint").alias("bytes"))


def _leaf_nodes(rows: DataFrame) -> DataFrame:
    """One node for each id. Several records of one id are summed word by word, whatever their number and order."""
    words = [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("bigint")) for i in range(8)]
    n = F.count(F.lit(1))
    digest = F.when(n == 1, F.min("digest")).otherwise(F.sha2(F.concat_ws(":", n.cast("string"), *[w.cast("string") for w in words]).cast("binary"), 256))
    return rows.groupBy("key").agg(digest.alias("digest"), F.sum("bytes").alias("bytes"), n.alias("n"))


def _parents(nodes: DataFrame) -> DataFrame:
    inner = F.array_sort(F.collect_list(F.struct("key", "digest")))  # FANOUT children at most
    digest = F.sha2(F.concat_ws(",", F.transform(inner, lambda x: F.concat_ws(":", x["key"].cast("string"), x["digest"]))).cast("binary"), 256)
    return nodes.groupBy(F.shiftright("key", BITS).alias("key")).agg(digest.alias("digest"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))


def tree(rows: DataFrame, height: int) -> list[DataFrame]:
    """The levels of nodes, leaves first. The two lowest, which carry the work, are kept."""
    levels = [stored(_leaf_nodes(rows))]
    for level in range(height):
        levels.append(stored(_parents(levels[-1])) if level == 0 else _parents(levels[-1]))
    return levels


def _height(*sides: DataFrame) -> int:
    """Levels above the leaves until one node, or one on each side of zero, is left."""
    ends = [x for side in sides for x in side.agg(F.min("key"), F.max("key")).first() if x is not None and x != _NO_ID]
    span = max([0, *(x if x >= 0 else ~x for x in ends)])
    return max(1, -(-span.bit_length() // BITS))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Where two replicas differ. ``primary``, ``replica``: leaves().

    Rows: key, digest, status (missing, extra: in the replica; changed: its id is there with other content),
    n_primary, n_replica, bytes, primary_offset, replica_offset (where the id's range starts in either).
    """
    a, b = stored(primary), stored(replica)
    height = _height(a, b)
    trees = [tree(x, height) for x in (a, b)]
    at = None
    for level in range(height, -1, -1):
        left, right = ([t[level].select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("digest", "bytes"))) for t, s in zip(trees, "ab")])
        up = F.shiftright("key", BITS)
        if at is not None:  # only children of the nodes that differ
            left, right = (x.join(at.select(F.col("key").alias("up")), up == F.col("up"), "left_semi") for x in (left, right))
        both = left.join(right, "key", "full").withColumn("up", up)
        before = Window.partitionBy("up").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumns({f"before_{s}": F.coalesce(F.sum(f"bytes_{s}").over(before), F.lit(0)) for s in "ab"})
        if at is not None:
            both = both.join(at.select(F.col("key").alias("up"), "offset_a", "offset_b"), "up")
        else:
            both = both.withColumns({"offset_a": F.lit(0), "offset_b": F.lit(0)})
            # roots on both sides of zero follow one another
            roots = Window.partitionBy(F.lit(0)).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
            both = both.withColumns({f"before_{s}": F.coalesce(F.sum(f"bytes_{s}").over(roots), F.lit(0)) for s in "ab"})
        differ = ~F.col("digest_a").eqNullSafe(F.col("digest_b"))
        at = stored(both.filter(differ).select("key", *((F.col(f"offset_{s}") + F.col(f"before_{s}")).cast("bigint").alias(f"offset_{s}") for s in "ab")))
    count = lambda x, s: x.join(at, "key", "left_semi").groupBy("key", "digest", "bytes").agg(F.count(F.lit(1)).alias(f"n_{s}"))
    ids = [x.join(at, "key", "left_semi").select("key").distinct().withColumn(f"in_{s}", F.lit(True)) for x, s in ((a, "a"), (b, "b"))]
    found = count(a, "a").join(count(b, "b"), ["key", "digest", "bytes"], "full").fillna(0, ["n_a", "n_b"]).filter("n_a != n_b")
    found = found.join(at, "key").join(ids[0], "key", "left").join(ids[1], "key", "left")
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").otherwise("changed")
    key = F.when(F.col("key") != _NO_ID, F.col("key"))
    return found.select(key.alias("key"), "digest", status.alias("status"), F.col("n_a").alias("n_primary"), F.col("n_b").alias("n_replica"), "bytes", F.col("offset_a").alias("primary_offset"), F.col("offset_b").alias("replica_offset"))
