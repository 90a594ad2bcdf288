"""An inverted-file index for cosine search: every vector lies in the list of its nearest centre, a search reads few lists.

Centres are fitted on a bounded sample; every row is then dealt to a list, none is left out. The lists are a Parquet
table partitioned by list, so one search prunes to the lists it probes. Sets of searches never pass the driver: blocks
hold rows of whole lists, or parts of a long one, and searches are dealt to the blocks of the lists they probe. How many
of the true neighbours the probed lists hold is told by ``recall``, and ``probes_for`` finds the probes that a wanted recall
takes (vectors without clusters take many); ``retrieval.nearest_each`` is the exact search, and so
is this one with as many probes as there are lists.

Defined results: scores and ties (by key) as in ``retrieval.nearest_each``; vectors without a cosine (null, empty, of
another length than the centres, with a null or NaN element, all zero) lie in list -1 and are never found, as searches
they find nothing; equal rows are each found; of searches with one key one is answered; no rows in, no rows out; columns
other than key, vector and those named in ``extra`` are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import AT_ONCE, ROWS, SEARCHES, cosine, first_of, matrix, met, scattered, unit

#: Bounds of what is fitted on the driver: centres, and sampled vectors for each of them.
MOST_LISTS, SAMPLED_EACH = 1024, 48
#: Sampled vectors whose nearest centres are looked for at once.
_FITTED = 4096


def fit(vectors: np.ndarray, lists: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Directions of ``lists`` centres at most: means of the directions nearest to them, a few times over. A centre that
    nothing is nearest to takes the place of the vector that its own centre serves worst."""
    own_unit = unit(np.asarray(vectors, np.float64))
    centres = own_unit[np.random.default_rng(seed).permutation(len(own_unit))[:lists]]
    for _ in range(rounds):
        sums, served = np.zeros_like(centres), np.zeros(len(own_unit))
        for first in range(0, len(own_unit), _FITTED):
            some = own_unit[first : first + _FITTED]
            near = some @ centres.T
            np.add.at(sums, near.argmax(axis=1), some)
            served[first : first + _FITTED] = near.max(axis=1)
        empty = np.flatnonzero((sums * sums).sum(axis=1) < 1e-18)
        sums[empty] = own_unit[np.argsort(served)[: len(empty)]]
        centres = unit(sums)
    return centres


def _sample(items: DataFrame, vector: str, size: int) -> np.ndarray:
    """About ``size`` different vectors, never over twice as many, by their hashes; copies count once."""
    n = items.filter(F.size(vector) > 0).count()
    mark = F.xxhash64(vector)
    some = items.filter((F.size(vector) > 0) & (F.pmod(mark, F.lit(max(1, n // max(1, size)))) == 0))
    rows = some.groupBy(mark.alias("h")).agg(F.first(vector).alias("v")).orderBy("h").select("v").limit(2 * size).toArrow()["v"].combine_chunks()
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False).tolist()
    return matrix(rows, max(sizes, key=sizes.count, default=0) or 1)[1]


def _nearest(vectors: pa.Array, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a cosine, and the numbers of their nearest centres, best first; AT_ONCE rows meet all centres."""
    rows, directions = matrix(vectors, centres.shape[1])
    some = (directions[i : i + AT_ONCE] @ centres.T for i in range(0, len(rows), AT_ONCE))
    return rows, np.concatenate([np.zeros((0, min(probes, len(centres))), np.int64), *(np.argsort(-x, axis=1, kind="stable")[:, :probes] for x in some)])


def _dealt(centres, probes: int):
    """Adds ``lists``, the numbers of the nearest centres, best first; [-1] for a vector without a cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for b in batches:
            out = [[-1]] * b.num_rows
            if len(c):
                for row, best in zip(*(x.tolist() for x in _nearest(b.column(b.num_columns - 1), c, probes))):
                    out[row] = best
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "lists"])

    return run


def _sent(centres, probes: int, blocks: Sequence[Sequence[int]]):
    """A row for each search and block ``at`` that holds rows of its lists; ``lists`` are only those of this block, so
    the lists of a search are sent once, not to each of its blocks. A vector without a cosine is sent nowhere."""
    first, parts = (np.array(x, np.int64) for x in ([b[0] for b in blocks], [len(b) for b in blocks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for b in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows if len(c) else 0, AT_ONCE)):
            rows, near = _nearest(b.column(b.num_columns - 1), c, probes)
            own = np.sort(near, axis=1).ravel()  # by number, and so by block
            n = parts[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(np.repeat(rows, near.shape[1]), n)
            starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(at, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(np.repeat(own, n), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(row[starts])) for x in b.columns), lists, pa.array(at[starts], pa.int32())], [*b.schema.names, "lists", "at"])

    return run


def _blocks(counts: dict[int, int], lists: int) -> list[list[int]]:
    """The blocks of each list: following lists share one as long as they fit, a longer list has several of its own."""
    out, at, held = [], 0, 0
    for i in range(lists):
        n = counts.get(i, 0)
        if held and held + n > ROWS:
            at, held = at + 1, 0
        parts = max(1, -(-n // ROWS))
        out.append(list(range(at, at + parts)))
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return out


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    key: str
    vector: str
    centres: np.ndarray

    @classmethod
    def build(cls, items: DataFrame, vector: str, key: str, path: str, lists: int | None = None, extra: Sequence[str] = ()) -> VectorIndex:
        """Fits and writes an index. ``lists``: by default the root of the number of rows, at most MOST_LISTS; the sample
        is SAMPLED_EACH times as many vectors. A list that holds many rows is written by many tasks."""
        spark = items.sparkSession
        lists = max(1, min(MOST_LISTS, lists or int(items.count() ** 0.5)))
        sample = _sample(items, vector, SAMPLED_EACH * lists)
        index = cls(spark, path, key, vector, fit(sample, lists) if len(sample) else np.zeros((0, 1)))
        rows = index._deal(items.select(*extra, key, vector), 1).withColumn("list", F.col("lists")[0]).drop("lists")
        spread = rows.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("list", "_at").drop("_at")
        spread.write.partitionBy("list").parquet(f"{path}/lists")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str, vector: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MOST_LISTS at most
        return cls(spark, path, key, vector, np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 1)))

    @property
    def rows(self) -> DataFrame:
        """All rows, with ``list``."""
        return self.spark.read.parquet(f"{self.path}/lists")

    def nearest(self, query: Sequence[float], k: int, probes: int, where: Column | None = None) -> DataFrame:
        """The k rows most like the query in the ``probes`` nearest lists; only these are read."""
        asked = unit(np.array([query], np.float64))[0]
        same = len(self.centres) and len(asked) == self.centres.shape[1] and np.isfinite(asked).all()
        near = np.argsort(-(self.centres @ asked), kind="stable")[:probes].tolist() if same else []
        rows = self.rows.filter(F.col("list").isin(near) & (F.lit(True) if where is None else where))
        score = F.round(cosine(F.col(self.vector), F.array(*[F.lit(float(x)) for x in query])), 6)
        return rows.drop("list").withColumn("score", score).orderBy(F.col("score").desc(), self.key).limit(k)

    def nearest_each(self, queries: DataFrame, k: int, probes: int, where: Column | None = None) -> DataFrame:
        """query, key, score, nth: for each row of ``queries`` (key and vector) the k rows most like it in its lists."""
        rows = self.rows.filter(F.col("list") >= 0)
        rows = rows if where is None else rows.filter(where)
        counts = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}  # MOST_LISTS at most
        blocks = _blocks(counts, len(self.centres)) or [[0]]
        first, parts = (F.get(F.lit(x), F.col("list")) for x in ([b[0] for b in blocks], [len(b) for b in blocks]))
        rows = rows.select(F.col(self.key).alias("item"), F.col(self.vector).alias("v"), "list", (first + scattered(parts)).alias("at"))
        asked = queries.select(self.key, self.vector).dropDuplicates([self.key])
        dealt = self._deal(asked, probes, blocks).select(F.col(self.key).alias("query"), F.col(self.vector).alias("v"), "lists", "at")
        return first_of(met(dealt, rows, k, -(-queries.count() // SEARCHES)), k).withColumnRenamed("item", self.key)

    def probes_for(self, queries: DataFrame, exact: DataFrame, target: float = 0.9) -> int:
        """The least number of probes whose recall over ``queries`` reaches ``target``. ``exact``: their true neighbours
        (query, key). A neighbour is found by as many probes as its list's place among the lists of the search."""
        asked = self._deal(queries.select(self.key, self.vector).dropDuplicates([self.key]), len(self.centres)).select(F.col(self.key).alias("query"), "lists")
        pairs = exact.select("query", self.key).distinct().join(asked, "query").join(self.rows.select(self.key, "list"), self.key)
        place = pairs.groupBy("query", self.key).agg(F.min(F.array_position("lists", F.col("list"))).alias("place"))
        counts = place.groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # at most MOST_LISTS rows
        total, held = sum(r["n"] for r in counts), 0
        for r in counts:
            held += r["n"]
            if held >= target * total:
                return r["place"]
        return max(1, len(self.centres))

    def _deal(self, rows: DataFrame, probes: int, blocks: Sequence[Sequence[int]] | None = None) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lists array<int>"
        centres = self.spark.sparkContext.broadcast(self.centres)
        return rows.mapInArrow(_dealt(centres, probes), schema) if blocks is None else rows.mapInArrow(_sent(centres, probes, blocks), f"{schema}, at int")


def recall(found: DataFrame, exact: DataFrame, key: str) -> float | None:
    """Share of the exact (query, key) pairs that were found; None if there are none."""
    held = found.select("query", key).distinct().withColumn("_held", F.lit(1))
    n, hits = exact.select("query", key).distinct().join(held, ["query", key], "left").agg(F.count(F.lit(1)), F.sum("_held")).first()
    return (hits or 0) / n if n else None
