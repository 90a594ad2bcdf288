"""SimHash near-dedup through covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint. Different fingerprints within ``RADIUS`` bits must be linked without comparing
all pairs: each of 2^(RADIUS+1)-1 = 7 tables groups fingerprints by a masked part, and the masks are built so that any
two fingerprints at most RADIUS bits apart agree on at least one of them (a covering code: bit i carries a non-zero
3-bit vector, mask v holds the bits whose vector has odd overlap with v, and any two vectors are both orthogonal to
some v). Fingerprints alone in all their buckets have no link. Within a bucket links are found without pairs: a
fingerprint sends itself to its own value and to the values one free bit away; fingerprints that meet at a value are
at most two bits apart, all those at most two bits apart meet, and at most 65 different ones can meet at one value.
Components follow by alternating star contractions, cut by a checkpoint after each.

Defined results: null texts and texts without words have fingerprint zero and link like any other; a text of one or
two words is one shingle; repeated rows give repeated rows of result; rows with a null id are fingerprinted and get
the component of their fingerprint, but never name one unless no other id is there; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import id_and_text, id_type, ship, sized, stored

RADIUS = 2
_LANES = np.uint64(0x0101010101010101)
_AT_ONCE = 250_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    dim = radius + 1
    vector = [i % ((1 << dim) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, 1 << dim)]


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII spaces split
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprints of texts whose hashes stand one after another in ``hashes``, ``sizes`` of them each.

    Bits are counted eight at a time in the byte lanes of a word, over runs of at most 255 hashes.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    runs = -(-n // 255)
    first = np.cumsum(n) - n
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    at, own = np.repeat(first, runs) + 255 * nth, np.cumsum(runs) - runs
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, at)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), own, axis=0, dtype=np.int64)
        for lane in range(8):
            out[full] |= (2 * ones[:, lane] > n).astype(np.uint64) << np.uint64(8 * lane + j)
    return out


def _fingerprints(words: int):
    def run(batches):
        for b in sized(batches):
            found, hashes, sizes = [], [], []
            for text in b.column(1):
                h = shingle_hashes(text.as_py(), words)
                hashes.extend(h)
                sizes.append(len(h))
                if len(hashes) >= _AT_ONCE:
                    found.append(majority(np.array(hashes, np.uint64), np.array(sizes, np.int64)))
                    hashes, sizes = [], []
            found.append(majority(np.array(hashes, np.uint64), np.array(sizes, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a bigint)."""
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(_fingerprints(words), f"doc_id {id_type(rows)}, fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that join ``node`` values whose ``fp`` are within RADIUS bits. ``fps``: fp (distinct), node."""
    masks = covering_masks()
    tables = fps.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for t, m in enumerate(masks)])).alias("x")).select("fp", "node", "x.t", "x.part")
    # written first, so that the join has a plain exchange on either side and Spark can split a hot part
    shared = stored(tables.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    free = F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    met = tables.join(shared, ["t", "part"]).select("fp", "node", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), free[F.col("t")])).alias("flip"))
    value = met.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).agg(F.min("node").alias("b"), F.collect_set("node").alias("nodes"))
    return value.filter(F.size("nodes") > 1).select(F.explode("nodes").alias("a"), "b").filter("a != b").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id.

    Without ``similarity`` fingerprints within RADIUS bits are linked. With it texts of at least that Jaccard similarity
    are: what the covering tables link is verified, and what lies farther apart in bits is found by ``set_join``, for
    64 bits put two texts of 0.8 about ten bits apart, beyond any radius whose tables could be made.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if similarity is not None:
        from .set_join import similar_sets

        return similar_sets(docs, id_col, text_col, words, similarity, join_empty=True, covering=True).select("doc_id", hexed, "component_id")
    marked = stored(fingerprints(docs, id_col, text_col, words))
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(links(fps.filter("node is not null")))
    # written first, so that the join has a plain exchange on either side and Spark can split a hot fingerprint
    named = stored(fps.join(roots.withColumnRenamed("a", "node"), "node", "left").select("fp", F.coalesce("b", "node").alias("component_id")))
    return marked.join(named, "fp").select("doc_id", hexed, "component_id")
