"""Documents linked by the exact Jaccard similarity of their word shingles: a grouped prefix join.

Two sets of at least ``similarity`` share one of their first n - ceil(similarity * n) + 1 members in any fixed order.
The order is that of the hashes, with grams that are common in a sample last; which are common changes the work, never
the result. Prefix members that no other document has in its prefix are dropped before anything moves, by a filter of
slots hit twice. Documents with the same prefix and size form a group, and only groups meet, at the prefix members
they share.

Of the groups at a shared member the one with fewest rare grams is its hub. Round one compares each group's lead with
those of its hubs, and a group's texts with its lead. Round two compares what is left: where texts of several components
meet under a hub, those outside the hub's component with all others. Pairs of groups go if their sizes, or the members that their
prefixes share together with what is left of the one whose prefix ends first, can't reach the similarity; pairs of texts
go if the bits of one, set by its shingles, that the other lacks are too many. Whole sets, read from the texts again,
decide on the rest.

Defined results: A-Z are lower-cased, words are runs without ASCII white space; a text of fewer than ``words`` words is
one shingle; null texts and texts without words have no shingles, link with nothing (or, with ``join_empty``, with each
other); rows with a null id are compared like others but never name a component, whose id is null if no other id is
there; repeated rows give repeated rows of result; an empty table gives an empty result; other columns are ignored.
Shingles are compared by 62-bit hashes, whole sets by 64-bit ones.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .bloom_dedup import hit, key_filter, plan, repeated_slots
from .common import alone, discard, id_and_text, id_type, ship, sized, stored
from .repeats import byte_symbols, mix, span, sums, word_bounds
from .simhash import _signed, links, majority

_SAMPLE, _DEPTH, _MOST_COMMON = 16, 4, 1_000_000
_LAST = np.int64(1 << 62)
_SLOTS_PER_GRAM = 8
_SET = "t bigint, s bigint, gid bigint, n bigint, fp bigint, rare int, bits array<bigint>, grams array<bigint>"
_WORDS = 16  # of 64 bits, in the signature of a set


def prefix(n: int, share: Fraction) -> int:
    return n + 1 + (-share.numerator * n // share.denominator) if n else 0


_NO_BITS = np.zeros(0, np.int64)
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(64)], np.uint64)
_BYTES = 1 << 18  # of texts hashed together


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text a 64-bit hash of each shingle, from its words' hashes; of the whole sequence if it is shorter."""
    out, part, size = [], [], 0
    for n, text in enumerate(texts, 1):
        part.append((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z change, only ASCII spaces split
        size += len(part[-1])
        if size >= _BYTES or n == len(texts):
            out += _hashed(part, words)
            part, size = [], 0
    return out


def _hashed(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = b"\n".join(texts)
    starts, ends = word_bounds(data)
    found = mix(span(sums(byte_symbols(data)), starts, ends) + (ends - starts).astype(np.uint64) * _ODD[0])
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # of each text: its first word
    rolled = np.zeros(max(0, len(found) - words + 1), np.uint64)
    for k in range(words):
        rolled += found[k : len(rolled) + k] * _ODD[k]
    rolled, out = mix(rolled), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if 0 < b - a < words:
            few = found[a:b] * _ODD[: b - a]
            few[0] += np.array([words - b + a], np.uint64)[0]
            out.append(mix(few.sum(keepdims=True)))
        else:
            out.append(rolled[a : max(a, b - words + 1)])
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """One bit for each shingle, of 64 * _WORDS. A bit that another set's signature lacks is a shingle that set lacks."""
    bits = np.zeros(64 * _WORDS, np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(64 * _WORDS)] = 1
    return np.packbits(bits).view(np.int64)


def _sets(words: int, share: Fraction, late=None, wanted=None, whole: bool = False, marks: bool = False):
    """Rows (id, text, hash of the text) to _SET: the first members of a set (``whole``: all), those among ``late``, a
    broadcast sorted array, after all others. ``rare``: members of the whole set that are not among ``late``. With
    ``wanted``, a Bloom filter, texts whose hash it doesn't hold are left out. ``fp``, the SimHash, is 0 without ``marks``."""

    def run(batches):
        alone()
        for b in batches:
            if wanted:
                bits, *sizes = wanted
                b = b.filter(pa.array(hit(b.column(2).to_numpy(), bits.value, *sizes)))
            for part in sized([b]):
                out = [[] for _ in range(7)]
                hashes = shingles(part.column(1).to_pylist(), words)
                fps = [0] * len(hashes)
                if marks:
                    fps = majority(np.concatenate([np.zeros(0, np.uint64), *hashes]), np.array([*map(len, hashes)], np.int64)).view(np.int64).tolist()
                for own, fp in zip(hashes, fps):
                    grams = np.sort((own >> np.uint64(2)).view(np.int64))
                    grams = grams[np.diff(grams, prepend=-1) != 0]
                    n, rare, s = len(grams), len(grams), _signed(xxhash.xxh64_intdigest(grams.tobytes()))
                    if not whole:
                        if late is not None and len(late.value):
                            at = np.minimum(np.searchsorted(late.value, grams), len(late.value) - 1)
                            often = late.value[at] == grams
                            rare -= int(often.sum())
                            grams = np.sort(np.where(often, grams + _LAST, grams))
                        grams = grams[: prefix(n, share) * (1 if late is not None else _DEPTH)]
                    gid = _signed(xxhash.xxh64_intdigest(grams.tobytes(), n))
                    for column, value in zip(out, (s, gid, n, fp, rare, signature(own) if late is not None else _NO_BITS, grams)):
                        column.append(value)
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)], dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *c]))) for c in out[5:]]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, t) for c, t in zip(out, types)), *lists], ["doc_id", "t", "s", "gid", "n", "fp", "rare", "bits", "grams"])

    return run


def _shared_members(bits, slots: int):
    """Keeps, of each prefix, the members whose slot is hit twice; ``last``: the prefix's last member."""

    def run(batches):
        for b in batches:
            grams = b.column(b.num_columns - 1)
            offsets, values = grams.offsets.to_numpy(), grams.flatten().to_numpy()
            offsets = offsets - offsets[0]
            keep = hit(values, bits.value, slots, 1)
            before = np.concatenate([[0], np.cumsum(keep)])[offsets]
            lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(values[keep]))
            sizes = np.diff(offsets)
            last = pa.array(np.append(values, 0)[np.maximum(offsets[1:] - 1, 0)] if len(sizes) else np.zeros(0, np.int64), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, last], [*b.schema.names[:-1], "toks", "last"])

    return run


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float = 0.9, join_empty: bool = False, covering: bool = False) -> DataFrame:
    """doc_id, fp (SimHash of the shingles, with ``covering``), n (shingles), component_id, for every row of ``docs``: texts of at least
    that similarity, and what they link, share the smallest id among them. With ``covering`` the pairs that SimHash's
    covering tables link are compared first."""
    spark, share = docs.sparkSession, Fraction(similarity).limit_denominator(1000)
    ship(spark)
    rows = id_and_text(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    schema = f"doc_id {id_type(rows)}, {_SET}"

    often = rows.filter(F.pmod("t", F.lit(_SAMPLE)) == 0).mapInArrow(_sets(words, share), schema).dropDuplicates(["s"])
    often = often.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 2")
    often = often.orderBy(F.col("k").desc(), "g").limit(_MOST_COMMON).select("g").toPandas()
    late = spark.sparkContext.broadcast(np.sort(often["g"].to_numpy(np.int64)))
    marked = stored(rows.mapInArrow(_sets(words, share, late, marks=covering), schema))

    members = marked.agg(F.sum(F.size("grams"))).first()[0] or 0
    slots = plan(members, _SLOTS_PER_GRAM)[1]
    bits = spark.sparkContext.broadcast(repeated_slots(marked.select("grams"), slots, 1))
    kept = marked.mapInArrow(_shared_members(bits, slots), schema.replace("grams array<bigint>", "toks array<bigint>, last bigint"))
    same = [F.first(c).alias(c) for c in ("gid", "n", "fp", "rare", "bits", "toks", "last")]
    texts = stored(kept.groupBy("s").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.min("doc_id").alias("node"), *same))
    groups, met, asked = _first_pairs(texts, share, covering)
    linked = _verified(rows, texts, asked, words, share, schema)
    more = stored(_other_pairs(texts, groups, met, linked, share).join(asked, ["a", "b"], "left_anti"))
    linked = stored(linked.unionByName(_verified(rows, texts, more, words, share, schema)))

    roots = components(linked).withColumnRenamed("a", "s").withColumnRenamed("b", "root")
    held = stored(texts.select("s", "node").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")))
    least = stored(held.groupBy("root").agg(F.min("node").alias("component_id")))
    named = stored(held.join(least, "root").select("s", "component_id"))
    discard(texts, groups, met, asked, more, linked, held, least)
    found = marked.select("doc_id", "fp", "n", "s").join(named, "s")
    own = F.col("component_id") if join_empty else F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "fp", "n", own.alias("component_id"))


def _can_be(share: Fraction) -> F.Column:
    """Whether the sizes ``an`` and ``bn`` allow the similarity."""
    return F.least("an", "bn") * share.denominator >= F.greatest("an", "bn") * share.numerator


def _least(share: Fraction) -> F.Column:
    """How many prefix members groups a and b must share: what the similarity asks of both sets, without all that is
    behind the prefix that ends first."""
    x, y, z = share.numerator, share.denominator, share.numerator + share.denominator
    asked = F.expr(f"({x} * (an + bn) + {z - 1}) div {z}")
    a, b = (F.expr(f"({x} * {k}n + {y - 1}) div {y} - 1") for k in "ab")  # a set's members behind its prefix
    left = F.when(F.col("alast") < F.col("blast"), a).when(F.col("alast") > F.col("blast"), b).otherwise(F.least(a, b))
    return F.greatest(F.lit(1), asked - left)


def _few_enough_apart(share: Fraction) -> F.Column:
    """Whether the signatures ``a0`` ... and ``b0`` ... allow the similarity."""
    apart = lambda p, q: reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{p}{i}").bitwiseAND(F.bitwise_not(F.col(f"{q}{i}")))) for i in range(_WORDS)])
    both = F.least(F.col("an") - apart("a", "b"), F.col("bn") - apart("b", "a"))
    return both * (share.numerator + share.denominator) >= (F.col("an") + F.col("bn")) * share.numerator


def _sided(rows: DataFrame, *columns: str) -> list[DataFrame]:
    """The columns as those of side a, and of side b; ``bits`` as one column for each word."""
    return [rows.select(*[c for name in columns for c in ([F.get("bits", F.lit(i)).alias(f"{k}{i}") for i in range(_WORDS)] if name == "bits" else [F.col(name).alias(k + name)])]) for k in "ab"]


def _first_pairs(texts: DataFrame, share: Fraction, covering: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, which group meets under which hub, pairs (a, b) of texts to be compared first, a > b)."""
    same = [F.first(c).alias(c) for c in ("n", "toks", "last")]
    groups = stored(texts.filter("n > 0").groupBy("gid").agg(F.min("s").alias("lead"), F.min_by("bits", "s").alias("bits"), F.min("rare").alias("rare"), F.count(F.lit(1)).alias("texts"), *same).withColumn("m", F.size("toks")))
    inside = texts.join(groups.filter("texts > 1").select("gid", "lead"), "gid").filter("s != lead").select(F.col("s").alias("x"), F.col("lead").alias("y"))
    tokens = groups.select("gid", "rare", F.explode("toks").alias("g"))
    hubs = stored(tokens.groupBy("g").agg(F.min(F.struct("rare", "gid")).alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("g", F.col("hub.gid").alias("hub")))
    met = stored(tokens.select("g", "gid").join(hubs, "g").select("gid", "hub").distinct())
    discard(hubs)
    left, right = _sided(groups, "gid", "n", "last", "m")
    star = met.filter("gid != hub").toDF("agid", "bgid").join(left, "agid").join(right, "bgid").filter(_can_be(share) & (_least(share) <= F.least("am", "bm")))
    star = stored(star.select("agid", "bgid"))
    left, right = _sided(groups, "gid", "lead", "n", "last", "toks", "bits")
    near = star.join(left, "agid").join(right, "bgid").filter((F.size(F.array_intersect("atoks", "btoks")) >= _least(share)) & _few_enough_apart(share))
    pairs = inside.unionByName(near.select(F.col("alead").alias("x"), F.col("blead").alias("y")))
    if covering:
        meant = stored(texts.groupBy("fp").agg(F.min("s").alias("node")))
        equal = texts.select("s", "fp").join(meant, "fp").filter("s != node").select(F.col("s").alias("x"), F.col("node").alias("y"))
        pairs = pairs.unionByName(equal).unionByName(links(meant).toDF("x", "y"))
    asked = stored(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    discard(star)
    return groups, met, asked


def _other_pairs(texts: DataFrame, groups: DataFrame, met: DataFrame, linked: DataFrame, share: Fraction) -> DataFrame:
    """Pairs (a, b) of texts of different components, a > b, that can be similar.

    Groups that share a member meet under its hub. There the hub's component stands aside: its texts meet the others,
    not each other.
    """
    roots = components(linked).withColumnRenamed("a", "s").withColumnRenamed("b", "c")
    placed = stored(texts.filter("n > 0").select("s", "gid").join(roots, "s", "left").withColumn("c", F.coalesce("c", "s")))
    # own: the component of a group's texts, null if they have several
    spread = stored(placed.groupBy("gid").agg(F.min("c").alias("c"), F.max("c").alias("d")).select("gid", F.when(F.col("c") == F.col("d"), F.col("c")).alias("own")))
    sided = met.join(spread, "gid")
    main = sided.groupBy("hub").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count_if(F.col("own").isNull()).alias("several"), F.max(F.when(F.col("gid") == F.col("hub"), F.col("own"))).alias("main"))
    main = stored(main.filter("lo != hi or several > 0").select("hub", "main"))
    outside = F.col("own").isNull() | F.col("main").isNull() | (F.col("own") != F.col("main"))
    open_ = sided.join(main, "hub").select("hub", "gid", "own", outside.alias("outside"))
    open_ = stored(open_.join(groups.select("gid", "n", "m", "last", "bits"), "gid"))
    a, b = (x.withColumnRenamed(f"{k}hub", "hub") for k, x in zip("ab", _sided(open_, "hub", "gid", "n", "last", "m", "own", "outside", "bits")))
    once = ~F.col("boutside") | (F.col("agid") > F.col("bgid"))
    apart = F.col("aown").isNull() | F.col("bown").isNull() | (F.col("aown") != F.col("bown"))
    pairs = a.filter("aoutside").join(b, "hub").filter(once & apart & _can_be(share) & (_least(share) <= F.least("am", "bm")) & _few_enough_apart(share))
    # texts of one group have signatures of their own, so groups of several meet as they are
    many = groups.filter("texts > 1").select("gid")
    pairs = pairs.select("agid", "bgid").unionByName(_of_many(open_, many, share))
    pairs = stored(pairs.select(F.greatest("agid", "bgid").alias("agid"), F.least("agid", "bgid").alias("bgid")).distinct())
    left, right = _sided(groups, "gid", "n", "last", "toks")
    shares = pairs.join(left, "agid").join(right, "bgid").filter(F.size(F.array_intersect("atoks", "btoks")) >= _least(share)).select("agid", "bgid")
    several = spread.filter("own is null").select(F.col("gid").alias("agid"), F.col("gid").alias("bgid"))
    near = stored(shares.unionByName(several))
    left, right = _sided(placed, "gid", "s", "c")
    found = near.join(left, "agid").join(right, "bgid").filter("ac != bc").select(F.greatest("as", "bs").alias("a"), F.least("as", "bs").alias("b"))
    left, right = _sided(texts, "s", "n", "bits")
    found = stored(found.distinct()).join(left, F.col("a") == F.col("as")).join(right, F.col("b") == F.col("bs")).filter(_few_enough_apart(share))
    found = stored(found.select("a", "b"))
    discard(placed, spread, main, open_, pairs, near)
    return found


def _of_many(open_: DataFrame, many: DataFrame, share: Fraction) -> DataFrame:
    """Pairs of groups that meet, one of them of several texts, by all but the signatures, which are those of the leads."""
    rows = open_.drop("bits")
    a, b = (x.withColumnRenamed(f"{k}hub", "hub") for k, x in zip("ab", _sided(rows, "hub", "gid", "n", "last", "m", "own", "outside")))
    apart = F.col("aown").isNull() | F.col("bown").isNull() | (F.col("aown") != F.col("bown"))
    pairs = a.join(many.withColumnRenamed("gid", "agid"), "agid", "left_semi").join(b, "hub").filter((F.col("aoutside") | F.col("boutside")) & (F.col("agid") != F.col("bgid")) & apart)
    return pairs.filter(_can_be(share) & (_least(share) <= F.least("am", "bm"))).select("agid", "bgid")


def _verified(rows: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, share: Fraction, schema: str) -> DataFrame:
    """Those of the pairs (a, b) that have the similarity. The set of a pair's end with fewer pairs travels to the other's."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("s"))
    keys = stored(ends.groupBy("s").agg(F.count(F.lit(1)).alias("k")))
    if keys.isEmpty():
        return pairs
    asked = stored(texts.join(keys, "s").select(F.xxhash64("at.doc_id", "at.t").alias("h")))
    # asked in the task that makes the sets, so texts never move
    one = rows.withColumn("t", F.xxhash64("doc_id", "t"))
    sets = stored(one.mapInArrow(_sets(words, share, wanted=key_filter(asked, "h", hashed=True), whole=True), schema).select("s", "n", "grams"))
    counted = pairs.join(keys.select(F.col("s").alias("a"), F.col("k").alias("ka")), "a").join(keys.select(F.col("s").alias("b"), F.col("k").alias("kb")), "b")
    more = F.col("ka") > F.col("kb")
    ways = stored(counted.select(F.when(more, F.col("b")).otherwise(F.col("a")).alias("m"), F.when(more, F.col("a")).otherwise(F.col("b")).alias("h")))
    left, right = (sets.select(F.col("s").alias(k), F.col("n").alias(f"n{k}"), F.col("grams").alias(f"g{k}")) for k in "mh")
    both = ways.join(left, "m").join(right, "h").withColumn("shared", F.size(F.array_intersect("gm", "gh")))
    good = both.filter(F.col("shared") * (share.numerator + share.denominator) >= (F.col("nm") + F.col("nh")) * share.numerator)
    out = stored(good.select(F.greatest("m", "h").alias("a"), F.least("m", "h").alias("b")).distinct())  # a text that was read twice counts once
    discard(keys, asked, sets, ways)
    return out
