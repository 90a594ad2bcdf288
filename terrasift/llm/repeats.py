"""Finds what may repeat: the part that the suffix-tree and the suffix-array dedup share.

A text is a sequence of symbols (bytes, or hashes of words), a window is ``length`` consecutive symbols. Each window
has an anchor: of the ``gram``-symbol runs in it, the leftmost of least hash. Equal windows have equal anchors at equal
places, so windows only need to be compared with windows of the same anchor gram, and consecutive windows share an
anchor, so they travel together as a segment: all symbols of the windows that start in [lo, hi].

1. Grams that occur once in all texts are dropped: none of their windows repeats.
2. Equal segments are counted before anything else moves; one of each is cut out of its text.
3. Segments meet by gram, which starts the suffixes at their anchors. A gram with more than ``group_limit`` different
   segments is lengthened, by half of what a window has left: the windows that have more behind the anchor than before
   it take the symbols behind it into the gram, the others those before it. Segments split accordingly, equal ones are
   counted again, and so on until every group fits. The longest gram is a whole window, of which all segments are equal.
4. A judge (the suffix structure) takes whole groups, sorted, a bounded chunk at a time, and says which windows repeat,
   and the smallest document id of each.
5. The judged windows go back to every occurrence of their segment, and to their texts.

Texts shuffle once, by document; both uses share that exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, ship, sized, stored

_BASE, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_NO_ID = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX_A
    x = (x ^ (x >> np.uint64(29))) * _MIX_B
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        size = 2 * n + 1
        for at, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            _powers[at] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base))])
    return _powers


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def sums(symbols: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * _up_to(len(symbols))[0][: len(symbols)])])


def span(total: np.ndarray, start, end) -> np.ndarray:
    """Hash of the symbols in [start, end), the same wherever they stand."""
    return mix((total[end] - total[start]) * _powers[1][start])


def byte_symbols(data: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(data, np.uint8)]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words, runs without ASCII white space, start and end."""
    inside = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_symbols(data: bytes) -> np.ndarray:
    starts, ends = word_bounds(data)
    return mix(span(sums(byte_symbols(data)), starts, ends) + (ends - starts).astype(np.uint64) * _MIX_A)


def anchors(symbols: np.ndarray, length: int, gram: int):
    """gram hash, segment hash, lo, hi - lo, anchor - lo for each anchor of a text. None if it has no window."""
    windows = len(symbols) - length + 1
    if windows <= 0:
        return None
    total, width = sums(symbols), length - gram + 1  # width: grams in a window, below 256
    count = len(symbols) - gram + 1
    at = np.arange(count)
    hashes = span(total, at, at + gram)
    keys = np.full(-(-count // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[:count] = (hashes & np.uint64(0xFFFFFFFFFFFFFF00)) | (at % width).astype(np.uint64)
    blocks = keys.reshape(-1, width)
    # a window is the end of a block and the start of the next; in a block the lower place wins a tie
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    right = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + windows]
    i, low = np.arange(windows), np.uint64(255)
    place = np.where((left >> np.uint64(8)) <= (right >> np.uint64(8)), i // width * width + (left & low).astype(np.int64), (i + width - 1) // width * width + (right & low).astype(np.int64))
    lo = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    hi = np.append(lo[1:] - 1, windows - 1)
    place = place[lo]
    own = mix(span(total, lo, hi + length) + (place - lo).astype(np.uint64) * _MIX_A + (hi - lo).astype(np.uint64) * _MIX_B)
    return hashes[place].view(np.int64), own.view(np.int64), lo, hi - lo, place - lo


@dataclass(frozen=True)
class Kind:
    """What a symbol is, and the sizes that follow."""

    words: bool
    length: int
    gram: int

    def symbols(self, data: bytes) -> np.ndarray:
        return word_symbols(data) if self.words else byte_symbols(data)


def _bytes(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


_ANCHORS = "gram bigint, own bigint, d bigint, tag bigint, lo int, extra smallint, place smallint"


def _find(kind: Kind):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16()]
    names = ["gram", "own", "d", "tag", "lo", "extra", "place"]

    def run(batches):
        for b in batches:
            parts, size = [], 0
            for d, tag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (found := anchors(kind.symbols(_bytes(text)), kind.length, kind.gram)) is None:
                    continue
                gram, own, lo, extra, place = found
                parts.append((gram, own, np.full(len(lo), d), np.full(len(lo), tag), lo, extra, place))
                size += len(lo)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t, safe=False) for x, t in zip(zip(*parts), types)], names)
                    parts, size = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t, safe=False) for x, t in zip(zip(*parts), types)], names)

    return run


def _pieces(kind: Kind, data: bytes, lo: np.ndarray, extra: np.ndarray) -> list[bytes]:
    """The segments' text; words are joined by one space."""
    if not kind.words:
        return [data[a : a + e + kind.length] for a, e in zip(lo.tolist(), extra.tolist())]
    words = data.split()
    return [b" ".join(words[a : a + e + kind.length]) for a, e in zip(lo.tolist(), extra.tolist())]


def _listed(column: pa.Array):
    """Offsets and fields, as arrays, of a list of structs."""
    offsets, values = column.offsets.to_numpy(), column.values
    return offsets, {f.name: values.field(f.name).to_numpy(zero_copy_only=False) for f in column.type.value_type}


def _cut(kind: Kind):
    """Segments of the chosen anchors, as text."""
    names = ["gram", "own", "n", "least", "extra", "place", "piece"]

    def run(batches):
        for b in batches:
            offsets, x = _listed(b.column(1))
            for row, text in enumerate(b.column(0)):
                s = slice(offsets[row], offsets[row + 1])
                pieces = _pieces(kind, _bytes(text), x["lo"][s], x["extra"][s])
                yield pa.RecordBatch.from_arrays([pa.array(x[n][s]) for n in names[:-1]] + [pa.array(pieces, pa.binary())], names)

    return run


def gram_lengths(kind: Kind) -> list[int]:
    """Of the grams of each level: each takes in half of what a window has left of it."""
    out = [kind.gram]
    while out[-1] < kind.length:
        out.append(out[-1] + -(-(kind.length - out[-1]) // 2))
    return out


def _lengthened(kind: Kind, before: int, now: int):
    """Segments under grams of ``now`` symbols instead of ``before``, in two parts where need be; ``shift`` is where a
    part starts in its segment."""
    step, slack = now - before, kind.length - now
    names = ["gram", "own", "n", "least", "extra", "place", "piece", "of_gram", "of_own", "shift"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        for b in batches:
            out = []
            for gram, own, n, least, extra, place, piece in zip(*(b.column(i).to_pylist() for i in range(7))):
                symbols = kind.symbols(piece)
                words = piece.split() if kind.words else piece
                total = sums(symbols)
                cut = min(max(place - slack, 0), extra + 1)  # windows before it have more before the anchor than behind it
                for lo, hi, at in ((0, cut - 1, place - step), (cut, extra, place)):
                    if lo <= hi:
                        part = words[lo : hi + kind.length]
                        with np.errstate(over="ignore"):
                            key = span(total, at, at + now)
                            itself = mix(span(total, lo, hi + kind.length) + np.uint64(at - lo) * _MIX_A + np.uint64(hi - lo) * _MIX_B)
                        out.append((int(key.view(np.int64)), int(itself.view(np.int64)), n, least, hi - lo, at - lo, b" ".join(part) if kind.words else part, gram, own, lo))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _judged(judge, chunk: int):
    """Feeds a judge whole groups, from rows sorted by gram, about ``chunk`` bytes at a time."""

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size > chunk and r[0] != last:
                    yield judge(rows)
                    rows, size = [], 0
                last = r[0]
                rows.append(r)
                size += len(r[6])
        if rows:
            yield judge(rows)

    return run


def verdict(rows: list[tuple[int, int, list[tuple[int, int, int]]]]) -> pa.RecordBatch:
    """(gram, own, [(off, len, least)]) rows as a batch."""
    runs = pa.array([[{"off": a, "len": b, "least": c} for a, b, c in r[2]] for r in rows], pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32()), ("least", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), runs], ["gram", "own", "runs"])


_VERDICT = "gram bigint, own bigint, runs array<struct<off:int,len:int,least:bigint>>"


_SEGMENT = "gram bigint, own bigint, n bigint, least bigint, extra smallint, place smallint, piece binary"


def _told(pieces: DataFrame, kind: Kind, judge, group_limit: int, chunk_bytes: int, level: int = 0) -> DataFrame:
    """Verdicts on segments, one of each kind, under grams of a level's length."""
    lengths = gram_lengths(kind)
    sizes = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("different"))
    large = stored(sizes.filter(F.col("different") > group_limit).select("gram"))
    fits = pieces if level + 1 == len(lengths) or large.isEmpty() else pieces.join(large, "gram", "left_anti")
    told = fits.repartition("gram").sortWithinPartitions("gram", "own").mapInArrow(_judged(judge, chunk_bytes), _VERDICT)
    if fits is pieces:
        return told
    halves = pieces.join(large, "gram", "left_semi").mapInArrow(_lengthened(kind, *lengths[level : level + 2]), _SEGMENT + ", of_gram bigint, of_own bigint, shift int")
    halves = stored(halves)
    same = stored(halves.groupBy("gram", "own", "extra", "place").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.first("piece").alias("piece")))
    below = stored(_told(same.select(*pieces.columns), kind, judge, group_limit, chunk_bytes, level + 1))
    runs = F.transform("runs", lambda r: r.withField("off", r["off"] + F.col("shift")))
    back = halves.select("gram", "own", "of_gram", "of_own", "shift").join(below, ["gram", "own"]).select(F.col("of_gram").alias("gram"), F.col("of_own").alias("own"), runs.alias("runs"))
    return told.unionByName(back)


def repeats(docs: DataFrame, kind: Kind, judge, other_document: bool, id_col: str = "doc_id", text_col: str = "text", group_limit: int = 1024, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, text, spans: for every row, the covered [start, end) symbol ranges, which may overlap; null if none.

    A window counts if it occurs twice anywhere or, with ``other_document``, if it starts in a document with a smaller
    id. ``judge`` takes (gram, own, n, least, extra, place, piece) rows, whole gram groups, and gives a verdict() of
    the windows that occur more than once in the sum of n, each with its smallest document id.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    keyed = rows.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("tag"), "text")
    every = stored(keyed.mapInArrow(_find(kind), _ANCHORS))
    # written first, so that the join has a plain exchange on either side and Spark can split a hot gram
    twice = stored(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    found = stored(every.join(twice, "gram", "left_semi"))
    discard(every, twice)

    same = found.groupBy("gram", "own", "extra", "place").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.min(F.struct("d", "tag", "lo")).alias("first"))
    at = F.collect_list(F.struct("gram", "own", "n", "least", "extra", "place", "first.lo")).alias("at")
    listed = same.groupBy("first.d", "first.tag").agg(at)
    texts = keyed.repartition("d", "tag")
    pieces = stored(texts.join(listed, ["d", "tag"], "left").filter("at is not null").select("text", "at").mapInArrow(_cut(kind), _SEGMENT))
    told = stored(_told(pieces, kind, judge, group_limit, chunk_bytes))

    hits = found.join(told, ["gram", "own"]).select("d", "tag", "lo", F.explode("runs").alias("run"))
    if other_document:
        hits = hits.filter("run.least < d")
    start = F.col("lo") + F.col("run.off")
    spans = hits.groupBy("d", "tag").agg(F.collect_list(F.struct(start.alias("start"), (start + F.col("run.len") + F.lit(kind.length - 1)).alias("end"))).alias("spans"))
    return texts.join(spans, ["d", "tag"], "left").select(F.when(F.col("d") != _NO_ID, F.col("d")).alias("doc_id"), "text", "spans")


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` symbols the ranges cover."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step)[:size] > 0


def cleaned(found: DataFrame, kind: Kind) -> DataFrame:
    """doc_id, n (symbols), n_removed, n_spans, kept (bytes; words joined by one space)."""

    def run(batches):
        for b in batches:
            offsets, x = _listed(b.column(2))
            out = []
            for row, text in enumerate(b.column(1)):
                data = _bytes(text)
                s = slice(offsets[row], offsets[row + 1])
                symbols = data.split() if kind.words else np.frombuffer(data, np.uint8)
                gone = covered(len(symbols), x["start"][s], x["end"][s])
                if kind.words:
                    kept = b" ".join(w for w, g in zip(symbols, gone.tolist()) if not g) if gone.any() else b" ".join(symbols)
                else:
                    kept = symbols[~gone].tobytes()
                out.append((len(symbols), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n", "n_removed", "n_spans", "kept"])

    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")
    return found.select("doc_id", "text", spans).mapInArrow(run, "doc_id bigint, n bigint, n_removed bigint, n_spans bigint, kept binary")
