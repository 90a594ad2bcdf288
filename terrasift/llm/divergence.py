"""How far the sources of a language differ in their words, by counts of packed terms.

A term is a run of letters: A-Z (made lower case), a-z and every character beyond ASCII. Tasks count terms without
making strings: a term of at most 8 bytes is one unsigned 64-bit word, one of at most 16 bytes two, both padded with
zero bytes, which no term holds; each of the two buckets is sorted by radix passes over 16-bit digits and counted by
runs. Longer terms go to a bucket for each power of two of bytes and are sorted as byte strings. A task counts about
TERMS_AT_ONCE terms, then sends one row for each different (language, source, term).

A language keeps the terms that are in at least ``min_docs`` of its documents. Shares are whole numbers, billionths
after adding ``prior`` to every count, so all arithmetic is exact. Distances between all sources of a language are
summed over its terms in tasks that hold SOURCES_AT_ONCE x SOURCES_AT_ONCE sums; a language with more sources is
compared block by block, its terms dealt over SALTS parts.

Defined results: null text, language and source are ''; a source without kept terms has the share that ``prior`` alone
gives; a language that keeps no term has no rows of terms and distances of 0; a language of one source has no pairs;
repeated rows count each; ids are not looked at; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ship, stored

TERMS_AT_ONCE = 2_000_000
SOURCES_AT_ONCE = 512
SALTS = 32
_PIECE = 4 << 20  # bytes of text packed at once
_CELLS = 2_000_000  # of the table of shares held at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True

_PACKED = (0, 1)  # buckets of one and of two words


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows of unsigned 64-bit words, the first of which counts most."""
    order = np.arange(len(words[0]))
    for w in reversed(words):
        for shift in range(0, 64, 16):
            digit = ((w >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of texts that stand one after another start and end; ``offsets`` are the texts' bounds."""
    inside = _LETTER[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The 1 to 8 bytes from each start as one word. ``data`` has 16 bytes to spare."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[starts].view(">u8").ravel().astype(np.uint64)
    beyond = (8 * (8 - sizes)).astype(np.uint64)
    return eight >> beyond << beyond


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """bucket -> (which terms, their columns): 0 and 1 are one and two words, k above 4 byte strings of at most 2^k."""
    sizes = ends - starts
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    out = {}
    if len(short := np.flatnonzero(sizes <= 8)):
        out[0] = short, [_words(data, starts[short], sizes[short])]
    if len(two := np.flatnonzero((sizes > 8) & (sizes <= 16))):
        out[1] = two, [_words(data, starts[two], np.full(len(two), 8)), _words(data, starts[two] + 8, sizes[two] - 8)]
    long = np.flatnonzero(sizes > 16)
    level = np.ceil(np.log2(np.maximum(sizes[long], 17))).astype(int)
    for k in np.unique(level).tolist():
        own = long[level == k]
        out[k] = own, [np.array([data[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist())], object)]
    return out


class TermCounts:
    """Counts of (term, document) by bucket; ``compact`` adds up equal ones."""

    def __init__(self):
        self.buckets: dict[int, list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, first_doc: int) -> None:
        starts, ends = term_bounds(data, offsets)
        doc = first_doc + np.searchsorted(offsets, starts, "right") - 1
        for k, (own, columns) in packed(data, starts, ends).items():
            self.buckets.setdefault(k, []).append((columns, doc[own], np.ones(len(own), np.int64)))
            self.size += len(own)

    @staticmethod
    def _sorted(k: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The stable order by term, and where in it another term begins."""
        order = radix_order(columns) if k in _PACKED else np.argsort(columns[0], kind="stable")
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        return order, new

    def compact(self) -> None:
        self.size = 0
        for k, parts in self.buckets.items():
            columns = [np.concatenate(c) for c in zip(*(p[0] for p in parts))]
            doc, n = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            order, new = self._sorted(k, columns)  # documents come in order, and stay so within a term
            doc = doc[order]
            new[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(new)
            self.buckets[k] = [([c[order][at] for c in columns], doc[at], np.add.reduceat(n[order], at))]
            self.size += len(at)

    def rows(self, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(term, group, n, documents) columns for each bucket; ``group``: of each document."""
        self.compact()
        for k, [(columns, doc, n)] in self.buckets.items():
            g = group[doc]
            by = np.argsort(g.astype(np.uint16) if len(group) < 1 << 16 else g, kind="stable")
            order, new = self._sorted(k, [c[by] for c in columns])
            order, g = by[order], g[by[order]]
            new[1:] |= g[1:] != g[:-1]
            at = np.flatnonzero(new)
            columns = [c[order][at] for c in columns]
            if k in _PACKED:
                raw = np.stack(columns, axis=1).astype(">u8").view(f"S{8 * len(columns)}").ravel()
                term = pa.array(raw, pa.binary())
            else:
                term = pa.array(columns[0], pa.binary())
            yield term.cast(pa.string()), g[at], np.add.reduceat(n[order], at), np.diff(np.append(at, len(order)))


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes in lower case, bounds of the texts in them, number of the first text) of at most about _PIECE bytes; a
    longer text comes in parts that end between terms."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        if end > at + 1 or high - low <= _PIECE:
            yield _LOWER[data[low:high]], offsets[at : end + 1] - low, at
        else:
            while low < high:
                cut = min(high, low + _PIECE)
                while cut < high and _LETTER[_LOWER[data[cut]]] and _LETTER[_LOWER[data[cut - 1]]]:
                    cut += 1
                yield _LOWER[data[low:cut]], np.array([0, cut - low]), at
                low = cut
        at = end


def _count(terms_at_once: int):
    names = ["lang", "source", "term", "n", "docs"]

    def told(counts: TermCounts, groups: dict[tuple[str, str], int], of: list[int]) -> Iterator[pa.RecordBatch]:
        lang, source = (pa.array(x, pa.string()) for x in zip(*groups)) if groups else (None, None)
        for term, g, n, docs in counts.rows(np.array(of, np.int64)):
            g = pa.array(g)
            whole = pa.RecordBatch.from_arrays([lang.take(g), source.take(g), term, pa.array(n), pa.array(docs)], names)
            for at in range(0, whole.num_rows, 50_000):
                yield whole.slice(at, 50_000)

    def run(batches):
        counts, groups, of = TermCounts(), {}, []
        for b in batches:
            first = len(of)
            of += [groups.setdefault(key, len(groups)) for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for data, offsets, doc in _pieces(b.column(2)):
                counts.add(data, offsets, first + doc)
                if counts.size > 2 * terms_at_once:
                    counts.compact()
            if counts.size > terms_at_once:
                yield from told(counts, groups, of)
                counts, groups, of = TermCounts(), {}, []
        if of:
            yield from told(counts, groups, of)

    return run


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    ship(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    parts = rows.mapInArrow(_count(terms_at_once), "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class _Sums:
    """Sums of differences between the shares of some sources of a language, over some of its terms."""

    def __init__(self, lang: str, same: bool, names: np.ndarray, nth: np.ndarray, base: np.ndarray, block: np.ndarray):
        self.lang, self.names, self.nth, self.base = lang, names, nth, base
        self.wanted = ~np.eye(len(nth), dtype=bool) if same else block[:, None] != block[None, :]
        self.left = np.zeros((len(nth), len(nth)), np.int64)

    def add(self, offsets: np.ndarray, nth: np.ndarray, share: np.ndarray) -> None:
        """Terms that have (source, share) entries between two offsets; a source without an entry has its base share.
        Adds by how much the sources differ more than their base shares do."""
        step = max(1, _CELLS // len(self.nth))
        for at in range(0, len(offsets) - 1, step):
            own = offsets[at : at + step + 1]
            table = np.tile(self.base, (len(own) - 1, 1))
            s = slice(own[0], own[-1])
            table[np.repeat(np.arange(len(table)), np.diff(own)), np.searchsorted(self.nth, nth[s])] = share[s]
            for i in range(len(self.nth)):
                self.left[i] += np.abs(table - table[:, i : i + 1]).sum(axis=0)
            self.left -= len(table) * np.abs(self.base[:, None] - self.base[None, :])

    def told(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.wanted)
        names = pa.array(self.names, pa.string())
        columns = [pa.array([self.lang] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), *map(pa.array, (self.left[i, j], self.base[i], self.base[j]))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value", "own", "other"])


def _distances(batches):
    """Rows come sorted by block and part; each of these begins with the one row, without a term, of its sources."""
    sums = None
    for b in batches:
        offsets, x = b.column(5).offsets.to_numpy(), b.column(5).values
        x = {f.name: x.field(f.name).to_numpy(zero_copy_only=False) for f in x.type}
        heads = np.flatnonzero(b.column(4).is_null().to_numpy(zero_copy_only=False)).tolist()
        at = 0
        for head in [*heads, b.num_rows]:
            if head > at:
                sums.add(offsets[at : head + 1], x["nth"], x["share"])
            if head < b.num_rows:
                if sums:
                    yield sums.told()
                s = slice(offsets[head], offsets[head + 1])
                lang, low, high = (b.column(k)[head].as_py() for k in range(3))
                sums = _Sums(lang, low == high, *(x[k][s] for k in ("name", "nth", "share", "block")))
            at = head + 1
    if sums:
        yield sums.told()


def _share(count, total, kept, prior: int):
    """1 + floor(10^9 (count + prior) / (total + prior * kept)), exact beyond 64 bits."""
    return (F.expr(f"(cast(1000000000 as decimal(10,0)) * cast({count} + {prior} as decimal(20,0))) div cast({total} + {prior} * {kept} as decimal(20,0))") + 1).cast("bigint")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, prior: int = 5, ranks: int = 50, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source to each other one of its language (``pair``),
    and its ``ranks`` terms that exceed their share in the language most (``term``); and the shares ``own`` and
    ``other`` that a ``term`` row compares."""
    counts = stored(term_counts(docs, text_col, lang_col, source_col, terms_at_once))
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= min_docs).drop("docs"))
    vocabulary = stored(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang")))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source")))).distinct()
    used = stored(counts.join(kept, ["lang", "term"]).drop("docs"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    nth = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("nth")
    groups = names.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "kept"]).select("*", nth)
    base = F.when(F.col("kept") > 0, _share("0", "total", "greatest(kept, 1)", prior)).otherwise(0).alias("base")
    groups = stored(groups.select("*", base, F.floor(F.col("nth") / SOURCES_AT_ONCE).cast("int").alias("block")))
    shares = stored(used.join(groups, ["lang", "source"]).select("lang", "source", "term", "nth", "block", "n_lang", "total_lang", "kept", _share("n", "total", "kept", prior).alias("share")))
    discard(counts, kept, used)

    other = _share("n_lang", "total_lang", "kept", prior)
    over = shares.select("lang", "source", F.col("term").alias("item"), F.col("share").alias("own"), other.alias("other")).filter("own > other").withColumn("value", F.col("own") - F.col("other"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks).withColumn("part", F.lit("term"))

    last = groups.groupBy("lang").agg(F.max("block").alias("last"))

    def blocks(rows: DataFrame) -> DataFrame:
        """Each row for every pair of blocks that its source's block is in."""
        rows = rows.join(last, "lang").withColumn("mate", F.explode(F.sequence(F.lit(0), "last")))
        return rows.withColumns({"low": F.least("block", "mate"), "high": F.greatest("block", "mate")})

    named = F.struct("nth", F.col("base").alias("share"), "block", F.col("source").alias("name"))
    heads = blocks(groups).groupBy("lang", "low", "high").agg(F.sort_array(F.collect_list(named)).alias("held"))
    heads = heads.select("lang", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("string").alias("term"), "held")
    salted = blocks(shares).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).repartition("lang", "low", "high", "salt")
    entry = F.struct("nth", "share", F.lit(None).cast("int").alias("block"), F.lit(None).cast("string").alias("name"))
    rows = salted.groupBy("lang", "low", "high", "salt", "term").agg(F.collect_list(entry).alias("held"))  # at most two blocks of sources
    held = heads.unionByName(rows).repartition("lang", "low", "high", "salt").sortWithinPartitions("lang", "low", "high", "salt", F.asc_nulls_first("term"))
    sums = held.mapInArrow(_distances, "lang string, source string, item string, value bigint, own bigint, other bigint")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.max("own").alias("own"), F.max("other").alias("other"))
    whole = sums.join(vocabulary.select("lang", "kept"), "lang", "left").na.fill(0, ["kept"])
    whole = whole.select("lang", "source", "item", (F.col("value") + F.col("kept") * F.abs(F.col("own") - F.col("other"))).alias("value"))
    pairs = whole.select("*", F.row_number().over(order).alias("rank"), F.lit("pair").alias("part"))
    names = ["lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank")]
    nothing = F.lit(None).cast("bigint")
    return pairs.select(*names, nothing.alias("own"), nothing.alias("other")).unionByName(terms.select(*names, "own", "other"))
