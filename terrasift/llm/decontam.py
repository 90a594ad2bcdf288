"""Benchmark decontamination by BM25 and block-max WAND.

The test items form an inverted index with BM25 weights, each divided by its item's own full score, so a passage that
holds every word of an item scores one and a single threshold serves all items. Documents are cut into overlapping
passages, long enough for every item to lie whole in one; each passage is a query. A posting list stands in blocks of
item numbers, aligned in all lists, each with its largest weight. Passages whose words can't reach the threshold even
with the largest weights of whole lists are skipped; for the others the largest weights of the blocks that their
words occur in are summed, for many passages at once, and blocks that can't reach it are skipped. In the blocks left,
WAND moves cursors over the posting lists from pivot to pivot. What is retrieved is verified by word shingles: shares
of the question's and of the answer's shingles that the passage holds.

The index is bounded: items are taken ``shard_items`` at a time, and each shard is one pass over the documents. What
depends on other items (document frequencies, the number, mean and greatest length of the items) is counted over the
whole benchmark first, so scores and passages don't depend on which items share a shard.

Defined results: an item's answer is its last sentence, its question what is before (an item of one sentence is cut
in half); null or wordless items and items of one word, which have no question, match nothing; null or wordless
documents match nothing; repeated documents give repeated rows, repeated items are each found; a null document id is
kept; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, discard, id_and_text, id_type, ship, stored

_BLOCK = 4  # items
_WORDS_AT_ONCE = 200_000  # of documents searched together
_CELLS = 1_000_000  # bounds of blocks held at once
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_words = re.compile(r"\w+").findall


def shingles(ids: list, size: int = 5) -> set[tuple]:
    return {tuple(ids[i : i + size]) for i in range(max(1, len(ids) - size + 1))} if ids else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in (_words(s.lower()) for s in _SENTENCE.split(text)) if w]
    question, answer = [w for p in parts[:-1] for w in p], parts[-1] if parts else []
    if not question:
        question, answer = answer[: len(answer) // 2], answer[len(answer) // 2 :]
    return question, answer


@dataclass
class Totals:
    """Of all items of a benchmark that have words: their number, the sum and the greatest of their lengths, and how
    many hold each word. An index needs ``df`` for the words of its own items only."""

    items: int
    words: int
    longest: int
    df: dict[str, int]


def item_words(text: str | None) -> list[str]:
    question, answer = question_and_answer(text or "")
    return question + answer


class ItemIndex:
    """BM25 inverted index of test items with block maxima. ``items``: (item_id, text) pairs; ``totals``: of the whole
    benchmark, by default of these items."""

    def __init__(self, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, totals: Totals | None = None):
        parts = [(i, *question_and_answer(text)) for i, text in items if text and _words(text)]
        tokens = [q + a for _, q, a in parts]
        if totals is None:
            totals = Totals(len(tokens), sum(map(len, tokens)), max(map(len, tokens), default=0), Counter(w for t in tokens for w in set(t)))
        self.items = [i for i, _, _ in parts]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.longest = totals.longest
        number = self.vocabulary.__getitem__
        self.parts = [(shingles(list(map(number, q))), shingles(list(map(number, a)))) for _, q, a in parts]
        counts = [{} for _ in tokens]
        df = np.array([totals.df[w] for w in self.vocabulary], float)
        for own, t in zip(counts, tokens):
            for w in map(number, t):
                own[w] = own.get(w, 0) + 1
        idf = np.log1p((totals.items - df + 0.5) / (df + 0.5))
        mean = totals.words / max(1, totals.items)
        rows = []  # (word, item, weight)
        for item, (own, t) in enumerate(zip(counts, tokens)):
            weight = {w: float(idf[w]) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(t) / mean)) for w, n in own.items()}
            full = math.fsum(weight.values())
            rows += [(w, item, x / full) for w, x in weight.items()]
        rows.sort()
        word, self.item, self.weight = (np.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 3, (np.int64, np.int64, np.float64)))
        self.blocks = -(-len(tokens) // _BLOCK)
        starts = np.flatnonzero(np.diff(word * (self.blocks + 1) + self.item // _BLOCK, prepend=-1))
        #: Of the blocks of all lists, in the lists' order: number, largest weight, first posting.
        self.block, self.largest = self.item[starts] // _BLOCK, np.maximum.reduceat(self.weight, starts) if len(starts) else self.weight
        self.first = np.append(starts, len(rows))
        self.list = np.searchsorted(word[starts], np.arange(len(self.vocabulary) + 1))  # of each word: its first block
        self.most = np.maximum.reduceat(self.largest, self.list[:-1]) if len(starts) else self.weight

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of the block's items that score at least ``threshold`` for the set of terms."""
        cursors = []  # [item at the cursor, largest weight in the block, place, end]
        for w in terms:
            at = self.list[w] + np.searchsorted(self.block[self.list[w] : self.list[w + 1]], block)
            if at < self.list[w + 1] and self.block[at] == block:
                place = int(self.first[at])
                cursors.append([int(self.item[place]), float(self.largest[at]), place, int(self.first[at + 1])])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[1]
                if bound >= threshold - 1e-6:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            target = pivot
            if cursors[0][0] == pivot:
                score = math.fsum(float(self.weight[c[2]]) for c in cursors if c[0] == pivot)
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
                target += 1
            for c in cursors:
                while c[2] < c[3] and self.item[c[2]] < target:
                    c[2] += 1
                c[0] = int(self.item[c[2]]) if c[2] < c[3] else None
            cursors = [c for c in cursors if c[0] is not None]
        return found

    def candidates(self, passage: np.ndarray, word: np.ndarray, threshold: float):
        """(first, end, block): ranges of the (passage, word) rows, sorted, of passages, and blocks that may hold an
        item that scores ``threshold``."""
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(starts[1:], len(passage))
        kept = np.add.reduceat(self.most[word], starts) >= threshold - 1e-6
        starts, ends = starts[kept], ends[kept]
        step = max(1, _CELLS // max(1, self.blocks))
        for at in range(0, len(starts), step):
            first, end = starts[at : at + step], ends[at : at + step]
            row, place = _spread(end - first)
            w = word[first[row] + place]
            entry, nth = _spread(self.list[w + 1] - self.list[w])
            b = self.list[w][entry] + nth
            bound = np.bincount(row[entry] * self.blocks + self.block[b], self.largest[b], len(first) * self.blocks)
            for cell in np.flatnonzero(bound >= threshold - 1e-6).tolist():
                yield int(first[cell // self.blocks]), int(end[cell // self.blocks]), cell % self.blocks

    def search(self, texts: list[str], threshold: float, overlap: float) -> list[dict[int, tuple[float, float, float]]]:
        """For each text: item -> (best score, question overlap, answer overlap) of what its passages retrieve and verification keeps."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        none, get = len(self.vocabulary), self.vocabulary.get
        if not none:
            return out
        half = self.longest  # a passage is two halves; passages start a half apart
        ids, halves, base, owners = [], [], 0, []  # halves are numbered through all texts
        for i, text in enumerate(texts):
            found = _words(text.lower())
            if not found:
                continue
            own = np.fromiter(map(get, found, repeat(none)), np.int64, len(found))
            n = -(-len(own) // half)
            at = np.flatnonzero(own < none)
            h = at // half
            key = np.unique(h * none + own[at])  # different words of each half
            h, word = np.divmod(key, none)
            both = np.concatenate([key[(h < n - 1) | (n == 1)], key[h > 0] - none])  # half h is in the passages h and h - 1
            halves.append(np.unique(both) + base * none)
            owners.append((base, i, len(ids)))
            ids.append(own)
            base += n
        if not halves:
            return out
        passage, word = np.divmod(np.concatenate(halves), none)
        if not len(passage):
            return out
        bases = [b for b, _, _ in owners]
        for first, end, block in self.candidates(passage, word, threshold):
            b, text, own = owners[bisect_right(bases, int(passage[first])) - 1]
            start = (int(passage[first]) - b) * half
            for item, score in self.wand(word[first:end].tolist(), block, threshold):
                if out[text].get(item, (0.0,))[0] >= score:
                    continue
                inside = ids[own][start : start + 2 * half].tolist()
                shares = [self._share(part, inside) for part in self.parts[item]]
                if min(shares) >= overlap:
                    out[text][item] = (score, *shares)
        return out

    @staticmethod
    def _share(part: set[tuple], inside: list[int]) -> float:
        """Of the part's shingles; a part shorter than a shingle is one itself."""
        return len(part & shingles(inside, len(next(iter(part))))) / len(part) if part else 0.0


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these sizes in a row: each member's range, and its place there."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _counted(batches):
    for b in batches:
        found = [item_words(text.as_py()) for text in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, found), pa.int64()), pa.array(map(lambda t: list(set(t)), found), pa.list_(pa.string()))], ["doc_id", "text", "n", "words"])


def _shards(items: DataFrame, size: int):
    """Lists of (item_id, text) with the totals over all items; the words' counts come for one shard at a time."""
    counted = stored(items.mapInArrow(_counted, "doc_id bigint, text string, n bigint, words array<string>").filter("n > 0"))
    number, words, longest = counted.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    if not number:
        return
    df = stored(counted.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")))
    rows = counted.select("doc_id", "text", "words").toLocalIterator()
    while shard := list(islice(rows, size)):
        own = {w for r in shard for w in r["words"]}
        if number <= size:
            found = df
        else:
            found = df.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in own], "w string")), "w")
        yield [(r["doc_id"], r["text"]) for r in shard], Totals(number, words, longest, {r["w"]: r["df"] for r in found.toLocalIterator()})
    discard(df)


_HITS = "item_id: bigint, score: double, question_overlap: double, answer_overlap: double"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = 0.6, overlap: float = 0.8, shard_items: int = 16_384) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every item that a document holds."""
    rows, parts = id_and_text(docs, id_col, text_col), []
    for held, only in _searches(docs, benchmark, item_col, threshold, overlap, shard_items):
        found = rows.select("doc_id", F.explode(held("text")).alias("hit")).select("doc_id", "hit.*")
        parts.append(found if only else stored(found))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], f"doc_id: {id_type(rows)}, {_HITS}")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", threshold: float = 0.6, overlap: float = 0.8, shard_items: int = 16_384) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item. No row shuffles."""
    for held, only in _searches(docs, benchmark, item_col, threshold, overlap, shard_items):
        docs = docs.filter(F.size(held(F.col(text_col))) == 0)
        docs = docs if only else stored(docs)
    return docs


def _searches(docs: DataFrame, benchmark: DataFrame, item_col: str, threshold: float, overlap: float, shard_items: int):
    """For each shard of items a function from texts to what they hold; of several shards one is held at a time."""
    spark = docs.sparkSession
    ship(spark)
    items = id_and_text(benchmark, item_col, "text").select(F.col("doc_id").cast("bigint"), "text")
    for shard, totals in _shards(items, shard_items):
        index = spark.sparkContext.broadcast(ItemIndex(shard, totals=totals))
        only = totals.items <= shard_items
        yield F.arrow_udf(_search(index, threshold, overlap), f"array<struct<{_HITS}>>"), only
        if not only:
            index.destroy()


def _search(index, threshold: float, overlap: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone()
        for column in columns:
            out, texts, size = [], [], 0
            for i, text in enumerate(column):
                texts.append(text.as_py() or "")
                size += len(texts[-1]) // 5
                if size >= _WORDS_AT_ONCE or i == len(column) - 1:
                    for found in index.value.search(texts, threshold, overlap):
                        out.append([dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), (index.value.items[item], *values))) for item, values in found.items()])
                    texts, size = [], 0
            yield pa.array(out, kind)

    return run
