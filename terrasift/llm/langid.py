"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all its segmentations into pieces, of the product of their probabilities; a forward pass over the word's letters
takes that sum without listing segmentations. Piece probabilities come from expectation-maximisation: forward-backward
passes over the distinct words of a bounded sample of labelled texts, expected counts summed in Spark.

Defined results: null texts and texts without a letter are ``und`` with score 0; case is ignored; a run of more than
MAX_WORD letters counts as consecutive words; where nothing can be learned (no labelled row) every text is ``und``;
ties go to the language first in alphabetical order; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, discard, id_and_text, ship, stored

MAX_WORD = 48
_KNOWN = 50_000  # words that a task keeps
_AT_ONCE = 100_000  # words scored together
_FLOOR = 1e-9  # of a character that is no piece
_letters = regex.compile(r"\p{L}+").findall


def public_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, in lower case. A leading ``▁`` marks the start of a word."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p.removeprefix("▁").isalpha() or p == "▁")


def words(text: str) -> list[str]:
    found = _letters(text.lower())
    if max(map(len, found), default=0) > MAX_WORD:
        found = [w[i : i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]
    return found


class PieceTable(dict):
    """Piece -> row, with a table of the pieces' 64-bit hashes in which many are looked up at once."""

    _BASE, _SPREAD, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), 19

    def __init__(self, pieces: dict[str, int]):
        super().__init__(pieces)
        self.bits = max(self._BITS, 3 + len(self).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.hashes, self.probes = np.zeros(max(self.values(), default=0) + 1, np.uint64), 1
        for piece, row in self.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = h * self._BASE + np.uint64(ord(c))
            at = int(self._slot(h)[0])
            first = at
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.hashes[row] = row, h[0]
            self.probes = max(self.probes, at - first + 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * self._SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, h: np.ndarray, missing: int) -> np.ndarray:
        slot, out = self._slot(h), np.full(len(h), missing)
        for _ in range(self.probes):
            row = self.slots[slot]
            hit = (row >= 0) & (self.hashes[row] == h)
            out[hit] = row[hit]
            slot = slot + 1
        return out

    def of_spans(self, letters: np.ndarray, longest: int, last: int) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> the row of that span of each word; ``letters``: words of one length, a column to a letter."""
        n, out = len(letters), {}
        for start in range(n):
            h = np.zeros(letters.shape[1], np.uint64)
            for end in range(start + 1, min(n, start + longest) + 1):
                h = h * self._BASE + letters[end - 1]
                out[start, end] = self.rows(h, last - 1 if end - start == 1 else last)
        return out


def passes(words_: list[str], pieces: dict[str, int], longest: int, last: int):
    """Words of one length go through the letters together: (which words, spans, the row of each word's each span).

    A span is (start, end) in the word after its mark; ``last`` - 1 stands for a lone character that is no piece, ``last``
    for what is none at all.
    """
    pieces = pieces if isinstance(pieces, PieceTable) else PieceTable(pieces)
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words_):
        by_length.setdefault(len(word) + 1, []).append(i)
    for n, members in by_length.items():
        spans = [(start, end) for end in range(1, n + 1) for start in range(max(0, end - longest), end)]
        step = max(1, 400_000 // len(spans))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            letters = np.frombuffer("".join("▁" + words_[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).T.astype(np.uint64)
            rows = pieces.of_spans(letters, longest, last)
            yield part, n, spans, np.stack([rows[s] for s in spans]).T


def word_scores(words_: list[str], pieces: dict[str, int], chances: np.ndarray, longest: int) -> np.ndarray:
    """Log probability of each word in each language.

    ``pieces`` gives a piece's row in ``chances``, whose last two rows are those of a lone character that is no piece
    and of what is none at all. Words of one length pass through the letters together.
    """
    out = np.empty((len(words_), chances.shape[1]))
    for part, n, spans, rows in passes(words_, pieces, longest, len(chances) - 1):
        alpha = np.zeros((n + 1, len(part), chances.shape[1]))
        alpha[0] = 1
        for k, (start, end) in enumerate(spans):
            alpha[end] += alpha[start] * chances[rows[:, k]]
        out[part] = np.log(np.maximum(alpha[n], 1e-300))
    return out


def table_of(pieces: dict[str, tuple[float, ...]]) -> tuple[dict[str, int], np.ndarray]:
    """Each piece's row, and the rows, with the two that stand for no piece at the end."""
    chances = np.array([*pieces.values()])
    return PieceTable({p: i for i, p in enumerate(pieces)}), np.vstack([chances, np.full_like(chances[:1], _FLOOR), np.zeros_like(chances[:1])])


def expected_counts(words_: list[str], n: np.ndarray, pieces: dict[str, int], chance: np.ndarray, longest: int) -> np.ndarray:
    """Expected uses of each row of ``chance``, one language's probabilities, when each word is seen ``n`` times."""
    counts = np.zeros(len(chance))
    for part, size, spans, rows in passes(words_, pieces, longest, len(chance) - 1):
        p = chance[rows]
        alpha, beta = np.zeros((2, size + 1, len(part)))
        alpha[0] = beta[size] = 1
        for k, (start, end) in enumerate(spans):
            alpha[end] += alpha[start] * p[:, k]
        for k in sorted(range(len(spans)), key=lambda k: -spans[k][0]):
            start, end = spans[k]
            beta[start] += p[:, k] * beta[end]
        starts, ends = zip(*spans)
        used = alpha[list(starts)] * p.T * beta[list(ends)] * (n[part] / np.maximum(alpha[size], 1e-300))
        counts += np.bincount(rows.T.ravel(), used.ravel(), len(counts))
    return counts


def _expected(table, longest: int, languages: list[str]):
    """E step: expected count of each piece by language over (lang, word, n) rows."""

    def run(batches):
        pieces, chances = table_of(table.value)
        names = [*table.value]
        for b in batches:
            lang, word, n = (b.column(i).to_pylist() for i in range(3))
            for k, name in enumerate(languages):
                mine = [i for i, x in enumerate(lang) if x == name]
                if mine:
                    counts = expected_counts([word[i] for i in mine], np.array([n[i] for i in mine]), pieces, chances[:, k], longest)[: len(names)]
                    used = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array([names[i] for i in used]), pa.array(counts[used])], ["k", "piece", "n"])

    return run


class LanguageModel:
    """``pieces``: piece -> its probability in each of ``languages``."""

    def __init__(self, languages: list[str], pieces: dict[str, tuple[float, ...]]):
        self.languages, self.pieces = languages, pieces
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def fit(cls, labelled: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_language: int = 500, rounds: int = 3, smoothing: float = 0.05) -> LanguageModel:
        """Learns from about ``texts_per_language`` texts of each language, the rows (id and text) that hash lowest.

        Of fewer different rows than that, all teach. A row is taken or left by its own hash and its language's number
        of rows alone, so no language is lost, none is sorted, and rows whose ids are null or repeat count like any
        other; equal rows teach once. The sample of a language passes its bound only by chance (a few times its root).
        """
        spark = labelled.sparkSession
        ship(spark)
        rows = labelled.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
        share = (texts_per_language / F.approx_count_distinct("row", 0.02)).alias("share")
        sizes = stored(rows.groupBy("lang").agg(share).select(F.col("lang").alias("of"), "share"))
        sample = rows.join(sizes, F.col("lang") == F.col("of")).filter(F.col("share") > F.col("row") / 2.0**64 + 0.5).dropDuplicates(["lang", "row"])
        split = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{MAX_WORD}}}"), 0))
        counted = sample.select("lang", split.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).cast("double").alias("n"))
        # words are few bytes but much work: left alone, Spark would put them into one task
        counted = stored(counted.repartition(max(8, spark.sparkContext.defaultParallelism)))
        languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
        start = {p: (1 / max(1, len(vocabulary)),) * len(languages) for p in vocabulary}
        model = cls(languages, start)
        for _ in range(rounds if languages else 0):
            table = spark.sparkContext.broadcast(model.pieces)
            counts = counted.select("lang", "word", "n").mapInArrow(_expected(table, model.longest, languages), "k int, piece string, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
            sums = {(r["k"], r["piece"]): r["n"] for r in counts.collect()}  # bounded by the vocabulary times the languages
            totals = [sum(v for (j, _), v in sums.items() if j == k) + smoothing * len(vocabulary) for k in range(len(languages))]
            model = cls(languages, {p: tuple((sums.get((k, p), 0.0) + smoothing) / totals[k] for k in range(len(languages))) for p in vocabulary})
        discard(counted)
        return model

    def of(self, text: Column | str) -> Column:
        """A struct of lang_pred and score, the posterior probability of lang_pred under equal priors."""
        sc = SparkContext.getOrCreate()
        shared = sc.broadcast((uuid.uuid4().hex, self.languages, self.pieces, self.longest))
        return F.arrow_udf(_predict(shared), "lang_pred string, score double")(text)

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, lang_pred, score."""
        ship(docs.sparkSession)
        rows = id_and_text(docs, id_col, text_col)
        return rows.select("doc_id", self.of("text").alias("p")).select("doc_id", "p.*")


class _Scores:
    """Scores of the words a worker met, in two tables of bounded size: when the younger is full it becomes the older
    one, and the older one goes."""

    def __init__(self, pieces, longest):
        self.pieces, self.chances = table_of(pieces)
        self.longest = longest
        self.young, self.old = ({}, np.zeros((0, self.chances.shape[1]))), ({}, np.zeros((0, self.chances.shape[1])))

    def of(self, found: list[str]) -> np.ndarray:
        if len(self.young[0]) > _KNOWN:
            self.young, self.old = ({}, self.old[1][:0]), self.young
        at, rows = self.young
        fresh = sorted(set(found) - at.keys())
        if fresh:
            before = self.old[0]
            met, new = [w for w in fresh if w in before], [w for w in fresh if w not in before]
            n = len(at)
            if n + len(fresh) > len(rows):
                rows = np.concatenate([rows, np.empty((n + len(fresh), rows.shape[1]))])
            rows[n : n + len(met)] = self.old[1][[before[w] for w in met]]
            rows[n + len(met) : n + len(fresh)] = word_scores(new, self.pieces, self.chances, self.longest)
            at |= zip(met + new, range(n, n + len(fresh)))
            self.young = at, rows
        return rows[np.fromiter(map(at.__getitem__, found), np.int64, len(found))]


_scores: dict[str, _Scores] = {}


def _known(name: str, pieces, longest: int) -> _Scores:
    """The last model's scores, for each worker process, whatever number of tasks it runs."""
    alone(_scores)
    if name not in _scores:
        _scores.clear()
        _scores[name] = _Scores(pieces, longest)
    return _scores[name]


def _predict(shared):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        name, languages, pieces, longest = shared.value
        known = _known(name, pieces, longest) if languages else None
        for column in texts:
            totals, waiting, sizes = [], [], []
            for text in column:
                found = words(text.as_py() or "") if languages else []
                waiting += found
                sizes.append(len(found))
                if len(waiting) >= _AT_ONCE:
                    totals.append(_sums(known, waiting, sizes))
                    waiting, sizes = [], []
            totals.append(_sums(known, waiting, sizes))
            score, empty = (np.concatenate(x) for x in zip(*totals))
            best = score.argmax(axis=1) if languages else np.zeros(len(empty), int)
            chance = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1) if languages else np.zeros(len(empty))
            names = ["und" if e else languages[k] for e, k in zip(empty.tolist(), best.tolist())]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(empty, 0.0, chance))], ["lang_pred", "score"])

    return run


def _sums(known, found: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Summed scores of texts whose words stand one after another, and which texts have none."""
    sizes = np.array(sizes, np.int64)
    out = np.zeros((len(sizes), known.chances.shape[1] if known else 0))
    if found:
        full = np.flatnonzero(sizes)
        out[full] = np.add.reduceat(known.of(found), (np.cumsum(sizes) - sizes)[full], axis=0)
    return out, sizes == 0
