"""Byte-level BPE encoding and decoding against a public rank file.

Each match of the pre-split pattern is encoded by itself. A segment tree over the piece's byte positions holds, at the
start of every live token, the rank of the pair it forms with its right neighbour; its root is the leftmost pair of
least rank. A merge updates three leaves, each in logarithmic time, so a piece without any break of n bytes costs
n log n. Short pieces are encoded many at a time: their trees are the rows of one array and their merges go in step.
Pieces recur, so every Python worker keeps the ids of those it met in two tables of bounded bytes: when the younger is
full it becomes the older one, and the older one goes.

Defined results: null texts count as empty and encode to no ids; ids unknown to the vocabulary can't be decoded and
raise; null ids decode to null; repeated rows give repeated rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import alone, id_and_text, id_type, ship, sized

_NONE = 1 << 62
_SHORT = 64  # bytes of a piece that is encoded with others
_KNOWN_BYTES = 24 << 20  # of each of a worker's two tables
_FLUSH = 250_000  # ids in a batch of output


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        if (r := rank(piece[i : i + 2])) is not None:
            tree[size + i] = r * n + i
    for x in range(size - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])

    def put(i: int, value: int) -> None:
        x = size + i
        tree[x] = value
        while x > 1:
            least = min(tree[x], tree[x ^ 1])
            x >>= 1
            if tree[x] == least:
                return
            tree[x] = least

    after, before = list(range(1, n + 1)), list(range(-1, n))  # where the next and the previous token start
    while (best := tree[1]) < _NONE:
        i = best % n
        j = after[i]
        k = after[j]
        after[i] = k
        put(j, _NONE)
        r = None
        if k < n:
            before[k] = i
            r = rank(piece[i : after[k]])
        put(i, _NONE if r is None else r * n + i)
        if (h := before[i]) >= 0:
            r = rank(piece[h:k])
            put(h, _NONE if r is None else r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pairs:
    """For two neighbouring tokens the rank of what they form: a sorted array, a row for each split of a token in two."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values(), default=0) + 1
        found = {ranks[t[:i]] * self.width + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(self.keys)
        self.keys = np.append(self.keys[order], _NONE)
        self.values = np.append(np.fromiter(found.values(), np.int64, len(found))[order], -1)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; -1 where the two form no token."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)


def encode_together(pieces: list[bytes], size: int, bytes_: np.ndarray, pairs: Pairs) -> list[bytes]:
    """The ids, as bytes of int32, of pieces of at most ``size`` bytes, a power of two; ``bytes_`` gives the token of each byte."""
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = bytes_[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)].reshape(-1, size)
    rows, at = np.arange(len(pieces)), np.arange(size)
    token = np.where(at < n[:, None], flat, -1)
    after = np.tile(np.minimum(at + 1, size), (len(pieces), 1))
    before = np.tile(at - 1, (len(pieces), 1))
    tree = np.full((len(pieces), 2 * size), _NONE)
    inner = at[:-1] < n[:, None] - 1
    rank = np.full(inner.shape, -1)
    rank[inner] = pairs.of(token[:, :-1][inner], token[:, 1:][inner])
    tree[:, size : 2 * size - 1] = np.where(rank >= 0, rank * size + at[:-1], _NONE)
    for level in range(size.bit_length() - 2, -1, -1):
        x = np.arange(1 << level, 2 << level)
        tree[:, x] = np.minimum(tree[:, 2 * x], tree[:, 2 * x + 1])

    def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        x = size + i
        tree[rows, x] = value
        while size > 1 and x[0] > 1:  # all leaves are equally deep
            least = np.minimum(tree[rows, x], tree[rows, x ^ 1])
            x = x >> 1
            tree[rows, x] = least

    def pair(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        found = pairs.of(token[rows, i], token[rows, j])
        return np.where(found >= 0, found * size + i, _NONE)

    live = rows
    while len(live := live[tree[live, 1] < _NONE]):
        best = tree[live, 1]
        i = best % size
        j = after[live, i]
        k = after[live, j]
        token[live, i], token[live, j] = best // size, -1
        after[live, i] = k
        put(live, j, np.full(len(live), _NONE))
        put(live, i, np.full(len(live), _NONE))
        right = k < n[live]
        if right.any():
            r, own = live[right], i[right]
            before[r, k[right]] = own
            put(r, own, pair(r, own, k[right]))
        h = before[live, i]
        left = h >= 0
        if left.any():
            r = live[left]
            put(r, h[left], pair(r, h[left], i[left]))
    kept = token >= 0
    ids, ends = token[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Vocabulary:
    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known_ids = frozenset(self.ranks.values())
        self.bytes_ = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)])
        self.pairs = Pairs(self.ranks)
        self.split = regex.compile(pattern).findall
        self.young, self.old, self.size = {}, {}, 0

    def learn(self, pieces: set[str]) -> None:
        """Puts pieces into the younger table, each with its ids as bytes."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        fresh: dict[str, bytes] = {}
        for piece in pieces:
            if (found := self.old.get(piece)) is not None:
                fresh[piece] = found
                continue
            data = piece.encode("utf-8")
            if (whole := self.ranks.get(data)) is not None:
                fresh[piece] = np.int32(whole).tobytes()
            elif len(data) > _SHORT:
                fresh[piece] = np.array(encode_piece(data, self.ranks), np.int32).tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for size, members in by_size.items():
            for at in range(0, len(members), 4096):
                part = members[at : at + 4096]
                fresh |= zip((p for p, _ in part), encode_together([d for _, d in part], size, self.bytes_, self.pairs))
        self.size += sum(200 + 2 * len(p) + len(i) for p, i in fresh.items())  # about what an entry takes
        self.young |= fresh

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.split(t) for t in texts]
        different = set(chain.from_iterable(pieces))
        if self.size > _KNOWN_BYTES:
            self.young, self.old, self.size = {}, self.young, 0
        self.learn(different - self.young.keys())
        get = self.young.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def known(self, ids: np.ndarray) -> bool:
        return self.known_ids.issuperset(np.unique(ids).tolist())


_vocabularies: dict[tuple[int, str], Vocabulary] = {}


def vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    """One for each worker process, whatever number of tasks it runs."""
    alone(_vocabularies)
    key = hash(lines), pattern
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(lines, pattern)
    return _vocabularies[key]


def _id_lists(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))


class Codec:
    """``path``: a rank file, a token in base64 and its rank to a line, read on the driver and broadcast (its size is the vocabulary's)."""

    def __init__(self, spark, path: str, pattern: str):
        ship(spark)
        with open(path, "rb") as f:
            self.lines, self.pattern = spark.sparkContext.broadcast(f.read()), pattern

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
        """doc_id, ids and, with ``decode``, data: the bytes that the ids stand for, so that one worker does both."""
        lines, pattern = self.lines, self.pattern

        def out(ids: pa.Array, found: list[np.ndarray], known: Vocabulary) -> pa.RecordBatch:
            columns = [ids, _id_lists(found)]
            if decode:
                columns.append(pa.array([known.decode(x.tolist()) for x in found], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "data"][: len(columns)])

        def run(batches):
            known = vocabulary(lines.value, pattern)
            for b in sized(batches):
                start, total, found = 0, 0, known.encode([t or "" for t in b.column(1).to_pylist()])
                for i, ids in enumerate(found):
                    total += len(ids)
                    if total >= _FLUSH or i == len(found) - 1:
                        yield out(b.column(0).slice(start, i + 1 - start), found[start : i + 1], known)
                        start, total = i + 1, 0

        rows = id_and_text(docs, id_col, text_col)
        return rows.mapInArrow(run, f"doc_id {id_type(rows)}, ids array<int>" + (", data binary" if decode else ""))

    def decode(self, encoded: DataFrame) -> DataFrame:
        """doc_id, ids, data."""
        lines, pattern = self.lines, self.pattern

        def run(batches):
            known = vocabulary(lines.value, pattern)
            for b in sized(batches):
                if not known.known(b.column(1).flatten().to_numpy(zero_copy_only=False)):
                    raise KeyError("ids that the vocabulary does not have")
                data = [None if ids is None else known.decode(ids) for ids in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

        kept = encoded.select("doc_id", "ids")
        return kept.mapInArrow(run, f"doc_id {id_type(kept)}, ids array<int>, data binary")
