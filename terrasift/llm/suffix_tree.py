"""Substring dedup by prefix-partitioned suffix trees over words.

``repeats`` deals the suffixes: each starts at the anchor of some windows, and suffixes that start with the same words
form a part. Those words are a prefix of variable length: GRAM words at first, and more, up to the whole window, while
a part has too many members for the memory of a task. A part is one subtree. Its leaves, the suffixes, are sorted and
linked into internal nodes by the words that neighbours share; what stands before the anchors forms a second, small
tree, read backwards. A window with p words before its anchor is an edge at depth WINDOW - p of the suffix tree
together with one at depth p of the other, so leaves below the same two edges hold the same window; an internal node
of r words whose leaves differ in what follows and, l words back, in what precedes, is a maximal repeat of l + r words.

Defined results: null texts have no words; texts of fewer words than a window lose nothing; a window that repeats only
within its own document, or among rows of one id, stays; rows with a null id come after all others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

WINDOW, GRAM = 50, 16
KIND = repeats.Kind(words=True, length=WINDOW, gram=GRAM)
_NOT, _ONCE = np.iinfo(np.int64).min, np.iinfo(np.int64).min + 1


class Tree:
    """The suffixes, sequences of ``width``-byte symbols, as sorted leaves; ``shared[i]`` symbols lead to leaf i and the one before."""

    def __init__(self, suffixes: list[bytes], width: int = 4):
        self.order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        self.shared = np.zeros(len(suffixes), np.int64)
        for i, (a, b) in enumerate(pairwise(self.order), 1):
            self.shared[i] = repeats.common(suffixes[a], suffixes[b]) // width
        self.leaf = np.empty(len(suffixes), np.int64)  # of each suffix
        self.leaf[self.order] = np.arange(len(suffixes))

    def nodes(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """(depth, first leaf, leaf after the last, first leaves of its children) of the internal nodes, children first."""
        path: list[tuple[int, list[int]]] = []
        for i, depth in enumerate([*self.shared[1:].tolist(), -1], 1):
            start = i - 1
            while path and path[-1][0] > depth:
                at, children = path.pop()
                children.append(start)
                yield at, children[0], i, children
                start = children[0]
            if path and path[-1][0] == depth:
                path[-1][1].append(start)
            elif depth >= 0:
                path.append((depth, [start]))

    def edges(self, depth: int) -> np.ndarray:
        """For each suffix the edge at ``depth`` that leads to it. Shorter suffixes share none."""
        return np.cumsum(self.shared < depth)[self.leaf]


def maximal_repeats(before: list[bytes], after: list[bytes], shortest: int, width: int = 4) -> Iterator[tuple[int, int, list[int]]]:
    """(l, r, suffixes) of the repeats of at least ``shortest`` symbols: ``after`` are suffixes, ``before`` what precedes
    each, backwards. They end where the suffixes differ and begin where what precedes them does."""
    tree, back = Tree(after, width), Tree(before, width)
    for r, first, end, children in tree.nodes():
        below = sorted(tree.order[first:end], key=back.leaf.__getitem__)
        child = np.searchsorted(children, tree.leaf[below], "right")
        steps = [int(back.shared[back.leaf[a] + 1 : back.leaf[b] + 1].min()) for a, b in pairwise(below)]
        for l in sorted({s for s in steps if s + r >= shortest}):  # noqa: E741
            cuts = [0, *(i for i, s in enumerate(steps, 1) if s < l), len(below)]
            for a, b in pairwise(cuts):
                if l in steps[a : b - 1] and len(set(child[a:b].tolist())) > 1:
                    yield l, r, below[a:b]


def judge(rows: list[tuple]) -> pa.RecordBatch:
    gram, own, n, least, extra, place, pieces = zip(*rows)
    n, least, extra, place = (np.array(x, np.int64) for x in (n, least, extra, place))
    sizes = extra + WINDOW
    symbols = np.unique(repeats.word_symbols(b"\n".join(pieces)), return_inverse=True)[1].astype(">u4")
    start = np.cumsum(sizes) - sizes
    after = Tree([symbols[a:b].tobytes() for a, b in zip((start + place).tolist(), (start + sizes).tolist())])
    before = Tree([symbols[a:b][::-1].tobytes() for a, b in zip(start.tolist(), (start + place).tolist())])
    value = np.full((len(rows), WINDOW), _NOT, np.int64)  # of each window: smallest id, or that it occurs once
    count = np.zeros_like(value)
    for p in range(int(place.max()) + 1):
        own_ = np.flatnonzero((place >= p) & (place - p <= extra))
        window = np.unique(after.edges(WINDOW - p)[own_] * (len(rows) + 1) + before.edges(p)[own_], return_inverse=True)[1]
        total, smallest = np.zeros(len(own_), np.int64), np.full(len(own_), np.iinfo(np.int64).max)
        np.add.at(total, window, n[own_])
        np.minimum.at(smallest, window, least[own_])
        value[own_, place[own_] - p], count[own_, place[own_] - p] = smallest[window], total[window]
    value[(count == 1) & (value != _NOT)] = _ONCE
    flat, repeated = value.ravel(), count.ravel() > 1
    first = np.flatnonzero(np.diff(flat, prepend=_NOT) != 0)
    first = np.union1d(first, np.arange(0, flat.size, WINDOW))
    runs = np.diff(np.append(first, flat.size))
    kept = repeated[first]
    told: dict[int, list] = {}
    for i, a, k, v in zip((first // WINDOW)[kept].tolist(), (first % WINDOW)[kept].tolist(), runs[kept].tolist(), flat[first][kept].tolist()):
        told.setdefault(i, []).append((a, k, v))
    return repeats.verdict([(gram[i], own[i], r) for i, r in told.items()])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept: words; windows of WINDOW words that start in a document of smaller id go."""
    return repeats.cleaned(repeats.repeats(docs, KIND, judge, True, id_col, text_col, **sizes), KIND)
