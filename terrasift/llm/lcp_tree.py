"""Suffix-array dedup by the common-prefix interval tree.

Segments of one anchor gram (see ``repeats``) are aligned at the anchor. Their suffixes from there form a sorted suffix
array with the lengths of common prefixes; a scan with a stack walks its interval tree bottom up. An interval of common
length r holds all occurrences of an r-byte string, its children those of longer ones. They are ordered by what
precedes them: neighbours that share l bytes to the left repeat l + r bytes. A run of neighbours with at least l, and
somewhere no more (left diverse), from different children (right diverse), is a maximal repeat with all its
occurrences. Every window of WINDOW bytes inside such a repeat goes.

Defined results: null texts are empty; texts shorter than a window lose nothing; repeats within one text count, as do
rows that repeat an id; bytes go even if that splits a character; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .repeats import common

WINDOW, GRAM = 200, 64
KIND = repeats.Kind(words=False, length=WINDOW, gram=GRAM)


class _Least:
    """Least of ``values`` over ranges, from tables of powers of two."""

    def __init__(self, values: list[int]):
        self.tables = [np.array(values, np.int64)]
        while 2 ** len(self.tables) <= len(values):
            t, step = self.tables[-1], 2 ** (len(self.tables) - 1)
            self.tables.append(np.minimum(t[:-step], t[step:]))

    def over(self, first: int, end: int) -> int:
        level = (end - first).bit_length() - 1
        t = self.tables[level]
        return int(min(t[first], t[end - (1 << level)]))


def maximal_repeats(before: list[bytes], after: list[bytes], shortest: int) -> Iterator[tuple[int, int, list[int]]]:
    """(l, r, occurrences) of the repeats of at least ``shortest`` bytes around the places before which ``before`` stands,
    reversed, and at which ``after`` starts."""
    array = sorted(range(len(after)), key=after.__getitem__)
    left = sorted(range(len(before)), key=before.__getitem__)
    rank = [0] * len(left)
    for i, x in enumerate(left):
        rank[x] = i
    least = _Least([0, *(common(before[a], before[b]) for a, b in pairwise(left))])
    open_: list[tuple[int, list[list[int]]]] = []  # intervals by depth, with their closed children as sorted ranks
    depths = [common(after[a], after[b]) for a, b in pairwise(array)]
    for x, depth in zip(array, [*depths, -1]):
        inside = [rank[x]]
        while open_ and open_[-1][0] > depth:
            r, children = open_.pop()
            children.append(inside)
            inside = sorted(i for c in children for i in c)
            yield from ((l, r, [left[i] for i in run]) for l, run in _diverse(children, inside, least, shortest - r))
        if open_ and open_[-1][0] == depth:
            open_[-1][1].append(inside)
        elif depth >= 0:
            open_.append((depth, [inside]))


def _diverse(children: list[list[int]], inside: list[int], least: _Least, shortest: int) -> Iterator[tuple[int, list[int]]]:
    """(l, run): runs of an interval's occurrences, ``inside`` in the order of what precedes them, that share l bytes
    to the left, at least ``shortest`` and no more, and are of more than one child."""
    child = {i: k for k, c in enumerate(children) for i in c}
    shares = [least.over(a + 1, b + 1) for a, b in pairwise(inside)]
    change = [0]  # of child, up to each occurrence
    for a, b in pairwise(inside):
        change.append(change[-1] + (child[a] != child[b]))
    runs: list[tuple[int, int]] = []  # shared length, first occurrence
    for i, share in enumerate([*shares, -1]):
        first = i
        while runs and runs[-1][0] > share:
            l, first = runs.pop()
            if l >= shortest and change[first] != change[i]:
                yield l, inside[first : i + 1]
        if not runs or runs[-1][0] < share:
            runs.append((share, first))


def judge(rows: list[tuple]) -> pa.RecordBatch:
    told = []
    for gram, group in groupby(rows, key=lambda r: r[0]):
        group = list(group)
        ranges: list[list[tuple[int, int]]] = [[(0, r[4] + 1)] if r[2] > 1 else [] for r in group]
        if len(group) > 1:
            before = [r[6][: r[5]][::-1] for r in group]
            after = [r[6][r[5] :] for r in group]
            for l, r, inside in maximal_repeats(before, after, WINDOW):  # noqa: E741
                for x in inside:
                    place = group[x][5]
                    ranges[x].append((place - l, place - (WINDOW - r) + 1))
        for r, found in zip(group, ranges):
            if runs := merged(found):
                told.append((gram, r[1], [(a, b - a, -1) for a, b in runs]))
    return repeats.verdict(told)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept: bytes; every byte in a WINDOW-byte string that occurs twice goes."""
    return repeats.cleaned(repeats.repeats(docs, KIND, judge, False, id_col, text_col, **sizes), KIND)
