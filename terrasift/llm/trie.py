"""A trie of conversations' beginnings, in double arrays.

Turns are known by the MD5 of role and text, so texts don't move. Equal conversations are grouped first; each different
one goes to the shard of its beginning: its first turn or, where more than ``shard_turns`` turns share that, its first 2,
4, 8 ... turns, until a shard fits. A task numbers a shard's turns densely in the order in which it meets them and packs
the shard's trie into the arrays BASE and CHECK: the child of state s by turn c is BASE[s] + c, if CHECK there is s. It
then walks the conversations through the arrays and sums up. Nodes above a shard's beginning lie on one path and are
shared with other shards: a shard sends one summary of its path, from which the upper nodes' aggregates are merged.

Which conversations end in a node is told by the SHA-256 of their ids. Such a list can be long: ids meet in blocks of
BLOCK numbers, and one task streams a node's blocks, in order, through the hash.

Defined results: null role and text are empty; turns are ordered by their number, null first, equal numbers by the MD5
of role and text, and repeated turns all count; rows without a conversation id are left out; a conversation without
turns ends in the root; without conversations there is no root; other columns are ignored. A conversation is one
sequence: 24 bytes for each of its turns meet in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, ship, stored

SHARD_TURNS = 50_000
BLOCK = 4096  # numbers
_FREE = -1


class DoubleArray:
    """The trie of sorted, different sequences of symbols from 1 on. State 0 is the root; ``path`` gives the states
    after it. ``states`` lists them, a parent before its children."""

    def __init__(self, rows: list[list[int]]):
        self.base, self.check, self._after = [0], [0], {}
        self.states = [0]
        open_ = [(0, 0, len(rows), 0)] if rows else []
        while open_:
            state, low, high, depth = open_.pop()
            while low < high and len(rows[low]) == depth:
                low += 1  # ends here
            if low == high:
                continue
            cuts = [low, *(i for i in range(low + 1, high) if rows[i][depth] != rows[i - 1][depth]), high]
            symbols = [rows[i][depth] for i in cuts[:-1]]
            base = self._fit(symbols)
            self.base[state] = base
            for c, a, b in zip(symbols, cuts, cuts[1:]):
                child = base + c
                self.check[child] = state
                self.states.append(child)
                open_.append((child, a, b, depth + 1))

    def _fit(self, symbols: list[int]) -> int:
        """A base at which the slots of all symbols are free: the first after the one that the least symbol got before."""
        low, reach = symbols[0], symbols[-1] - symbols[0]
        at = self._after.get(low, low)
        while True:
            if at + reach >= len(self.check):
                grow = at + reach + 1 - len(self.check)
                self.check += [_FREE] * grow
                self.base += [0] * grow
            if all(self.check[at - low + c] == _FREE for c in symbols):
                self._after[low] = at + 1
                return at - low
            at += 1

    def path(self, row: list[int]) -> list[int]:
        out, s = [], 0
        for c in row:
            t = self.base[s] + c
            if not 0 < t < len(self.check) or self.check[t] != s:
                raise KeyError(c)
            out.append(t)
            s = t
        return out


def shard_nodes(rows: list[tuple[int, int, list[bytes], list[int], str]], top: int) -> Iterator[tuple]:
    """Nodes of a shard whose conversations share their first ``top`` turns, those at depth ``top`` and below.

    ``rows``: (least conv_id, conversations, turns, bytes of each, digest of the ids), all different. Yields (conv_id,
    depth, conv_id of the parent or None at depth top, n_convs, n_children, n_leaves, saved_tokens, digest or None).
    """
    numbers: dict[bytes, int] = {}
    coded = [[numbers.setdefault(k, len(numbers) + 1) for k in keys[top - 1 :]] for _, _, keys, _, _ in rows]
    order = sorted(range(len(rows)), key=coded.__getitem__)
    trie = DoubleArray([coded[i] for i in order])
    size = len(trie.check)
    least, n, children, leaves, saved, depth, last = ([0] * size for _ in range(7))
    ends: list[str | None] = [None] * size
    for i in order:
        conv, count, _, sizes, digest = rows[i]
        state = 0
        for d, (state, bytes_) in enumerate(zip(trie.path(coded[i]), sizes[top - 1 :]), top):
            least[state] = min(least[state], conv) if n[state] else conv
            n[state] += count
            depth[state], last[state] = d, bytes_
        ends[state] = digest
    below = trie.states[1:]
    for s in reversed(below):
        leaves[s] = leaves[s] or 1
        saved[s] += (n[s] - 1) * last[s]
        parent = trie.check[s]
        children[parent] += 1
        leaves[parent] += leaves[s]
        saved[parent] += saved[s]
    for s in below:
        parent = trie.check[s]
        yield least[s], depth[s], least[parent] if parent else None, n[s], children[s], leaves[s], saved[s], ends[s]


_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_TYPES = [pa.int64()] * 7 + [pa.string()]
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _shards(batches):
    """Rows (shard, depth of its beginning, conv_id, n, turns, ends), sorted by shard. Nodes come with ``shard``, null but at the top."""
    held, shard, top = [], None, 0

    def told():
        out = [(shard if x[2] is None else None, *x) for x in shard_nodes(held, top)]
        for at in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 20_000]), [pa.string(), *_TYPES])], ["shard", *_NAMES])

    for b in batches:
        for own, depth, conv, n, turns, ends in zip(*(c.to_pylist() for c in b.columns)):
            if own != shard:
                if held:
                    yield from told()
                held, shard, top = [], own, depth
            held.append((conv, n, [t["key"] for t in turns], [t["bytes"] for t in turns], ends))
    if held:
        yield from told()


def _digests(batches):
    """(seq, block, ids as text) rows, sorted, to the SHA-256 of each seq's ids joined by commas."""
    seq, state = None, None
    for b in batches:
        out = []
        for own, _, ids in zip(*(c.to_pylist() for c in b.columns)):
            if own != seq:
                if seq is not None:
                    out.append((seq, state.hexdigest()))
                seq, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["seq", "ends_sha256"])
    if seq is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as structs of key (of role and text) and bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col(id_col).cast("bigint").alias("conv_id"), F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).alias("bytes")).alias("t"))
    rows = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return rows.select("conv_id", F.transform("ts", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def shared_heads(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % family, then what c has beyond its own first h;
    h is CRC-32 of the id as decimal text, modulo ``most``. Families meet, at most 2 * family - 1 conversations each."""
    family_of = F.col("conv_id") - F.col("conv_id") % family
    kin = turns.withColumn("of", family_of).groupBy("of").agg(F.collect_list(F.struct("conv_id", "turns")).alias("kin"))
    first = F.filter("kin", lambda x: x["conv_id"] == F.col("of"))
    kin = kin.select(F.get(first, F.lit(0))["turns"].alias("head"), F.explode("kin").alias("x"))
    h = (F.crc32(F.col("x.conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast(turns.schema["turns"].dataType)), F.lit(1), h)
    own = F.slice("x.turns", h + 1, F.greatest(F.size("x.turns") - h, F.lit(0)))
    return kin.select("x.conv_id", F.concat(head, own).alias("turns"))


def _named(turns) -> F.Column:
    """One name for a sequence of turns."""
    return F.md5(F.encode(F.array_join(F.transform(turns, lambda t: F.hex(t["key"])), ""), "UTF-8"))


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node, of ``turns`` (conv_id, turns: key, bytes): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. conv_id, the least member, and depth name a node: its path is that
    conversation's first ``depth`` turns."""
    ship(turns.sparkSession)
    seqs = stored(turns.select("conv_id", "turns", _named("turns").alias("seq")))
    numbers = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = seqs.groupBy("seq", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(numbers.alias("ids"))
    digests = stored(blocks.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(_digests, "seq string, ends_sha256 string"))
    different = stored(seqs.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("turns").alias("turns")))
    todo, parts, depth = stored(different.join(digests, "seq").select("conv_id", "n", "turns", "ends_sha256")), [], 1
    discard(seqs, digests, different)
    while True:
        keyed = todo.withColumns({"shard": _named(F.slice("turns", 1, depth)), "top": F.lit(depth).cast("bigint")})
        sizes = keyed.groupBy("shard").agg(F.sum(F.size("turns")).alias("size"), F.max(F.size("turns")).alias("longest"))
        large = stored(sizes.filter((F.col("size") > shard_turns) & (F.col("longest") > depth)).select("shard"))
        if large.isEmpty():
            parts.append(keyed)
            break
        parts.append(keyed.join(large, "shard", "left_anti"))
        todo, depth = stored(keyed.join(large, "shard", "left_semi").drop("shard", "top")), 2 * depth
    dealt = stored(reduce(DataFrame.unionByName, parts).select("shard", "top", "conv_id", "n", "turns", "ends_sha256"))
    inside = dealt.filter(F.size("turns") >= F.col("top")).repartition("shard").sortWithinPartitions("shard")
    nodes = stored(inside.mapInArrow(_shards, f"shard string, {_NODE}"))
    return _merged(dealt, nodes)


def _merged(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """The shards' nodes together with those above them, which the conversations of several shards may share."""
    tops = nodes.filter("shard is not null").drop("parent_conv_id")
    keys = dealt.filter(F.size("turns") >= F.col("top")).groupBy("shard").agg(F.first(F.slice("turns", F.lit(1), F.col("top").cast("int"))).alias("turns"))
    above = tops.join(keys, "shard").select("shard", (F.col("depth") - 1).alias("last"), "turns", "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
    # a conversation that ends above its shard's beginning has nothing below
    nothing = F.lit(0).cast("bigint")
    short = dealt.filter(F.size("turns") < F.col("top")).select("shard", F.size("turns").cast("bigint").alias("last"), "turns", "conv_id", F.col("n").alias("n_convs"), nothing.alias("n_leaves"), nothing.alias("saved_tokens"), "ends_sha256")
    summary = above.unionByName(short)
    step = summary.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("depth"))
    d = F.col("depth").cast("int")
    path = stored(step.select(
        "shard", "last", "depth", "conv_id", "n_convs", "n_leaves", "saved_tokens",
        _named(F.slice("turns", F.lit(1), d)).alias("node"), F.when(d > 0, _named(F.slice("turns", F.lit(1), F.greatest(d - 1, F.lit(0))))).alias("parent"),
        F.hex(F.get("turns", d)["key"]).alias("child"), F.when(d > 0, F.get("turns", d - 1)["bytes"]).otherwise(0).alias("bytes"),
        F.when(F.col("depth") == F.col("last"), F.col("ends_sha256")).alias("ends"),
    ))
    at = ["depth", "node"]
    upper = path.groupBy(at).agg(F.min("conv_id").alias("least"), F.sum("n_convs").alias("members"), F.max("bytes").alias("bytes"), F.min("shard").alias("owner"), F.min("parent").alias("parent"), F.max("ends").alias("ends"))
    kinds = path.filter("child is not null").select(*at, "child").distinct().groupBy(at).agg(F.count(F.lit(1)).alias("n_children"))
    upper = stored(upper.join(kinds, at, "left").na.fill(0, ["n_children"]))
    # what lies below is summed along each shard's path; what a node adds itself counts in the path of one shard
    own = path.select("shard", *at, "n_leaves", "saved_tokens").join(upper.select(*at, "members", "n_children", "bytes", "owner"), at)
    mine = F.col("shard") == F.col("owner")
    down = Window.partitionBy("shard").orderBy(F.col("depth").desc())
    leaf = F.sum(F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).over(down)
    worth = F.sum(F.when(mine, (F.col("members") - 1) * F.col("bytes")).otherwise(0)).over(down)
    below = own.select(*at, (F.col("n_leaves") + leaf).alias("n_leaves"), (F.col("saved_tokens") + worth).alias("saved_tokens"))
    below = below.groupBy(at).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    least = upper.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    high = upper.join(below, at).join(least, ["depth", "parent"], "left").withColumnsRenamed({"least": "conv_id", "members": "n_convs", "ends": "ends_sha256"})
    ends_at = path.filter("child is not null").filter("depth = last").select("shard", *at)
    parents = ends_at.join(upper.select(*at, F.col("least").alias("parent_conv_id")), at).select("shard", "parent_conv_id")
    whole = nodes.filter("shard is null").drop("shard").unionByName(tops.join(parents, "shard").drop("shard")).unionByName(high.select(*_NAMES))
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
