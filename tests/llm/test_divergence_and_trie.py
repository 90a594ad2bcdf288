"""Source divergence and conversation tries against brute force, with odd rows, small limits and no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, SCHEMA
from terrasift.llm import divergence, trie

# source divergence


def brute_divergence(rows, min_docs, prior=5, ranks=50):
    """(lang, source, part, item, value, rank) by the rule; ``rows``: (text, lang, source)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))
        found[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        groups = {s: c for (of, s), c in found.items() if of == lang}

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + prior) // (total + prior * len(kept)) for t in kept}

        q = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, ranks)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(values[:most], 1)]
    return Counter(out)


def told(df):
    return Counter(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n=150, sources=7):
    rng = random.Random(seed)
    words = ["a", "The", "THE", "über", "Überall", "eightlet", "ninelette", "sixteenletterssx", "seventeenletterss", "x" * 40, "y" * 33, "y" * 32, "žluťoučký", "зима", "日本語", "don't", "a_b", "a1b"]
    rows = [(" ,.\n".join(rng.choices(words, k=rng.randrange(30))) if rng.random() < 0.9 else rng.choice([None, "", "1 2"]), rng.choice(["en", "de", None, ""]), rng.choice([None, "z", *map(str, range(sources))])) for _ in range(n)]
    return [*rows, ("only one", "fr", "a"), (None, "it", "a"), ("", "it", "b"), ("q", "it", None)]


@pytest.mark.parametrize("seed, at_once, sources_at_once, min_docs", [(1, 2_000_000, 512, 3), (2, 20, 2, 5), (3, 1, 3, 30), (4, 300, 4, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, seed, at_once, sources_at_once, min_docs):
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", sources_at_once)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "docs", "share", "rank", "block", "doc_id")}).repartition(3)
    assert told(divergence.divergence(docs, min_docs=min_docs, terms_at_once=at_once)) == brute_divergence(rows, min_docs)


def test_divergence_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    assert told(divergence.divergence(docs, min_docs=2)) == brute_divergence([(t, lang, source) for _, t, lang, source in ODD], 2)
    assert divergence.divergence(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé日'\x00", max_size=40), min_size=1, max_size=6), st.integers(1, 9))
def test_packed_terms_are_counted_exactly(texts, piece):
    import pyarrow as pa

    before, divergence._PIECE = divergence._PIECE, piece
    try:
        counts = divergence.TermCounts()
        for data, offsets, doc in divergence._pieces(pa.array(["left out", *texts]).slice(1)):
            counts.add(data, offsets, doc)
            counts.compact()
    finally:
        divergence._PIECE = before
    group = np.arange(len(texts)) % 2
    found = Counter()
    for term, g, n, docs in counts.rows(group):
        for row in zip(term.to_pylist(), g.tolist(), n.tolist(), docs.tolist()):
            found[row] += 1
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.replace("Z", "z")) for t in texts]
    wanted = Counter()
    for g in (0, 1):
        own = [t for i, t in enumerate(terms) if i % 2 == g]
        for term in {x for t in own for x in t}:
            wanted[term, g, sum(t.count(term) for t in own), sum(term in t for t in own)] += 1
    assert found == wanted


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=50))
def test_radix_order_is_stable(rows):
    columns = [np.array([r[k] for r in rows], np.uint64) for k in (1, 0)]
    assert divergence.radix_order(columns).tolist() == sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][0]))


# conversation tries


def brute_trie(conversations):
    """Nodes of whole sequences; ``conversations``: conv_id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved, out = Counter(), Counter(), Counter()
    for path, own in members.items():
        worth = (len(own) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += worth
    for path, own in members.items():
        ends = sorted(c for c in own if len(conversations[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children[path], leaves[path], saved[path], digest] += 1
    return out


def brute_rebuilt(rows):
    """``rows``: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t, key=lambda x: x[:3])] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def chats(seed, n=60):
    rng = random.Random(seed)
    texts = ["hi", "", None, "ok", "žluť", "bye", "long " * 20]
    rows = []
    for c in rng.sample(range(300), n):
        rows += [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randrange(1, 25))]
    first = [(k, "user", f"the same {k}") for k in range(12)]
    for c in range(1000, 1040):
        rows += [(c, k, role, text) for k, role, text in first] + [(c, 12 + k, "user", str(rng.randrange(3))) for k in range(rng.randrange(4))]
    rows += [(None, 1, "user", "no conversation"), (-7, 1, "user", "negative"), (5000, 3, "a", "b"), (5000, 3, "a", "b")]
    rng.shuffle(rows)
    return rows


COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def nodes_of(df):
    return Counter(tuple(r) for r in df.select(*trie._NAMES).collect())


@pytest.mark.parametrize("seed, shard_turns", [(1, 50_000), (2, 200), (3, 12), (4, 1)])
def test_trie_equals_brute_force(spark, seed, shard_turns):
    rows = chats(seed)
    table = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("depth", "seq", "shard", "top", "turns", "n", "known")}).repartition(3)
    rebuilt = trie.shared_heads(trie.turns_of(table))
    assert nodes_of(trie.prefix_trie(rebuilt, shard_turns)) == brute_trie(brute_rebuilt(rows))
    plain = defaultdict(list)
    for r in trie.turns_of(table).collect():
        plain[r["conv_id"]] = r["turns"]
    assert sum(map(len, plain.values())) == sum(r[0] is not None for r in rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(3, 1, None, None)], [(4, None, "user", "x"), (4, None, "user", "x"), (0, 1, "user", "x")], [(c, 1, "user", "only") for c in range(9000)]])
def test_trie_of_odd_rows(spark, rows):
    table = spark.createDataFrame(rows, COLUMNS)
    assert nodes_of(trie.prefix_trie(trie.shared_heads(trie.turns_of(table)))) == brute_trie(brute_rebuilt(rows))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.lists(st.integers(1, 30), max_size=6).map(tuple), max_size=25))
def test_double_array_leads_to_every_row_and_to_nothing_else(rows):
    rows = [list(r) for r in sorted(rows)]
    found = trie.DoubleArray(rows)
    prefixes = {tuple(r[:d]) for r in rows for d in range(len(r) + 1)} | {()}
    states = {p: found.path(list(p))[-1] if p else 0 for p in prefixes}
    assert len(set(states.values())) == len(prefixes) == len(found.states)
    assert all(found.states.index(states[p[:-1]]) < found.states.index(states[p]) for p in prefixes if p)
    for p in prefixes:
        for c in range(1, 31):
            if (*p, c) not in prefixes:
                with pytest.raises(KeyError):
                    found.path([*p, c])
