"""The ten operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasift.llm import bloom_dedup, bpe, decontam, langid, lcp_tree, line_frequency, merkle, qda, repeats, simhash, suffix_tree
from terrasift.llm.queries import BPE_RANKS, PIECES

SCHEMA = "doc_id bigint, text string, lang string, source string"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
ODD = [(1, "same text", "en", "a"), (2, "same  text", "en", "a"), (2, "same  text", "en", "a"), (3, None, None, None), (4, "", "en", None), (5, " \t\n", "en", "b"), (None, "no id", "en", "b"), (None, None, None, None), (6, LONG, "en", "a"), (7, LONG + " x", "en", "a"), (8, "x" * 5000, "en", "a"), (9, "žluťoučký 🐎 kůň\x00", "cs", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long and repeated rows, with columns whose names the operators use inside."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("fp", "node", "h", "norm", "d", "tag", "gram", "n", "kept", "ids", "x", "score", "host")}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(rng, n, vocabulary=60):
    return [f"{rng.choice('abcdef')}{rng.randrange(vocabulary)}" for _ in range(n)]


def copies(seed=5, n=40):
    """Texts with shared passages, exact copies and copies with changes."""
    rng = random.Random(seed)
    shared = [words_of(rng, 80) for _ in range(4)]
    out = []
    for i in range(n):
        text = words_of(rng, rng.randrange(0, 150))
        for s in rng.sample(shared, rng.randrange(3)):
            at, a = rng.randrange(len(text) + 1), rng.randrange(20)
            text[at:at] = s[a : a + rng.randrange(30, 80)]
        if i and rng.random() < 0.3:
            text = list(out[rng.randrange(i)][1].split())
            if text and rng.random() < 0.6:
                text[rng.randrange(len(text))] = "changed"
        out.append((i * 3, " ".join(text), "en", "s"))
    return out


# exact dedup


def test_exact_dedup(spark, odd, none):
    rows = bloom_dedup.exact_dedup(odd, slots_per_row=1).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in ODD:
        groups.setdefault(norm(t), []).append(i)
    wanted = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            wanted[(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == wanted
    assert bloom_dedup.exact_dedup(none).count() == 0


def test_filter_only_lets_unique_rows_pass(spark):
    rng = np.random.default_rng(1)
    h = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 4000), np.repeat(rng.integers(-(2**63), 2**63 - 1, 50), 3)])
    ranges, slots = bloom_dedup.plan(len(h))
    bits = bloom_dedup.repeated_slots(spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(7), slots, 3)
    at = bloom_dedup._positions(h, slots, 3)
    maybe = ((bits[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1)
    assert maybe[4000:].all() and maybe[:4000].mean() < 0.05
    assert ranges == 1 and bloom_dedup.plan(10**9, 16, 1 << 20) == (2048, 8 << 20)


def test_filters_of_many_ranges_give_the_same(spark):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(9000)}") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert bloom_dedup.plan(len(rows), 48, 8192) == (16, 1 << 16)
    one, many = (sorted(map(tuple, bloom_dedup.exact_dedup(docs, slots_per_row=48, max_filter_bytes=m).collect())) for m in (64 << 20, 8192))
    assert one == many and len(one) == len(rows)


# SimHash


def fingerprint(text, k=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))] if found else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, linked):
    label = {x: x for x in items}
    for _ in items:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_simhash(spark, odd, none):
    rows = [(i, t) for i, t, *_ in copies() + copies(6, 300)] + [(10_000 + i, f"{'a b c d e f g h ' * 40}{i % 7}") for i in range(60)]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    fps = {i: fingerprint(t) for i, t in rows}
    distinct = set(fps.values())
    rep = {f: min(i for i in fps if fps[i] == f) for f in distinct}
    linked = [(rep[a], rep[b]) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 2]
    label = classes(rep.values(), linked)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {i: (f"{f:016x}", label[rep[f]]) for i, f in fps.items()}
    assert len(linked) > 3
    got = simhash.near_dedup(odd).collect()
    assert len(got) == len(ODD) and {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5)} == {"0" * 16} and {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}
    assert simhash.near_dedup(none).count() == 0


def test_masks_cover_all_pairs():
    masks = simhash.covering_masks()
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


def test_links_and_long_chains(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    x = rng.getrandbits(64)
    for b in range(0, 60, 2):  # a chain, two bits apart each
        fps.add(x)
        x ^= 3 << b
    for _ in range(40):
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    node = {f: i for i, f in enumerate(fps)}
    df = spark.createDataFrame([(simhash._signed(f), i) for f, i in node.items()], "fp bigint, node bigint")
    label = classes(node.values(), [(node[a], node[b]) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2])
    found = {r["a"]: r["b"] for r in simhash.components(simhash.links(df)).collect()}
    assert found == {a: b for a, b in label.items() if a != b} and len(found) > 30


def test_majority_over_many_runs():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 2, 255, 256, 1000, 0, 3])
    h = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    at = np.cumsum(sizes) - sizes
    for f, n, a in zip(simhash.majority(h, sizes), sizes, at):
        assert int(f) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a : a + n]) > n)


# BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE_RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_bpe(spark, odd, none, library):
    codec = bpe.Codec(spark, BPE_RANKS, public_tokenizers.PATTERN)
    rows = codec.decode(codec.encode(odd)).collect()
    wanted = Counter((i, tuple(library[0].encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in ODD)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["data"])) for r in rows) == wanted
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["data"])) for r in codec.encode(odd, decode=True).collect()) == wanted
    assert codec.decode(codec.encode(none)).count() == 0 == codec.encode(none, decode=True).count()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40) | st.text(alphabet="aeinrst ", max_size=60).map(str.encode))
def test_pieces_merge_as_by_brute_force(library, piece):
    ranks = library[1]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    wanted = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
    assert list(bpe.encode_piece(piece, ranks)) == wanted


# language ID


def all_segmentations(marked, table, k):
    if not marked:
        return 1.0
    total = 0.0
    for n in range(1, len(marked) + 1):
        p = table[marked[:n]][k] if marked[:n] in table else langid._FLOOR if n == 1 else None
        if p is not None:
            total += p * all_segmentations(marked[n:], table, k)
    return total


def test_forward_sums_all_segmentations():
    table = {"▁": (0.1, 0.2), "▁a": (0.2, 0.1), "a": (0.1, 0.1), "ab": (0.05, 0.3), "b": (0.2, 0.05), "aba": (0.01, 0.02)}
    some = ["a", "ab", "abab", "abc", "ccc", "b"]
    known = langid._Scores(table, 3)
    for _ in range(2):
        for word, row in zip(some, known.of(some)):
            assert row == pytest.approx([np.log(all_segmentations("▁" + word, table, k)) for k in (0, 1)])


def test_expected_counts_are_those_of_all_segmentations():
    table = {"▁": (0.1,), "▁a": (0.2,), "a": (0.1,), "ab": (0.05,), "b": (0.2,), "aba": (0.01,)}
    rows, chances = langid.table_of(table)
    got = langid.expected_counts(["abab", "a"], np.array([2.0, 1.0]), rows, chances[:, 0], 3)
    wanted = np.zeros(len(chances))
    for word, n in (("▁abab", 2.0), ("▁a", 1.0)):
        ways = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts = re.split("\\|", "".join(c + "|" * bool(x) for c, x in zip(word, (*cuts, 0))))
            if all(x in table for x in parts):
                ways.append((np.prod([table[x][0] for x in parts]), parts))
        for p, parts in ways:
            for x in parts:
                wanted[rows[x]] += n * p / sum(w for w, _ in ways)
    assert got == pytest.approx(wanted)


def test_expectation_maximisation_raises_the_likelihood(spark):
    texts = [(i, w, "en" if i % 2 else "de", "s") for i, w in enumerate(["the house and the garden", "das haus und der garten", "the thing other", "der die das"] * 3)]
    docs = spark.createDataFrame(texts, SCHEMA)
    vocabulary = langid.public_pieces(PIECES)
    models = [langid.LanguageModel.fit(docs, vocabulary, rounds=n) for n in (1, 3)]
    log = lambda m: sum(langid._Scores(m.pieces, m.longest).of(langid.words(t))[:, m.languages.index(x)].sum() for _, t, x, _ in texts)
    assert log(models[1]) > log(models[0])
    assert {r["doc_id"]: r["lang_pred"] for r in models[1].predict(docs).collect()} == {i: x for i, _, x, _ in texts}


@pytest.mark.parametrize("n", [4000, 4001, 9000])
def test_every_language_teaches_whatever_its_size(spark, n):
    rows = [(7, f"the cat {i} sat" if i % 2 else "the cat sat", "en") for i in range(n)] + [(None, "der hund und die katze", "de")] * 5
    model = langid.LanguageModel.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), ["the", "der", "cat", "hund", "▁"], texts_per_language=500, rounds=1)
    assert model.languages == ["de", "en"]


def test_language_of_odd_rows(spark, odd, none):
    model = langid.LanguageModel.fit(odd, langid.public_pieces(PIECES), rounds=1)
    rows = model.predict(odd).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"} and all(0 <= r["score"] <= 1 for r in rows)
    empty = langid.LanguageModel.fit(none, langid.public_pieces(PIECES))
    assert {r["lang_pred"] for r in empty.predict(odd).collect()} == {"und"} and model.predict(none).count() == 0


# line frequency


def test_line_frequency(spark, odd, none):
    pages = [(i, "\n".join(["Menu", f"own {i}", "  Menu ", "", "rare" if i < 3 else f"z{i}", "Menu" if i % 2 else "x"]), "en", "h" if i < 40 else None) for i in range(60)]
    rows = {r["doc_id"]: r for r in line_frequency.drop_boilerplate(spark.createDataFrame(pages, SCHEMA).withColumn("host", F.lit(1)), ratio=0.4).collect()}
    for i, t, _, _ in pages:
        kept = [x for x in t.split("\n") if x.strip() not in ("Menu", "x")]
        assert rows[i]["kept_text"] == "\n".join(kept) and rows[i]["n_lines"] == 6 and rows[i]["n_dropped"] == 6 - len(kept)
    got = line_frequency.drop_boilerplate(odd).collect()
    assert len(got) == len(ODD) and all(r["n_dropped"] == 0 for r in got)
    assert line_frequency.drop_boilerplate(none).count() == 0


def test_repeated_rows_count_as_pages(spark):
    df = spark.createDataFrame([(1, "a\nb", "en", "h")] * 3, SCHEMA)
    assert [r["kept_text"] for r in line_frequency.drop_boilerplate(df).collect()] == [""] * 3


# substring dedup


def brute_words(rows, length):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for a in range(len(w) - length + 1):
            first.setdefault(tuple(w[a : a + length]), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
    return out


def brute_bytes(rows, length):
    seen = Counter((t or "").encode()[a : a + length] for _, t in rows for a in range(len((t or "").encode()) - length + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


LIMITS = [{}, {"group_limit": 1}, {"group_limit": 2, "chunk_bytes": 500}]


@pytest.mark.parametrize("limits", LIMITS)
def test_suffix_tree(spark, limits):
    rows = [(i, t) for i, t, *_ in copies()] + [(500, "a b " * 200), (501, "b a " * 120), (502, None), (503, "z " * 300), (504, "z " * 60)]
    found = {r["doc_id"]: (r["n"], r["n_removed"], bytes(r["kept"])) for r in suffix_tree.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), **limits).collect()}
    wanted = brute_words(rows, 50)
    assert found == wanted and sum(w[1] for w in wanted.values()) > 500


@pytest.mark.parametrize("limits", LIMITS)
def test_lcp_tree(spark, limits):
    rows = [(i, t) for i, t, *_ in copies()] + [(500, "ab" * 300), (501, "ba" * 150), (502, None), (503, "é" * 300), (504, "xé" + "é" * 150), (505, "q" * 199), (506, "q" * 199)]
    found = {r["doc_id"]: (r["n"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in lcp_tree.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), **limits).collect()}
    wanted = brute_bytes(rows, 200)
    assert found == wanted and sum(w[1] for w in wanted.values()) > 2000


@pytest.mark.parametrize("module", [suffix_tree, lcp_tree])
def test_substrings_of_odd_rows(odd, none, module):
    rows = module.dedup(odd).collect()
    assert len(rows) == len(ODD) and module.dedup(none).count() == 0
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[6]["n_removed"] == (0 if module is suffix_tree else by[6]["n"]) and by[7]["n_removed"] >= 19_990
    if module is lcp_tree:
        assert by[8]["n_removed"] == 5000  # one text repeats itself


@pytest.mark.parametrize("find", [lcp_tree.maximal_repeats, lambda *a: suffix_tree.maximal_repeats(*a, width=1)])
@settings(max_examples=80, deadline=None)
@given(places=st.lists(st.tuples(st.text("ab", max_size=12), st.text("ab", min_size=1, max_size=12)), min_size=2, max_size=9), shortest=st.integers(2, 10))
def test_maximal_repeats(find, places, shortest):
    """All occurrences of every string that can't be extended to either side without losing one."""
    before = [a.encode()[::-1] for a, _ in places]
    after = [b.encode() for _, b in places]
    found = [(l, r, tuple(sorted(inside))) for l, r, inside in find(before, after, shortest)]
    wanted = set()
    for x, y in itertools.combinations(range(len(places)), 2):
        l, r = repeats.common(before[x], before[y]), repeats.common(after[x], after[y])
        if l + r >= shortest:
            wanted.add((l, r, tuple(z for z in range(len(places)) if before[z][:l] == before[x][:l] and after[z][:r] == after[x][:r])))
    assert len(found) == len(set(found)) and set(found) == wanted


def test_suffix_tree_links_its_nodes():
    texts = [b"abcab", b"abcb", b"abd", b"b", b"bcab"]
    nodes = {(depth, tuple(sorted(tree.order[first:end]))) for tree in [suffix_tree.Tree(texts, 1)] for depth, first, end, _ in tree.nodes()}
    assert nodes == {(0, (0, 1, 2, 3, 4)), (2, (0, 1, 2)), (3, (0, 1)), (1, (3, 4))}


@pytest.mark.parametrize("kind", [suffix_tree.KIND, lcp_tree.KIND])
def test_longer_grams_keep_every_window(kind):
    rng = random.Random(6)
    lengths = repeats.gram_lengths(kind)
    assert lengths[0] == kind.gram and lengths[-1] == kind.length and lengths == sorted(set(lengths))
    words = words_of(rng, kind.length + 30, 9)
    piece = " ".join(words).encode() if kind.words else "".join(words).encode()[: kind.length + 30]
    rows = [(1, 2, 1, 7, 30, place, piece) for place in (30, 31, kind.length - kind.gram)]
    import pyarrow as pa

    for before, now in itertools.pairwise(lengths):
        types = [pa.int64()] * 4 + [pa.int16()] * 2 + [pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list("abcdefg"))
        parts = [r for out in repeats._lengthened(kind, before, now)([batch]) for r in zip(*(c.to_pylist() for c in out.columns))]
        assert sum(r[4] + 1 for r in parts) == sum(r[4] + 1 for r in rows)
        for _, _, _, _, extra, place, text, *_ in parts:
            assert len(text.split() if kind.words else text) == extra + kind.length
            assert all(0 <= place - off <= kind.length - now for off in range(extra + 1))  # the gram lies in every window
        rows = [r[:7] for r in parts]
    assert all(r[4] == 0 and r[5] == 0 for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=30, max_size=120), st.text("abc", max_size=20), st.text("abc", max_size=20))
def test_equal_windows_have_equal_anchors(text, a, b):
    length, gram = 24, 8

    def anchored(t):
        symbols = repeats.byte_symbols(t.encode())
        if (found := repeats.anchors(symbols, length, gram)) is None:
            return {}
        out = {}
        for g, _, lo, extra, place in zip(*found):
            for i in range(lo, lo + extra + 1):
                out.setdefault(t[i : i + length], set()).add((int(g), int(lo + place - i)))
        assert len({i for lo, e in zip(found[2], found[3]) for i in range(lo, lo + e + 1)}) == len(t) - length + 1
        return out

    first, second = anchored(a + text), anchored(text + b)
    for window in first.keys() & second.keys():
        assert len(first[window] | second[window]) == 1


# decontamination


def test_leaks(spark, odd, none):
    rng = random.Random(8)
    items = [(i, " ".join(words_of(rng, rng.randrange(6, 40), 500)).capitalize() + ". " + " ".join(words_of(rng, rng.randrange(1, 12), 500)) + ".") for i in range(30)] + [(98, None), (99, " ")]
    texts = []
    for i in range(60):
        body = words_of(rng, rng.randrange(0, 400), 500)
        if i % 3 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = items[i % 30][1].upper().split() if i % 2 else items[i % 30][1].replace(" ", "\n").split(" ")
        texts.append((i, " ".join(body)))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), shard_items=11).collect()}
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    assert found == {(i, j) for i, t in texts for j, u in items if u and u.strip() and f" {flat(u)} " in f" {flat(t)} "} and len(found) == 20
    assert decontam.leaks(odd, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    same = spark.createDataFrame([(1, "same text"), (2, LONG)], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(odd, same).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (6, 2), (7, 2)]
    assert decontam.leaks(none, same).count() == 0 and decontam.leaks(odd, same.limit(0)).count() == 0


def test_scores_do_not_depend_on_shards_or_order(spark):
    rng = random.Random(12)
    items = [(i, " ".join(words_of(rng, rng.randrange(6, 60), 90)) + ". " + " ".join(words_of(rng, rng.randrange(1, 12), 90)) + ".") for i in range(24)]
    texts = [(i, " ".join([*words_of(rng, 50, 90), *[w for w in items[i][1].split() if rng.random() < 0.97], *words_of(rng, 50, 90)])) for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").cache()
    found = []
    for size, order in [(100, items), (3, items), (5, items[::-1]), (24, rng.sample(items, 24))]:
        rows = decontam.leaks(docs, spark.createDataFrame(order, "item_id bigint, text string").coalesce(1), overlap=0.2, shard_items=size).collect()
        found.append(sorted((r["doc_id"], r["item_id"], round(r["score"], 9), round(r["question_overlap"], 9)) for r in rows))
    assert found[0] and all(f == found[0] for f in found)


def passages_of(index, text):
    words = re.findall(r"\w+", text.lower())
    half = index.longest
    return [words[h : h + 2 * half] for h in range(0, max(1, len(words) - half), half)] if words else []


def brute_bm25(items, index, text, threshold):
    """item -> best score over a text's passages, by the formula and every item."""
    tokens = [decontam.item_words(t) for _, t in items]
    df, mean = Counter(w for t in tokens for w in set(t)), sum(map(len, tokens)) / len(tokens)
    best = {}
    for words in map(set, passages_of(index, text)):
        for i, t in enumerate(tokens):
            weight = {w: np.log1p((len(tokens) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w, n in Counter(t).items()}
            score = sum(x for w, x in weight.items() if w in words) / sum(weight.values())
            if score >= threshold - 1e-9:
                best[i] = max(best.get(i, 0), score)
    return best


def test_search_equals_brute_force_bm25():
    rng = random.Random(9)
    items = [(i, " ".join(words_of(rng, rng.randrange(8, 30), 30)) + ". " + " ".join(words_of(rng, 3, 30)) + ".") for i in range(50)]
    index, found = decontam.ItemIndex(items), 0
    texts = [" ".join(words_of(rng, rng.choice([0, 1, 20, 60, 400]), 30)) for _ in range(60)]
    for text, got in zip(texts, index.search(texts, 0.45, 0.0)):
        wanted = brute_bm25(items, index, text, 0.45)
        assert got.keys() == wanted.keys() and {i: s for i, (s, _, _) in got.items()} == pytest.approx(wanted)
        found += len(wanted)
    assert found > 50


def test_altered_items_are_found(spark):
    rng = random.Random(10)
    items = [(i, " ".join(words_of(rng, rng.randrange(60, 90), 3000)) + ". " + " ".join(words_of(rng, rng.randrange(6, 9), 3000)) + ".") for i in range(100)]
    texts = []
    for i, t in items:
        words = t.split()
        words[rng.randrange(10, 50)] = "altered"
        texts.append((i, " ".join(words_of(rng, 100, 3000) + words + words_of(rng, rng.randrange(900), 3000))))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(found & {(i, i) for i, _ in items}) >= 90 and all(i == j for i, j in found)


def test_one_word_items_and_very_long_texts(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words_of(rng, 20, 20_000)) + ". " + " ".join(words_of(rng, 6, 20_000)) + ".") for i in range(3000)] + [(9000, "a1"), (9001, "A1.")]
    text = " ".join([*words_of(rng, 200_000, 20_000), items[77][1], "a1"])
    index = decontam.ItemIndex(items)
    assert list(index.search([text, "a1 a1"], 0.6, 0.8)) == [{77: pytest.approx((1.0, 1.0, 1.0))}, {}]
    assert len(index.largest) <= sum(len(set(decontam.item_words(t))) for _, t in items)  # a bound for a posting at most


# quality


def test_discriminant_equals_densities():
    rng = np.random.default_rng(4)
    d = len(qda.FEATURES)
    s = [np.cov(rng.normal(size=(d, 50))) + np.eye(d) for _ in range(2)]
    m = [rng.normal(size=d) for _ in range(2)]
    lower = [np.linalg.cholesky(x) for x in s]
    model = qda.Discriminant(0.7, m, [np.linalg.inv(x) for x in lower], [np.log(p) - np.log(np.diag(x)).sum() for p, x in zip((0.3, 0.7), lower)])
    x = rng.normal(size=(20, d))
    log = [np.log(p) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - a, np.linalg.inv(c), x - a) for p, a, c in zip((0.3, 0.7), m, s)]
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(log[0] - log[1])))


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (6, 0), (7, 0), (8, None), (99, 1)], "doc_id bigint, quality int")
    rows = qda.quality(odd, labels, F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert {r["score"] for r in qda.quality(odd, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert qda.quality(none, labels, F.lit(True)).count() == 0


# fixity


def records(rows):
    out = []
    for i, u, h in rows:
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {u or ''}\r\nContent-Length: {len((h or '').encode())}\r\n\r\n"
        data = head.encode() + (h or "").encode() + b"\r\n\r\n"
        out.append((i, hashlib.sha256(data).hexdigest(), len(data)))
    return out


def brute_audit(a, b):
    a, b = records(a), records(b)
    order = lambda i: (i is not None, i)
    start = lambda side, i: sum(n for j, _, n in side if order(j) < order(i))
    x, y = Counter(a), Counter(b)
    out = set()
    for r in x.keys() | y.keys():
        if x[r] != y[r]:
            i = r[0]
            status = "missing" if all(k[0] != i for k in y) else "extra" if all(k[0] != i for k in x) else "changed"
            out.add((i, r[1], status, x[r], y[r], r[2], start(a, i), start(b, i)))
    return out


@pytest.mark.parametrize("n", [0, 1, 70, 5000])
def test_audit(spark, n):
    rng = random.Random(n)
    a = [(i * 3 - n, f"u{i}", "é" * rng.randrange(20) if i % 9 else None) for i in range(n)] + ([(5, "u", "twice"), (5, "u", "twice"), (None, None, None), (None, "v", "w")] if n else [])
    b = [r for r in a if rng.random() > 0.003]
    b = [(i, u, (h or "") + "!") if rng.random() < 0.003 else (i, u, h) for i, u, h in b] + [(10**7, "new", "x"), (5, "u", "other")]
    frames = [merkle.leaves(merkle.warc_records(spark.createDataFrame(x, "page_id bigint, url string, html string").withColumn("key", F.lit(0)))) for x in (a, b)]
    assert {tuple(r) for r in merkle.audit(*frames).collect()} == brute_audit(a, b)
    assert merkle.audit(frames[0], frames[0]).count() == 0
