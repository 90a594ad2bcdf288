"""The registered queries on the small tables: oracles where SQL can, brute force or held-out labels elsewhere."""

import hashlib
import itertools
import re
import zlib

import pytest

from tests.compare import database, same
from tests.conftest import DATA
from tests.llm.test_operators import brute_bytes, brute_words, fingerprint, library  # noqa: F401
from terrasift.llm import queries

DIR = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(DATA / "sf0.001")


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT * FROM documents").df()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_oracle(spark, con, name):
    assert same(queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.ORACLE_SQL[name]).df())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op2(spark, docs):
    found = {r["doc_id"]: r["fingerprint"] for r in queries.op2_simhash_covering(spark, DIR).collect()}
    assert found == {i: f"{fingerprint(t):016x}" for i, t in zip(docs.doc_id, docs.text)}


def test_op3(spark, docs, library):  # noqa: F811
    rows = {r["doc_id"]: r for r in queries.op3_byte_bpe(spark, DIR).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        ids = library[0].encode_ordinary(t)
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))


def test_op4(spark, docs):
    rows = queries.op4_language_id(spark, DIR).collect()
    truth = dict(zip(docs.doc_id, docs.lang))
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_op6_and_op9(spark, docs):
    rows = list(zip(docs.doc_id, docs.text))
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op6_suffix_tree_dedup(spark, DIR).collect()}
    assert found == {i: (n, g, sha(k)) for i, (n, g, k) in brute_words(rows, 50).items()}
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op9_lcp_interval_dedup(spark, DIR).collect()}
    assert found == {i: (n, g, s, sha(k)) for i, (n, g, s, k) in brute_bytes(rows, 200).items()}


def test_op7(spark, con, docs):
    flat = lambda t: " ".join(t.split())
    items = con.execute("SELECT * FROM benchmark").df()
    whole = {(i, j) for i, t in zip(docs.doc_id, docs.text) for j, u in zip(items.item_id, items.text) if flat(u) in flat(t)}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op7_bm25_decontamination(spark, DIR).collect()}
    assert whole and whole <= found


def test_op13(spark, docs):
    """Sets, links at 0.9 and components by brute force over all pairs of the small table."""
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = [x for x in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 90 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op13_prefix_join(spark, DIR).collect()}
    assert rows == {i: (len(s), top(i)) for i, s in sets.items()} and len({c for _, c in rows.values()}) < len(rows)


def test_op8(spark):
    con = database(DATA / "sf0.01")
    truth = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = queries.op8_quality_qda(spark, str(DATA / "sf0.01")).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_pipeline(spark, con, docs):
    import corpus_pipeline as P

    at, kept = spark.read.parquet(f"{DIR}/documents.parquet"), [set(docs.doc_id)]
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, DIR).cache()
        assert at.columns == list(docs.columns)
        kept.append({r["doc_id"] for r in at.select("doc_id").collect()})
    texts = dict(zip(docs.doc_id, docs.text))
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] >= kept[4]
    assert all(any(c.isalpha() for c in texts[i]) for i in kept[1]) and len(kept[1]) >= 0.97 * len(kept[0])
    assert len(kept[2]) == len({" ".join(texts[i].split()) for i in kept[1]})
    leaked = {r["doc_id"] for r in queries.op7_bm25_decontamination(spark, DIR).collect()}
    assert kept[4] == kept[3] - leaked
    rows = P.run(spark, DIR).collect()
    assert {r["doc_id"] for r in rows} == kept[4] and all(r["decoded_sha256"] == sha(texts[r["doc_id"]].encode()) and r["n_tokens"] == len(r["ids"]) for r in rows)
