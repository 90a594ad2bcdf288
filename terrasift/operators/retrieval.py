"""Vector and word retrieval, evidence checks, bounded history."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Rows of a block of items, searches that meet it in one group, and searches scored at once: what a task holds.
ROWS, SEARCHES, AT_ONCE = 8192, 16384, 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(items: DataFrame, vector: str, query: Sequence[float], k: int, key: str, where: Column | None = None) -> DataFrame:
    """The k items most like the query, among those ``where`` lets through; ties by key. Tasks keep k rows each."""
    rows = items.filter(where) if where is not None else items
    literal = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", F.round(cosine(F.col(vector), literal), 6)).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def nearest_each(items: DataFrame, vector: str, queries: DataFrame, k: int, key: str) -> DataFrame:
    """query, key, score, nth: the k items most like each row of ``queries`` (key and vector); ties by key.

    Blocks of items meet all searches, group by group (``met``); neither side is broadcast or passes the driver.
    """
    rows = items.select(F.col(key).alias("item"), F.col(vector).alias("v")).filter("v is not null")
    blocks = max(1, -(-rows.count() // ROWS))
    asked = queries.select(F.col(key).alias("query"), F.col(vector).alias("v")).filter("v is not null")
    asked = asked.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return first_of(met(asked, rows.withColumn("at", scattered(F.lit(blocks))), k, -(-queries.count() // SEARCHES)), k).withColumnRenamed("item", key)


def scattered(parts: Column) -> Column:
    """A number below ``parts`` that deals rows evenly, equal ones too."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int")


def first_of(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("item")))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k)


def met(asked: DataFrame, rows: DataFrame, k: int, parts: int) -> DataFrame:
    """query, item, score: for each search and block ``at`` the k rows of the block most like it; ties by item.

    ``asked``: query, v, at; ``rows``: item, v, at. With ``lists`` in the first, ``list`` in the second, a search only
    finds rows of its lists. Searches are dealt to ``parts``, each of which meets the block by itself, so a group holds
    a block's rows and about SEARCHES searches, scored AT_ONCE at a time.
    """
    kinds = {name: df.schema[name].dataType.simpleString() for df, name in ((asked, "query"), (rows, "item"))}
    parts = max(1, parts)
    asked = asked.withColumn("part", scattered(F.lit(parts))).groupBy("at", "part")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("at", "part")
    return asked.cogroup(rows).applyInArrow(_best(k), f"query {kinds['query']}, item {kinds['item']}, score double")


def unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a cosine, and their directions."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == length)
    flat = column.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    directions = unit(flat.reshape(-1, length))
    good = np.isfinite(directions).all(axis=1)
    return fits[good], directions[good]


def _probed(lists: pa.Array, own: np.ndarray) -> np.ndarray:
    """For each search and row, whether the row's list is one of the search's."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    table = np.zeros((len(lists), max(flat.max(initial=0), own.max(initial=0)) + 1), bool)
    table[np.repeat(np.arange(len(lists)), n), flat] = True
    return table[:, own]


def _best(k: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("item", "ascending")], null_placement="at_start"))
        out = [pa.table({"query": asked["query"].slice(0, 0), "item": rows["item"].slice(0, 0), "score": pa.array([], pa.float64())})]
        lengths = pc.unique(pc.list_value_length(asked["v"])).to_pylist() if len(rows) else []
        for length in (n for n in lengths if n):
            (qs, q), (at, m) = matrix(asked["v"], length), matrix(rows["v"], length)
            for first in range(0, len(qs) if len(at) else 0, AT_ONCE):
                query = qs[first : first + AT_ONCE]
                score = np.round(q[first : first + AT_ONCE] @ m.T, 6)
                if "list" in rows.column_names:
                    own = rows["list"].to_numpy()[at]
                    score[~_probed(asked["lists"].take(pa.array(query)).combine_chunks(), own)] = -np.inf
                least = np.partition(score, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(query), -1.5)
                i, j = np.nonzero((score >= least[:, None]) & (score > -1.5))  # all that tie with the k-th
                order = np.lexsort((j, -score[i, j], i))
                i, j = i[order], j[order]
                held = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[held], j[held]
                out.append(pa.table({"query": asked["query"].take(pa.array(query[i])), "item": rows["item"].take(pa.array(at[j])), "score": pa.array(score[i, j], pa.float64())}))
        return pa.concat_tables(out)

    return run


def lexical_each(items: DataFrame, text: str, queries: DataFrame, k: int, key: str) -> DataFrame:
    """query, key, score, nth: for each row of ``queries`` the k items that share most different words with it; ties by key.

    Words meet through an inverted list; shared words are counted in part before the pairs shuffle.
    """
    listed = lambda df, name: df.select(F.col(key).alias(name), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9_]+)"), 1))).alias("word"))
    pairs = listed(queries, "query").join(listed(items, key), "word").groupBy("query", key).agg(F.count(F.lit(1)).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), key))
    return pairs.withColumn("nth", nth).filter(F.col("nth") <= k)


def lexical(items: DataFrame, text: str, query: str, phrases: Sequence[str], k: int, key: str) -> DataFrame:
    """Shared different words plus two for each phrase that occurs; positive scores only, ties by key."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9_]+)"), 1))
    asked = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(query)), F.lit("([a-z0-9_]+)"), 1))
    score = F.size(F.array_intersect(tokens, asked))
    for phrase in phrases:
        score = score + F.when(F.lower(F.col(text)).contains(phrase.lower()), 2).otherwise(0)
    return items.withColumn("score", score.cast("bigint")).filter("score > 0").orderBy(F.col("score").desc(), key).limit(k)


def recent(turns: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """The newest turns of each conversation whose lengths sum to at most ``budget``; always the newest."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    spent = F.sum(F.coalesce(F.length(text), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumns({"spent": spent, "_nth": F.row_number().over(w)}).filter((F.col("spent") <= budget) | (F.col("_nth") == 1)).drop("_nth")


def verdict(reply, expected: Sequence[str], distractors: Sequence[str] = (), ordered: bool = False) -> Column:
    """PASS if every expected text occurs, in order if asked, and no distractor does."""
    text = S.col(reply)
    places = [S.position_of(text, e) for e in expected]
    ok = F.lit(True)
    for p in places:
        ok = ok & p.isNotNull()
    if ordered:
        for a, b in zip(places, places[1:]):
            ok = ok & F.coalesce(a <= b, F.lit(False))
    for d in distractors:
        ok = ok & S.position_of(text, d).isNull()
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "FAIL").when(ok, "PASS").otherwise("FAIL")


def verdict_numbers(reply, expected: Sequence[float], tolerance: float = 0.0, distractors: Sequence[float] = ()) -> Column:
    found = S.numbers_in(F.coalesce(S.col(reply), F.lit("")))
    has = lambda v: F.exists(found, lambda x: F.abs(x - v) <= abs(v) * tolerance)
    ok = F.lit(True)
    for v in expected:
        ok = ok & has(v)
    for v in distractors:
        ok = ok & ~has(v)
    return F.when(ok, "PASS").otherwise("FAIL")


def examples(golden: DataFrame, ids: Sequence[str] = (), tags: Sequence[str] = (), without_agents: Sequence[str] = ()) -> DataFrame:
    """Of examples (id, tags, agent) those named, those with any of the tags, those of other agents; nothing given, all."""
    keep = F.lit(True)
    if ids:
        keep = keep & F.col("id").isin(*ids)
    if tags:
        keep = keep & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if without_agents:
        keep = keep & ~F.coalesce(F.col("agent").isin(*without_agents), F.lit(False))
    return golden.filter(keep)


def guarded(question, reply, value, terms: Sequence[str], refusal: str) -> Column:
    """The reply, or the refusal where the question has one of the terms and the value it asks for is null."""
    asks = F.lit(False)
    for term in terms:
        asks = asks | F.lower(S.col(question)).contains(term.lower())
    return F.when(F.coalesce(asks, F.lit(False)) & S.col(value).isNull(), refusal).otherwise(S.col(reply))


def ungrounded_share(reply, evidence) -> Column:
    """Share of the reply's different numbers that the evidence lacks; null if the reply has none."""
    said = F.array_distinct(S.numbers_in(reply))
    return F.size(F.array_except(said, S.numbers_in(evidence))) / F.nullif(F.size(said), F.lit(0))


def blocked(reply, evidence, more_than: int = 5, share: float = 0.6) -> Column:
    said = F.array_distinct(S.numbers_in(reply))
    return (F.size(said) > more_than) & (F.coalesce(ungrounded_share(reply, evidence), F.lit(0.0)) > share)


def document_id(entity, text) -> Column:
    return F.md5(F.concat_ws(":", S.col(entity).cast("string"), F.substring(S.col(text), 1, 200)))


def add_documents(store: DataFrame, new: DataFrame) -> DataFrame:
    """Insert if absent by content. Columns: entity, doc_type, text, embedding, metadata."""
    from .changes import insert_ignore

    return insert_ignore(store, new.withColumn("id", document_id("entity", "text")), ["id"], [F.col("doc_type")])


def replace_documents(store: DataFrame, new: DataFrame, doc_type: str) -> DataFrame:
    """The new documents take the place of an entity's documents of one type."""
    new = new.withColumn("id", document_id("entity", "text"))
    gone = new.select("entity").distinct().withColumn("doc_type", F.lit(doc_type))
    return store.join(gone, ["entity", "doc_type"], "left_anti").unionByName(new, allowMissingColumns=True)


def documents_of(store: DataFrame, entities: DataFrame) -> DataFrame:
    """The documents of every row of ``entities`` (column entity); an entity asked for twice is answered once."""
    return store.join(entities.select("entity"), "entity", "left_semi")


def with_presence(asked: DataFrame, store: DataFrame) -> DataFrame:
    """Adds ``stored``: whether the store has a document of that entity and text."""
    held = store.select(F.col("id").alias("_id"), F.lit(True).alias("stored")).distinct()
    found = asked.join(held, document_id("entity", "text") == F.col("_id"), "left").drop("_id")
    return found.withColumn("stored", F.coalesce("stored", F.lit(False)))


def delete_documents(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the documents whose ids are given; ids it lacks, and null ones, change nothing."""
    return store.join(ids.select("id"), "id", "left_anti").select(*store.columns)


def photo_text(name, caption) -> Column:
    return F.concat(F.lit("[Photo] "), S.col(name), F.lit(". "), F.coalesce(S.col(caption), F.lit("")))


def pass_rates(results: DataFrame, tags: str, verdict_col: str) -> DataFrame:
    return results.select(F.explode(tags).alias("tag"), verdict_col).groupBy("tag").agg(F.count_if(F.col(verdict_col) == "PASS").alias("passed"), F.count(F.lit(1)).alias("total"))
