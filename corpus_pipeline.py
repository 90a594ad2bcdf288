"""Corpus preparation: language ID, exact dedup, near dedup, decontamination, tokens.

Each stage takes the documents its predecessor kept, takes its decision over all of them, and returns their columns as
they are; the last returns their tokens. ``run`` writes every stage as Parquet below the session's shared checkpoint
folder and reads it again, so a lost executor costs at most the stage it was in.

Rows are told apart by ``doc_id`` together with the text, so a text never goes because another one has its id, and
rows with a null id are judged like any other. Languages and leaks are decided within a row; only possible copies move.

Defined results: null and empty texts go in the first stage (no letter); of texts that are equal the row with the
smallest id stays, a null id comes last; of rows that are equal in id and text exactly one stays; other columns,
whatever their names, are returned as they are; no rows in, no rows out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import bloom_dedup, bpe, decontam, langid, simhash
from terrasift.llm.common import new_path, remove, stored, table, whole_row
from terrasift.llm.queries import BPE_RANKS, PIECES, held_out


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is likelier than all others together, go."""
    model = langid.LanguageModel.fit(docs.filter(~held_out(F.col("doc_id"))), langid.public_pieces(PIECES))
    judged = docs.select(whole_row(docs), model.of("text").alias("own"))
    return judged.filter((F.col("own.lang_pred") != "und") & (F.col("own.score") >= 0.5)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, one with the smallest id."""
    return bloom_dedup.first_of_each(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more) one document with the smallest id
    stays. A row's key sorts by id, null last, and tells different texts of one id apart."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    keyed = docs.select(whole_row(docs), key.alias("key"))
    texts = docs.select(key.alias("key"), "text")
    found = stored(simhash.near_dedup(texts, id_col="key", words=5, similarity=0.8).select(F.col("doc_id").alias("key"), "component_id"))
    stays = F.col("key") == F.col("component_id")
    left = bloom_dedup.without(keyed, found.filter(~stays).select("key").distinct(), "key")
    again = found.filter(stays).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    maybe, others, again = bloom_dedup.split_by_keys(left, again, "key")
    once = maybe.join(again, "key", "left_anti").unionByName(maybe.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return others.unionByName(once).select("row.*")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of what the ids decode to."""
    codec = bpe.Codec(spark, BPE_RANKS, public_tokenizers.PATTERN)
    found = codec.encode(docs, decode=True)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("leaks", leak_stage), ("tokens", token_stage)]

#: SQL can't express the language model, XXH64 or the merges of BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
