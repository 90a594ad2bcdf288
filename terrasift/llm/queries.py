"""The registered queries of this subpackage, each over its whole table, and DuckDB SQL where that can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_dedup, bpe, decontam, divergence, langid, lcp_tree, line_frequency, merkle, qda, set_join, simhash, suffix_tree, trie
from .common import table

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: F.Column) -> F.Column:
    """Null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' WARC records in which some are cut short, lost or written twice."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lot = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    damaged = pages.withColumn("lot", lot).filter("lot is null or lot != '01'").withColumn("html", F.when(F.col("lot") == "00", F.expr("left(html, length(html) - 1)")).otherwise(F.col("html")))
    damaged = damaged.withColumn("copy", F.explode(F.when(F.col("lot") == "02", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    found = merkle.audit(*(merkle.leaves(merkle.warc_records(x)) for x in (pages, damaged)))
    return found.withColumnRenamed("key", "page_id")


OP1_SQL = r"""
WITH pages_in AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS lot FROM pages),
damaged AS (
  SELECT page_id, url, CASE WHEN lot = '00' THEN left(html, length(html) - 1) ELSE html END AS html
  FROM (SELECT * FROM pages_in UNION ALL SELECT * FROM pages_in WHERE lot = '02') WHERE lot IS NULL OR lot <> '01'),
both_sides AS (SELECT 'a' AS side, page_id, url, html FROM pages_in UNION ALL SELECT 'b', page_id, url, html FROM damaged),
records AS (SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
  || 'Content-Length: ' || CAST(octet_length(encode(html)) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM both_sides),
leaf AS (SELECT side, page_id, sha256(record) AS digest, octet_length(encode(record)) AS bytes FROM records),
starts AS (SELECT page_id, coalesce(sum(sum(bytes) FILTER (side = 'a')) OVER w, 0) AS primary_offset, coalesce(sum(sum(bytes) FILTER (side = 'b')) OVER w, 0) AS replica_offset,
  count(*) FILTER (side = 'a') AS in_a, count(*) FILTER (side = 'b') AS in_b
  FROM leaf GROUP BY page_id WINDOW w AS (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
counted AS (SELECT page_id, digest, bytes, count(*) FILTER (side = 'a') AS n_primary, count(*) FILTER (side = 'b') AS n_replica FROM leaf GROUP BY ALL)
SELECT c.page_id, digest, CASE WHEN in_b = 0 THEN 'missing' WHEN in_a = 0 THEN 'extra' ELSE 'changed' END AS status, n_primary, n_replica,
  CAST(bytes AS BIGINT) AS bytes, CAST(primary_offset AS BIGINT) AS primary_offset, CAST(replica_offset AS BIGINT) AS replica_offset
FROM counted c JOIN starts s ON c.page_id = s.page_id WHERE n_primary <> n_replica
"""


def op2_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(spark, BPE_RANKS, public_tokenizers.PATTERN)
    found = codec.encode(table(spark, sf_dir, "documents"), decode=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.LanguageModel.fit(docs.filter(~held_out(F.col("doc_id"))), langid.public_pieces(PIECES))
    return model.predict(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' source is their host."""
    found = line_frequency.drop_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
cleaned AS (SELECT doc_id, source, line, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS content FROM lines),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
often AS (
  SELECT c.source, content FROM cleaned c JOIN totals t ON c.source = t.source WHERE content <> ''
  GROUP BY c.source, content, total HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) / total > 0.05),
judged AS (SELECT c.doc_id, c.line, c.pos, o.content IS NOT NULL AS dropped FROM cleaned c LEFT JOIN often o ON c.source = o.source AND c.content = o.content)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op6_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qda.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_lcp_interval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lcp_tree.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM normal WINDOW w AS (PARTITION BY norm)
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n_lang FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n_lang)::HUGEINT AS total FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
pairs_of AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT p.lang, p.source, coalesce(sum(n), 0)::HUGEINT AS total FROM pairs_of p LEFT JOIN counted c ON p.lang = c.lang AND p.source = c.source GROUP BY ALL),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n_lang + 5)) // (l.total + 5 * l.v) AS q
  FROM sizes s JOIN langs l ON s.lang = l.lang JOIN kept k ON k.lang = s.lang LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM pairs_of a JOIN pairs_of b ON a.lang = b.lang AND a.source <> b.source),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM apart
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS place FROM every)
SELECT lang, source, part, item, value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 50
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns_of(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.shared_heads(turns))


OP12_SQL = r"""
WITH RECURSIVE powers AS (SELECT range AS i, 0 AS k, range::BIGINT AS x FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM powers WHERE k < 8),
crc_step AS (SELECT i, x FROM powers WHERE k = 8),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS digits, 4294967295::BIGINT AS x FROM turns
  UNION ALL SELECT conv_id, digits[2:], xor(c.x >> 8, t.x) FROM crc c JOIN crc_step t ON t.i = xor(c.x, ascii(c.digits)::BIGINT) & 255 WHERE c.digits <> ''),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(x, 4294967295) % 9 AS h FROM crc WHERE digits = ''),
rebuilt_turns AS (
  SELECT c.conv_id, 0 AS part, t.pos, role, text FROM heads c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
numbered AS (SELECT conv_id, text, md5(octet_length(encode(role))::VARCHAR || ':' || role || text) AS own, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt_turns),
steps AS (
  SELECT conv_id, depth, md5(string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, octet_length(encode(text)) AS bytes FROM numbered
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads),
lengths AS (SELECT conv_id, max(depth) AS n FROM steps GROUP BY conv_id),
nodes AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM steps GROUP BY depth, node),
ends AS (SELECT s.depth, s.node, sha256(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id)) AS digest FROM steps s JOIN lengths l ON s.conv_id = l.conv_id AND s.depth = l.n GROUP BY s.depth, s.node),
parents AS (SELECT n.depth, n.node, p.node AS above, q.conv_id AS parent_conv_id FROM nodes n JOIN steps p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes q ON q.depth = p.depth AND q.node = p.node),
kids AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n FROM parents GROUP BY ALL),
whole AS (
  SELECT n.*, p.parent_conv_id, coalesce(k.n, 0) AS n_children, e.digest FROM nodes n LEFT JOIN parents p ON p.depth = n.depth AND p.node = n.node
  LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node LEFT JOIN ends e ON e.depth = n.depth AND e.node = n.node),
below AS (
  SELECT s.depth, s.node, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((w.n_convs - 1) * w.bytes)::BIGINT AS saved_tokens
  FROM whole w JOIN steps s ON s.conv_id = w.conv_id AND s.depth <= w.depth GROUP BY s.depth, s.node)
SELECT w.conv_id, w.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM whole w JOIN below b ON b.depth = w.depth AND b.node = w.node
"""


def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_sets(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


QUERIES = {f.__name__: f for f in (op1_warc_fixity, op2_simhash_covering, op3_byte_bpe, op4_language_id, op5_line_frequency, op6_suffix_tree_dedup, op7_bm25_decontamination, op8_quality_qda, op9_lcp_interval_dedup, op10_bloom_dedup, op11_source_divergence, op12_prefix_trie, op13_prefix_join)}
ORACLE_SQL = {"op1_warc_fixity": OP1_SQL, "op5_line_frequency": OP5_SQL, "op10_bloom_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_prefix_trie": OP12_SQL}
