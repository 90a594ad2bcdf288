"""Registered queries: ids, text forms, rules, retrieval, evidence, change frames, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules
from ..functions import scalar as S
from ..operators import changes as C
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators.shared import new_path
from ..operators.vector_index import VectorIndex
from .relational_queries import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT o_orderkey, substr(md5(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)), 1, 14) AS snapshot_id,
substr(md5(CAST(o_custkey AS VARCHAR)), 1, 12) AS entity_id FROM orders""")
def md5_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.text_id(14, "o_custkey", "o_orderstatus", S.money_text("o_totalprice")).alias("snapshot_id"), S.text_id(12, "o_custkey").alias("entity_id"))


_ADDRESS = "CASE c_custkey % 4 WHEN 0 THEN ' North Main Street' WHEN 1 THEN ' E. Highland Ave., #3' WHEN 2 THEN ' Ohio River Boulevard' ELSE ' Penn   Parkway' END"


def _map_sql(table_: dict[str, str]) -> str:
    return "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " ELSE t END"


@query(f"""WITH a AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(CAST(c_custkey + 1 AS VARCHAR) || {_ADDRESS}), '[.,#]', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM customer),
n AS (SELECT c_custkey, array_to_string(list_transform(string_split(x, ' '), lambda t: {_map_sql(N.STREET_TYPES | N.DIRECTIONS)}), ' ') AS norm FROM a),
w AS (SELECT *, list_filter(string_split(norm, ' ')[2:], lambda t: t NOT IN ('n','s','e','w','ne','nw','se','sw')) AS rest FROM n)
SELECT c_custkey, norm, regexp_extract(norm, '^(\\d+\\w*)', 1) AS house_number, rest[1] AS street_word FROM w""")
def text_normalise(spark, d):
    made = F.concat((F.col("c_custkey") + 1).cast("string"), F.element_at(F.array(*map(F.lit, (" North Main Street", " E. Highland Ave., #3", " Ohio River Boulevard", " Penn   Parkway"))), (F.col("c_custkey") % 4 + 1).cast("int")))
    rows = table(spark, d, "customer").select("c_custkey", N.address(made).alias("norm"))
    return rows.select("c_custkey", "norm", N.house_number("norm").alias("house_number"), N.street_word("norm").alias("street_word"))


@query("SELECT doc_id, sha256(strip_accents(coalesce(text, ''))) AS plain_sha256, length(coalesce(text, '')) AS n FROM documents")
def strip_accents(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode(S.without_marks(text), "UTF-8"), 256).alias("plain_sha256"), F.length(text).cast("bigint").alias("n"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS x FROM orders),
p AS (SELECT o_orderkey, CASE WHEN x <> 'n/a' THEN (SELECT o_orderdate FROM orders o WHERE o.o_orderkey = t.o_orderkey) END AS moment FROM t)
SELECT o_orderkey, CAST(year(moment) AS BIGINT) AS year, CAST(month(moment) AS BIGINT) AS month, strftime(moment, '%Y-%m') AS year_month, year(moment) BETWEEN 1996 AND 2000 AS sane FROM p""")
def date_parse_parts(spark, d):
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "MM/dd/yyyy hh:mm:ss a")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.date_format(day, "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "yyyy-MM-dd")).otherwise("n/a")
    rows = table(spark, d, "orders").select("o_orderkey", S.first_date(text, "MM/dd/yyyy hh:mm:ss a", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd").alias("at"))
    return rows.select("o_orderkey", F.year("at").cast("bigint").alias("year"), F.month("at").cast("bigint").alias("month"), F.date_format("at", "yyyy-MM").alias("year_month"), F.when(F.col("at").isNotNull(), S.sane_date("at", 1996, 2000).isNotNull()).alias("sane"))


#: Incident texts built from a row's own values, as the loaders would find them.
_INCIDENT = {0: "THEFT FROM AUTO", 1: "Aggravated assault w/ knife", 2: "public drunkeness", 3: "MTR VEH THEFT", 4: "Breaking & Entering", 5: "shots fired near school", 6: "Lost property", 7: "null"}
_INCIDENT_SQL = "CASE l_partkey % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _INCIDENT.items()) + " END"


def _category_sql(part: int) -> str:
    """The same rules for an engine whose \\b is ASCII: the incident texts are ASCII."""
    value = lambda k: f"'{k}'" if part == 0 else repr(rules.CATEGORIES[k][1])
    ranked = sorted(((k, v) for k, v in rules.CATEGORIES.items() if v[2]), key=lambda x: -x[1][1])
    whens = " ".join(f"WHEN regexp_matches(upper(x), '{v[2]}') THEN {value(k)}" for k, v in ranked)
    return f"CASE WHEN upper(trim(x)) IN ('', 'NAN', 'NONE', 'NULL') THEN {value('other')} {whens} ELSE {value('other')} END"


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, {_INCIDENT_SQL} AS x FROM lineitem)
SELECT category, count(*) AS n, CAST(sum(w) AS DOUBLE) AS severity FROM (SELECT {_category_sql(0)} AS category, CAST({_category_sql(1)} AS DECIMAL(18,2)) AS w FROM i) GROUP BY 1""")
def taxonomy_max_weight(spark, d):
    texts = F.element_at(F.create_map(*[F.lit(x) for kv in _INCIDENT.items() for x in kv]), (F.col("l_partkey") % 8).cast("int"))
    rows = rules.classified(table(spark, d, "lineitem").select(texts.alias("raw_type")), "raw_type", "c")
    return rows.groupBy(F.col("c.key").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.weight").cast("decimal(18,2)")).cast("double").alias("severity"))


_CODES = ("3", "37", "", "H", "0", "99")
_DESCRIPTIONS = ("VALID SALE", "Sheriff deed", "estate of", "love and affection", "")


def _market_sql(part: int) -> str:
    told = lambda ok, why: (str(ok).upper(), "'" + why.replace("'", "''") + "'")[part]
    whens = [f"WHEN coalesce(price, 0) <= 1 THEN {told(False, rules.NOMINAL_FLAG)}"]
    whens += [f"WHEN {c} = '{k}' THEN {told(False, v)}" for c in ("code", "instrument") for k, v in rules.NOT_AT_MARKET.items()]
    whens += [f"WHEN contains(upper(description), '{k}') THEN {told(False, v)}" for k, v in rules.NOT_AT_MARKET.items() if len(k) > 2]
    whens += [f"WHEN code = '{rules.ESTATE_CODE}' OR contains(upper(description), 'ESTATE') THEN {told(True, rules.ESTATE_FLAG)}"]
    return "CASE " + " ".join(whens) + f" ELSE {told(True, '')} END"


@query(f"""WITH s AS (SELECT o_orderkey, {list(_CODES)!r}[o_orderkey % 6 + 1] AS code, {list(_DESCRIPTIONS)!r}[o_orderkey // 6 % 5 + 1] AS description,
CASE WHEN o_orderstatus = 'P' THEN 'CO' ELSE 'DE' END AS instrument, CASE WHEN o_orderkey % 11 = 0 THEN 1.0 ELSE o_totalprice END AS price FROM orders) SELECT o_orderkey, {_market_sql(0)} AS is_arms_length, {_market_sql(1)} AS flag FROM s""")
def rule_chain_flag(spark, d):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int"))
    key = F.col("o_orderkey")
    told = rules.at_market(pick(_CODES, key % 6 + 1), pick(_DESCRIPTIONS, F.floor(key / 6) % 5 + 1), F.when(F.col("o_orderstatus") == "P", "CO").otherwise("DE"), F.when(key % 11 == 0, 1.0).otherwise(F.col("o_totalprice")))
    return table(spark, d, "orders").select("o_orderkey", told.alias("t")).select("o_orderkey", "t.is_arms_length", "t.flag")


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'sold' WHEN p_type = 'LARGE' THEN 'pending' WHEN p_type = 'SMALL' THEN 'active' ELSE 'other' END AS status,
CASE WHEN p_size * 2 >= 70 THEN 'high' WHEN p_size * 2 >= 50 THEN 'middle' ELSE 'low' END AS score, round(least(greatest(0.003 * pow(2.0, 14 - p_size % 20), 0.0005), 0.5), 8) AS grid FROM part""")
def bucket_labels(spark, d):
    status = F.when(F.col("p_type") == "PROMO", "Sold home").when(F.col("p_type") == "LARGE", "Contingent").when(F.col("p_type") == "SMALL", "ACTIVE").otherwise("Coming soon")
    return table(spark, d, "part").select("p_partkey", S.status_bucket(status).alias("status"), S.score_bucket(F.col("p_size") * 2).alias("score"), F.round(S.grid_degrees(F.col("p_size") % 20), 8).alias("grid"))


_WORDS_SQL = "CASE t " + " ".join(f"WHEN '{w}' THEN {i}.0" for i, w in enumerate(S.NUMBER_WORDS)) + " END"


@query(f"""WITH t AS (SELECT o_orderkey, 'paid $' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' for three of ' || CAST(o_custkey AS VARCHAR) || ' at 5%' AS x FROM orders),
n AS (SELECT o_orderkey, list_concat(list_transform(regexp_extract_all(x, '-?\\$?\\d[\\d,]*\\.?\\d*%?'), lambda t: CAST(regexp_replace(t, '[$,%]', '', 'g') AS DOUBLE)),
list_filter(list_transform(regexp_extract_all(lower(x), '[a-z]+'), lambda t: CAST({_WORDS_SQL} AS DOUBLE)), lambda t: t IS NOT NULL)) AS found FROM t)
SELECT o_orderkey, len(found) AS n, round(list_sum(found), 2) AS total FROM n""")
def number_extract(spark, d):
    text = F.concat(F.lit("paid $"), S.money_text("o_totalprice"), F.lit(" for three of "), F.col("o_custkey").cast("string"), F.lit(" at 5%"))
    rows = table(spark, d, "orders").select("o_orderkey", S.numbers_in(text).alias("found"))
    return rows.select("o_orderkey", F.size("found").cast("bigint").alias("n"), F.round(F.aggregate("found", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


# retrieval

_ASKED = [round(((i * 37) % 64 - 32) / 32, 6) for i in range(64)]


def _cosine_sql(where: str) -> str:
    q = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in _ASKED) + "]"
    return f"""SELECT vec_id, score FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {q}), 6) AS score FROM embeddings {where}) ORDER BY score DESC, vec_id LIMIT 10"""


@query(_cosine_sql(""))
def cosine_topk(spark, d):
    return V.nearest(table(spark, d, "embeddings"), "embedding", _ASKED, 10, "vec_id").select("vec_id", "score")


@query(_cosine_sql("WHERE label = 3"))
def cosine_topk_filtered(spark, d):
    return V.nearest(table(spark, d, "embeddings"), "embedding", _ASKED, 10, "vec_id", F.col("label") == 3).select("vec_id", "score")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0)
SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS nth FROM s) WHERE nth <= 10""")
def cosine_topk_each(spark, d):
    """Asked by every vector whose id is divisible by 50."""
    items = table(spark, d, "embeddings")
    return V.nearest_each(items, "embedding", items.filter("vec_id % 50 = 0"), 10, "vec_id").select("query", "vec_id", "score")


def _through_index(spark, d, share: float):
    """Asked by every vector whose id is divisible by 50, through an index of all rows, probing a share of its lists."""
    items = table(spark, d, "embeddings")
    index = VectorIndex.build(items, "embedding", "vec_id", new_path(spark, "vectors"))
    return index.nearest_each(items.filter("vec_id % 50 = 0"), 10, max(1, round(share * len(index.centres)))).select("query", "vec_id", "score")


@query(ORACLE_SQL["cosine_topk_each"])
def cosine_index_all_lists(spark, d):
    """With every list probed the index is an exact search, whose searches never pass the driver."""
    return _through_index(spark, d, 1.0)


def cosine_index_topk(spark, d):
    """Six of ten lists. What SQL can't express is which rows the lists leave out; tests hold its recall to 0.9."""
    return _through_index(spark, d, 0.6)


QUERIES["cosine_index_topk"] = cosine_index_topk


@query("""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM benchmark), s AS (SELECT a.item_id AS query, b.item_id, count(*) AS score FROM w a JOIN w b USING (word) WHERE a.item_id % 50 = 0 GROUP BY 1, 2)
SELECT query, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS nth FROM s) WHERE nth <= 10""")
def lexical_topk_each(spark, d):
    """Asked by every item whose id is divisible by 50."""
    items = table(spark, d, "benchmark")
    return V.lexical_each(items, "text", items.filter("item_id % 50 = 0"), 10, "item_id").select("query", "item_id", "score")


_QUESTION, _PHRASES = "the onst of ering with that", ("of the", "to the")


@query(f"""WITH s AS (SELECT item_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), list_distinct(regexp_extract_all('{_QUESTION}', '[a-z0-9_]+'))))
+ CASE WHEN contains(lower(text), 'of the') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'to the') THEN 2 ELSE 0 END AS score FROM benchmark)
SELECT item_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, item_id LIMIT 10""")
def lexical_topk(spark, d):
    return V.lexical(table(spark, d, "benchmark"), "text", _QUESTION, _PHRASES, 10, "item_id").select("item_id", "score")


@query("""SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) OVER w AS BIGINT) AS spent, row_number() OVER w AS nth FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE spent <= 2000 OR nth = 1""")
def bounded_history(spark, d):
    return V.recent(table(spark, d, "conversations"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", F.col("spent").cast("bigint").alias("spent"))


@query("""WITH r AS (SELECT unnest([lang, source]) AS tag, quality FROM documents JOIN labels USING (doc_id)) SELECT tag, count(*) FILTER (WHERE quality = 1) AS passed, count(*) AS total FROM r GROUP BY 1""")
def tag_pass_rate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    marked = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"))
    return V.pass_rates(docs.join(marked, "doc_id"), "tags", "verdict")


@query("""WITH p AS (SELECT doc_id, instr(lower(text), 'the') AS a, instr(lower(text), 'of') AS b, instr(lower(text), 'zu ') AS z FROM documents)
SELECT doc_id, CASE WHEN a > 0 AND b > 0 AND a <= b AND z = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p""")
def ordered_evidence(spark, d):
    return table(spark, d, "documents").select("doc_id", V.verdict("text", ["the", "of"], ["zu "], ordered=True).alias("verdict"))


@query("""WITH t AS (SELECT event_id, [CAST(user_id AS DOUBLE), round(value, 2), 7.0] AS said, [round(value, 2), CAST(json_extract_string(props, '$.k') AS DOUBLE)] AS held FROM events),
u AS (SELECT event_id, list_distinct(said) AS said, held FROM t) SELECT event_id, round(len(list_filter(said, lambda x: NOT list_contains(held, x))) / len(said), 6) AS ungrounded FROM u""")
def grounding_ratio(spark, d):
    reply = F.concat_ws(" and ", F.col("user_id").cast("string"), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("seven"))
    evidence = F.concat_ws(" ", F.col("value").cast("decimal(18,2)").cast("string"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", F.round(V.ungrounded_share(reply, evidence), 6).alias("ungrounded"))


# change frames


@query("""WITH old AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS id, c_name || ' (new)' AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS balance FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0)
SELECT id, name, balance FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT n.id, n.name, coalesce(n.balance, o.balance) FROM new n LEFT JOIN old o ON n.id = o.id""")
def upsert_result(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = rows.filter("id % 5 = 0 or id % 3 = 0").select("id", F.concat("name", F.lit(" (new)")).alias("name"), F.when(F.col("id") % 2 == 0, F.col("balance") + 1).alias("balance"))
    return C.upsert(rows.filter("id % 3 <> 0"), new, ["id"], [F.col("name")], keep=["balance"])


@query("""WITH s AS (SELECT o_custkey, o_orderkey, substr(md5(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus), 1, 14) AS snapshot_id FROM orders), old AS (SELECT snapshot_id, min(o_orderkey) AS o_orderkey FROM s WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT * FROM old UNION ALL SELECT snapshot_id, min(o_orderkey) FROM s WHERE o_orderkey % 4 <> 0 AND snapshot_id NOT IN (SELECT snapshot_id FROM old) GROUP BY 1""")
def insert_ignore_result(spark, d):
    rows = table(spark, d, "orders").select(S.text_id(14, "o_custkey", "o_orderstatus").alias("snapshot_id"), "o_orderkey")
    old = R.latest_per_key(rows.filter("o_orderkey % 4 = 0"), ["snapshot_id"], [F.col("o_orderkey")])
    return C.insert_ignore(old, rows.filter("o_orderkey % 4 <> 0"), ["snapshot_id"], [F.col("o_orderkey")])


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#3' THEN NOT coalesce(f, FALSE) ELSE f END AS is_favorite FROM (SELECT p_partkey, p_brand, CASE WHEN p_size < 10 THEN TRUE WHEN p_size < 20 THEN FALSE END AS f FROM part)""")
def toggle_result(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") < 10, True).when(F.col("p_size") < 20, False).alias("is_favorite"))
    return C.toggle(rows, F.col("p_brand") == "Brand#3", "is_favorite").select("p_partkey", "is_favorite")


@query("""WITH m AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'X' || n_nationkey ELSE CAST(n_nationkey AS VARCHAR) END AS code, n_name FROM nation),
fix AS (SELECT 'X' || n_nationkey AS old, CASE WHEN n_nationkey % 8 = 0 THEN CAST(n_nationkey + 1 AS VARCHAR) ELSE 'R' || n_nationkey END AS new FROM nation WHERE n_nationkey % 4 = 0)
SELECT coalesce(f.new, m.code) AS code, m.n_name FROM m LEFT JOIN (SELECT * FROM fix WHERE new NOT IN (SELECT code FROM m)) f ON m.code = f.old""")
def rekey_result(spark, d):
    """A repair that would take a key that is in use is left out."""
    key = F.col("n_nationkey")
    n = table(spark, d, "nation")
    rows = n.select(F.when(key % 4 == 0, F.concat(F.lit("X"), key.cast("string"))).otherwise(key.cast("string")).alias("code"), "n_name")
    fix = n.filter(key % 4 == 0).select(F.concat(F.lit("X"), key.cast("string")).alias("old"), F.when(key % 8 == 0, (key + 1).cast("string")).otherwise(F.concat(F.lit("R"), key.cast("string"))).alias("new"))
    return C.rekey(rows, "code", fix, "old", "new")


@query("""WITH wide AS (SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS "F", sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS "O" FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'F' AS name, CAST("F" AS BIGINT) AS population FROM wide UNION ALL SELECT l_returnflag, 'O', CAST("O" AS BIGINT) FROM wide""")
def wide_to_long(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("F"), F.count_if(F.col("l_linestatus") == "O").alias("O"))
    return wide.unpivot("l_returnflag", ["F", "O"], "name", "population")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS z FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, z ORDER BY event_id) AS grp FROM e)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, count(*) AS n FROM g WHERE z = 1 GROUP BY user_id, grp) GROUP BY 1""")
def longest_streak(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("z"))
    runs = R.islands(rows, ["user_id"], [F.col("event_id")], "z").filter("z").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


@query("""SELECT md5(lang || ':' || substr(text, 1, 200)) AS id, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1""")
def document_ids(spark, d):
    return table(spark, d, "documents").groupBy(V.document_id("lang", "text").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, o_orderkey, round(o_totalprice - first_value(o_totalprice) OVER w, 2) AS since_first, count(*) OVER w AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def change_since_first(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.first("o_totalprice").over(w), 2).alias("since_first"), F.count(F.lit(1)).over(w).alias("nth"))


_TABLES = ("customer", "orders", "part", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, d):
    from .catalog import availability

    return availability(spark, {t: table(spark, d, t) for t in _TABLES}).select(F.col("table").alias("table_name"), F.col("rows").alias("n"))


@query("""WITH m AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || '--Río Grande, NM Metro Area' WHEN 1 THEN ' ' || p_name || '-' || p_brand || ',  NY-NJ micro area' ELSE p_name END AS x FROM part),
n AS (SELECT p_partkey, lower(strip_accents(trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '(?i)\\s+(Metro|Micro)\\s+Area$', ''), '-{2,}', '-', 'g'), '\\s+', ' ', 'g')))) AS norm FROM m),
p AS (SELECT p_partkey, norm, regexp_extract(norm, '^(.*),\\s*([a-z]{2}(?:-[a-z]{2})*)$', 1) AS c, regexp_extract(norm, '^(.*),\\s*([a-z]{2}(?:-[a-z]{2})*)$', 2) AS s FROM n)
SELECT p_partkey, norm, CASE WHEN s <> '' THEN trim(split_part(c, '-', 1)) ELSE norm END AS city, split_part(s, '-', 1) AS state FROM p""")
def metro_names(spark, d):
    size = F.col("p_size") % 3
    text = F.when(size == 0, F.concat("p_name", F.lit("--Río Grande, NM Metro Area"))).when(size == 1, F.concat(F.lit(" "), "p_name", F.lit("-"), "p_brand", F.lit(",  NY-NJ micro area"))).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", N.metro(text).alias("norm"))
    return rows.select("p_partkey", "norm", N.first_city("norm").alias("city"), N.first_state("norm").alias("state"))
