"""Registered queries: scans, filters, joins, aggregates and ranking, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c) -> F.Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(S.col(c).cast("decimal(18,2)")).cast("double")


def mean(c) -> F.Column:
    """The exact sum over the count: neither the order of the rows nor rounding of ties decides a digit."""
    return money(c) / F.count(S.col(c))


# scans, filters, projections


@query("SELECT c_custkey AS entity_id, substr(c_name, 1, 12) AS short_name, upper(c_mktsegment) AS segment FROM customer")
def scan_project_alias(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.substring("c_name", 1, 12).alias("short_name"), F.upper("c_mktsegment").alias("segment"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05")
def filter_bbox(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_quantity").between(10.0, 20.0) & F.col("l_discount").between(0.02, 0.05))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT l_orderkey, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_ship, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_ship
FROM lineitem GROUP BY l_orderkey HAVING min(l_shipdate) <= TIMESTAMP '1997-03-10' AND max(l_shipdate) >= TIMESTAMP '1997-03-01'""")
def filter_overlap(spark, d):
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    hits = spans.filter("a <= timestamp_ntz'1997-03-10' and b >= timestamp_ntz'1997-03-01'")
    return hits.select("l_orderkey", F.col("a").cast("date").cast("string").alias("first_ship"), F.col("b").cast("date").cast("string").alias("last_ship"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE CASE o_orderstatus WHEN 'O' THEN TRUE WHEN 'F' THEN FALSE END IS NOT FALSE")
def filter_tristate(spark, d):
    flag = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
    return table(spark, d, "orders").filter(S.is_true_or_null(flag)).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand IN ('Brand#3', 'Brand#7', 'Brand#12') AND p_size <> 5")
def filter_in_list(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand").isin("Brand#3", "Brand#7", "Brand#12") & (F.col("p_size") != 5)).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%') AND p_type NOT LIKE 'S%'")
def filter_like_chain(spark, d):
    name = F.lower("p_name")
    return table(spark, d, "part").filter((name.contains("ring") | name.contains("bolt")) & ~F.col("p_type").startswith("S")).select("p_partkey", "p_name")


@query("""SELECT c.c_custkey, c.c_name, c.c_nationkey, coalesce(o.o_totalprice, c.c_acctbal) AS price, coalesce(o.o_orderstatus, c.c_mktsegment) AS status
FROM customer c LEFT JOIN (SELECT DISTINCT ON (o_custkey) o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) o ON c.c_custkey = o.o_custkey""")
def exclude_override(spark, d):
    newest = R.latest_per_key(table(spark, d, "orders").filter("o_orderstatus = 'F'"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    rows = table(spark, d, "customer").join(newest.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderstatus"), "c_custkey", "left")
    rows = rows.withColumns({"price": F.coalesce("o_totalprice", "c_acctbal"), "status": F.coalesce("o_orderstatus", "c_mktsegment")})
    return rows.drop("c_acctbal", "c_mktsegment", "o_totalprice", "o_orderstatus")


_PROFILED = ("value", "k", "late_value")


@query("""WITH e AS (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_type = 'purchase' THEN value END AS late_value FROM events)
SELECT 'value' AS column_name, count(*) AS total, count(value) AS non_null, count(*) - count(value) AS missing, round(avg(value), 6) AS mean FROM e
UNION ALL SELECT 'k', count(*), count(k), count(*) - count(k), round(avg(k), 6) FROM e
UNION ALL SELECT 'late_value', count(*), count(late_value), count(*) - count(late_value), round(avg(late_value), 6) FROM e""")
def null_profile(spark, d):
    rows = table(spark, d, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("late_value"))
    return R.null_profile(rows, _PROFILED).withColumn("mean", F.round("mean", 6))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_extract_group(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# joins


@query("""SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_orderstatus, n.n_name, r.r_name FROM customer c
LEFT JOIN (SELECT DISTINCT ON (o_custkey) * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) o ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def left_chain_enrich(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    newest = R.latest_per_key(urgent, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    rows = table(spark, d, "customer").join(newest, "c_custkey", "left").join(n, "c_nationkey", "left").join(r, "n_regionkey", "left")
    return rows.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus", "n_name", "r_name")


@query("""WITH bridge AS (SELECT r_name, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS state, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county FROM region JOIN nation ON r_regionkey = n_regionkey),
tract AS (SELECT c_acctbal, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county_fips FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT r_name AS metro, count(*) AS tracts, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS mean_risk FROM bridge JOIN tract ON state || county = county_fips GROUP BY r_name""")
def bridge_concat_key(spark, d):
    n = table(spark, d, "nation")
    bridge = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", S.zero_pad("n_regionkey", 2).alias("state"), S.zero_pad("n_nationkey", 3).alias("county"))
    tract = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_acctbal", F.concat(S.zero_pad("n_regionkey", 2), S.zero_pad("n_nationkey", 3)).alias("county_fips"))
    return bridge.join(tract, F.concat("state", "county") == F.col("county_fips")).groupBy(F.col("r_name").alias("metro")).agg(F.count(F.lit(1)).alias("tracts"), mean("c_acctbal").alias("mean_risk"))


@query("""SELECT p_partkey, CASE WHEN k IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status FROM part
LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R') ON p_partkey = k""")
def unmatched_left(spark, d):
    hits = table(spark, d, "lineitem").filter("l_quantity > 45 and l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct()
    return table(spark, d, "part").join(hits, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.when(F.col("k").isNull(), "unmatched").otherwise("matched").alias("match_status"))


@query("""SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > 1000 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey
AND CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) >= CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AND l.l_returnflag = 'A' AND l.l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10))""")
def anti_nested_in(spark, d):
    part = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'A'").join(part, "l_partkey", "left_semi")
    as_text = lambda c: F.col(c).cast("date").cast("string")
    orders = table(spark, d, "orders").filter("o_totalprice > 1000")
    return orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (as_text("l_shipdate") >= as_text("o_orderdate")), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_join_attr(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH want AS (SELECT p_partkey AS sale, p_name AS name, p_brand AS brand, p_type AS type FROM part WHERE p_partkey % 3 = 0),
have AS (SELECT p_partkey AS house, p_name AS name, p_brand AS brand, p_type AS type FROM part WHERE p_partkey % 3 <> 0),
t1 AS (SELECT name, brand, type, min(house) AS h FROM have GROUP BY ALL), t2 AS (SELECT name, brand, min(house) AS h FROM have GROUP BY ALL), t3 AS (SELECT name, type, min(house) AS h FROM have GROUP BY ALL)
SELECT sale, coalesce(t1.h, t2.h, t3.h) AS house, CASE WHEN t1.h IS NOT NULL THEN 1 WHEN t2.h IS NOT NULL THEN 2 WHEN t3.h IS NOT NULL THEN 3 END AS tier FROM want w
LEFT JOIN t1 ON t1.name = w.name AND t1.brand = w.brand AND t1.type = w.type LEFT JOIN t2 ON t2.name = w.name AND t2.brand = w.brand LEFT JOIN t3 ON t3.name = w.name AND t3.type = w.type""")
def tiered_match(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "p_size")
    want = rows.filter("p_partkey % 3 = 0").withColumnRenamed("p_partkey", "sale")
    have = rows.filter("p_partkey % 3 != 0").withColumnRenamed("p_partkey", "house")
    return R.tiered_match(want, have, [("name", "brand", "type"), ("name", "brand"), ("name", "type")], "house", [F.col("house")]).select("sale", "house", "tier")


@query("""WITH a AS (SELECT p_partkey, p_type, p_brand, string_split(p_name, ' ') AS w FROM part), b AS (SELECT p_partkey AS other, p_type, p_brand, string_split(p_name, ' ') AS v FROM part),
pairs AS (SELECT p_partkey, other, len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) AS score FROM a JOIN b USING (p_type, p_brand) WHERE p_partkey <> other)
SELECT p_partkey, other, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS nth FROM pairs WHERE score >= 0.3) WHERE nth = 1""")
def fuzzy_block_best(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", S.words("p_name").alias("w"))
    other = rows.withColumnRenamed("p_partkey", "other")
    best = R.most_similar(rows, other, ["p_type", "p_brand"], "p_partkey", "other", "w", 0.3, S.jaccard)
    return best.select("p_partkey", "other", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT p_partkey, p_type, p_brand, string_split(p_name, ' ') AS w FROM part), b AS (SELECT p_partkey AS other, p_type, p_brand, string_split(p_name, ' ') AS v FROM part),
pairs AS (SELECT p_partkey, other, len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) AS score FROM a JOIN b USING (p_type, p_brand) WHERE p_partkey < other)
SELECT p_partkey, other, round(score, 6) AS score FROM pairs WHERE score >= 0.5""")
def jaccard_pairs(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", S.words("p_name").alias("w"))
    pairs = R.similar_pairs(rows, rows.withColumnRenamed("p_partkey", "other"), ["p_type", "p_brand"], "p_partkey", "other", "w", 0.5, S.jaccard)
    return pairs.filter("p_partkey < other").withColumn("score", F.round("score", 6))


@query("""SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id
AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def range_bucket_join(spark, d):
    """Pairs within an hour meet in the hour's bucket or the next, so the join is on equal keys."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hour = 3_600_000_000
    bucket = F.floor(F.col("us") / hour).cast("bigint")
    a = e.filter("event_type = 'view'").select(F.col("event_id").alias("first_id"), "user_id", F.col("us").alias("a"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("second_id"), "user_id", F.col("us").alias("b"), bucket.alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).filter(f"second_id > first_id and b >= a and b <= a + {hour}").select("first_id", "second_id")


@query("""WITH o AS (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT n_name, coalesce(orders, 0) AS orders, coalesce(suppliers, 0) AS suppliers FROM nation LEFT JOIN o ON o.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def fanout_preaggregate(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("orders"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return table(spark, d, "nation").join(o, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT p_partkey, coalesce(CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'low' WHEN 'LARGE' THEN 'high' END, 'middle') AS tier FROM part""")
def value_map(spark, d):
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("ECONOMY", "low", "PROMO", "low", "LARGE", "high"))), F.col("p_type")), F.lit("middle")).alias("tier"))


@query("""WITH cache AS (SELECT DISTINCT md5(p_name) AS k FROM part WHERE p_size <= 10)
SELECT p_partkey, 'hit' AS found FROM part WHERE md5(p_name) IN (SELECT k FROM cache) UNION ALL SELECT p_partkey, 'miss' FROM part WHERE md5(p_name) NOT IN (SELECT k FROM cache)""")
def cache_hits_misses(spark, d):
    part = table(spark, d, "part").withColumn("k", F.md5("p_name"))
    cache = part.filter("p_size <= 10").select("k", F.lit(True).alias("cached")).distinct()
    return part.join(cache, "k", "left").select("p_partkey", F.when(F.col("cached"), "hit").otherwise("miss").alias("found"))


# aggregates


@query("""SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_discount > 0.05 THEN l_discount END) AS discounted, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def count_family(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_discount") > 0.05, F.col("l_discount"))).alias("discounted"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("""SELECT o_orderpriority, round(median(o_totalprice), 4) AS median_price, round(median(o_totalprice / nullif(o_custkey % 10, 0)), 6) AS median_ratio, min(o_totalprice) AS low, max(o_totalprice) AS high,
count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1""")
def median_stats(spark, d):
    ratio = F.col("o_totalprice") / F.nullif(F.col("o_custkey") % 10, F.lit(0))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("median_price"), F.round(F.median(ratio), 6).alias("median_ratio"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("""SELECT * FROM (SELECT count(*) AS list_count, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS list_mean, min(c_acctbal) AS list_low, max(c_acctbal) AS list_high, round(median(c_acctbal), 4) AS list_median FROM customer WHERE c_acctbal > 0),
(SELECT count(*) AS sold_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS sold_mean, round(median(o_totalprice / nullif(o_custkey % 7, 0)), 6) AS sold_median_unit FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'F')""")
def price_stats_merge(spark, d):
    """Two tables of one row side by side."""
    a = table(spark, d, "customer").filter("c_acctbal > 0").agg(F.count(F.lit(1)).alias("list_count"), mean("c_acctbal").alias("list_mean"), F.min("c_acctbal").alias("list_low"), F.max("c_acctbal").alias("list_high"), F.round(F.median("c_acctbal"), 4).alias("list_median"))
    unit = F.col("o_totalprice") / F.nullif(F.col("o_custkey") % 7, F.lit(0))
    b = table(spark, d, "orders").filter("o_totalprice > 1000 and o_orderstatus <> 'F'").agg(F.count(F.lit(1)).alias("sold_count"), mean("o_totalprice").alias("sold_mean"), F.round(F.median(unit), 6).alias("sold_median_unit"))
    return a.join(F.broadcast(b))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2")
def group_two_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("price"))


@query("""WITH universe AS (SELECT n_nationkey, n_name, count(*) AS population FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY population DESC, n_name LIMIT 20),
measured AS (SELECT u.n_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS metric_value FROM universe u JOIN customer ON c_nationkey = u.n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice IS NOT NULL GROUP BY 1)
SELECT u.n_name AS metro, u.population, m.metric_value FROM universe u JOIN measured m USING (n_nationkey) ORDER BY metric_value, metro LIMIT 10""")
def universe_then_metric(spark, d):
    """The flagship: rank the largest metros by a metric of their finest-grained facts."""
    customer = table(spark, d, "customer")
    size = table(spark, d, "nation").join(customer, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_nationkey", F.col("n_name").alias("metro")).agg(F.count(F.lit(1)).alias("population"))
    bridge = customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("o_custkey"))
    facts = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    found = R.universe_then_metric(size, 20, [F.col("population").desc(), F.col("metro")], bridge, "n_nationkey", facts, "o_custkey", "n_nationkey", mean("o_totalprice"), [F.col("metric_value"), F.col("metro")])
    return found.select("metro", "population", "metric_value")


@query("""SELECT n_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS mean_balance, round(median(c_acctbal), 4) AS median_balance FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY customers DESC, n_name LIMIT 15""")
def top_entities_with_stats(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name")
    return rows.agg(F.count(F.lit(1)).alias("customers"), mean("c_acctbal").alias("mean_balance"), F.round(F.median("c_acctbal"), 4).alias("median_balance")).orderBy(F.col("customers").desc(), "n_name").limit(15)


@query("""WITH a AS (SELECT r_regionkey, r_name, count(*) AS population FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
b AS (SELECT n_regionkey AS r_regionkey, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(s_acctbal) AS risk FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1) SELECT r_name, population, risk FROM a JOIN b USING (r_regionkey)""")
def tradeoff_two_metrics(spark, d):
    n = table(spark, d, "nation")
    a = n.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("population"))
    b = n.join(table(spark, d, "supplier").filter("s_acctbal > 0"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(mean("s_acctbal").alias("risk"))
    return table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey").join(a, "n_regionkey").join(b, "n_regionkey").select("r_name", "population", "risk")


@query("SELECT strftime(l_shipdate, '%Y-%m') AS year_month, l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2")
def month_trend(spark, d):
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("year_month"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("weight"))


@query("""SELECT l_returnflag AS category, CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS volume, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS severity FROM lineitem GROUP BY 1, 2""")
def severity_vs_volume(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("category"), F.year("l_shipdate").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("volume"), money("l_quantity").alias("severity"))


@query("""WITH c AS (SELECT p_name, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%bolt%' THEN 'bolt' ELSE 'other' END AS category FROM part),
top AS (SELECT p_name, count(*) AS n FROM c WHERE category = 'other' GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10) SELECT p_name, n, (SELECT round(avg(CASE WHEN category = 'other' THEN 1.0 ELSE 0.0 END), 6) FROM c) AS share FROM top""")
def share_other(spark, d):
    category = F.when(F.col("p_name").contains("ring"), "ring").when(F.col("p_name").contains("bolt"), "bolt").otherwise("other")
    rows = table(spark, d, "part").select("p_name", category.alias("category"))
    share = rows.agg(F.round(F.avg(F.when(F.col("category") == "other", 1.0).otherwise(0.0)), 6).alias("share"))
    top = rows.filter("category = 'other'").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "p_name").limit(10)
    return top.join(F.broadcast(share))


@query("""SELECT p_brand, max_by(p_type, struct_pack(a := weight, b := p_type)) AS category, CAST(max(weight) AS DOUBLE) AS weight FROM (SELECT p_brand, p_type, sum(p_size) AS weight FROM part GROUP BY 1, 2) GROUP BY 1""")
def argmax_category(spark, d):
    weights = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("weight"))
    return weights.groupBy("p_brand").agg(F.max(F.struct("weight", "p_type")).alias("m")).select("p_brand", F.col("m.p_type").alias("category"), F.col("m.weight").cast("double").alias("weight"))


# ordering, ranking, sets

@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey DESC")
def latest_per_key(spark, d):
    return R.latest_per_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS metric, unnest([l_quantity / 50, l_discount * 10, l_tax * 12]) AS value FROM lineitem)
SELECT l_orderkey, l_linenumber, metric, round(value, 6) AS value, nth FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY value DESC, metric, l_linenumber, value) AS nth FROM m WHERE value > 0) WHERE nth <= 5""")
def topk_per_entity(spark, d):
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in (("quantity", F.col("l_quantity") / 50), ("discount", F.col("l_discount") * 10), ("tax", F.col("l_tax") * 12))])
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(pairs).alias("p")).select("l_orderkey", "l_linenumber", "p.*").filter("value > 0")
    return R.top_per_key(rows, ["l_orderkey"], [F.col("value").desc(), F.col("metric"), F.col("l_linenumber"), F.col("value")], 5, "nth").withColumn("value", F.round("value", 6)).withColumn("nth", F.col("nth").cast("bigint"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey), 2) AS change FROM orders""")
def history_desc_nulls_last(spark, d):
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").asc_nulls_first(), "o_orderkey"))
    rows = table(spark, d, "orders").withColumn("change", F.round(F.col("o_totalprice") - before, 2))
    return rows.select("o_custkey", "o_orderkey", "o_totalprice", "change")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <> 7 ORDER BY abs(o_totalprice - coalesce(250000.0, o_totalprice)), o_orderkey LIMIT 8")
def nearest_by_value(spark, d):
    return table(spark, d, "orders").filter("o_orderkey <> 7").orderBy(F.abs(F.col("o_totalprice") - 250000.0), "o_orderkey").limit(8).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) > 100 FROM orders WHERE o_totalprice > 300000) AS truncated FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def cap_with_truncated_flag(spark, d):
    rows, more = R.capped(table(spark, d, "orders").filter("o_totalprice > 300000"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)
    return rows.select("o_orderkey", "o_totalprice", F.lit(more).alias("truncated"))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def dedupe_first(spark, d):
    return R.latest_per_key(table(spark, d, "part"), ["p_name"], [F.col("p_partkey")]).select("p_name", "p_partkey")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_by_name(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return R.align(R.union_all(a, b), {"id": "bigint", "name": "string", "balance": "double", "segment": "string"})
