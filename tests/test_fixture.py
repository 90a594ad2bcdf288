"""A small world with known answers: four metros, six houses, six sales."""

import datetime

import pytest
from pyspark.sql import functions as F

from terrasift.functions import scalar as S
from terrasift.operators import changes, homes, retrieval
from terrasift.operators.relational import align
from terrasift.plans import answers, catalog, readonly
from terrasift.sources import property as P
from terrasift.sources.schema import SCHEMAS

METROS = [("Pittsburgh", "PA", "42", "003", "38300", "42003140300", 2370930, 4200, 45.2, 12.5, 3.1, 8.0), ("Denver", "CO", "08", "031", "19740", "08031002500", 2963821, 5100, 38.0, 25.0, 1.0, 22.0), ("Miami", "FL", "12", "086", "33100", "12086001100", 6091747, 6300, 72.5, 68.0, 55.0, 5.0), ("Austin", "TX", "48", "453", "12420", "48453001700", 2295303, 3900, 30.1, 15.2, 2.0, 30.0)]
HOUSES = [("h1", "Pittsburgh", 82, 350000.0, "Active", True), ("h2", "Pittsburgh", 45, 275000.0, "Active", True), ("h3", "Denver", 70, 525000.0, "Active", True), ("h4", "Miami", 90, 610000.0, "Pending", True), ("h5", "Austin", 55, 430000.0, "Active", True), ("h6", "Austin", None, 399000.0, "Sold", False)]
SALES = [("s1", "Pittsburgh", 340000.0, True, "success"), ("s2", "Pittsburgh", 1.0, False, "success"), ("s3", "Denver", 510000.0, True, "success"), ("s4", "Miami", 590000.0, None, "success"), ("s5", "Austin", 415000.0, True, "success"), ("s6", None, 250000.0, True, "pending")]


@pytest.fixture(scope="module")
def world(spark):
    tract = {m[0]: m[5] for m in METROS}
    make = lambda rows, name, schema: align(spark.createDataFrame(rows, schema), SCHEMAS[name])
    w = {
        "census_msa": make([(m[4], f"{m[0]}, {m[1]} Metro Area", m[6]) for m in METROS] + [("Xplaceholder1", "Sample Micro Area", 15000)], "census_msa", "msa_code string, name string, population int"),
        "cbsa_counties": make([(m[4], f"{m[0]}, {m[1]}", m[2], m[3]) for m in METROS], "cbsa_counties", "cbsa_code string, cbsa_title string, state_fips string, county_fips string"),
        "nri_tracts": make([(m[5], m[2] + m[3], m[2], m[8], m[9], m[10], m[11]) for m in METROS], "nri_tracts", "tract_fips string, county_fips string, state_fips string, risk_score double, rfld_risks double, hrcn_risks double, wfir_risks double"),
        "census_tracts": make([(m[5], m[7]) for m in METROS], "census_tracts", "tract_fips string, population int"),
        "houses": make([(h[0], f"{i + 1} Main Street", h[1], "15213", h[2], h[3], h[4], h[5], tract[h[1]], 1500.0) for i, h in enumerate(HOUSES)], "houses", "house_id string, address string, city string, zip string, walk_score int, price double, status string, is_favorite boolean, tract_fips string, sqft double"),
        "sold_homes": make([(s[0], f"{i + 1} Main St", s[1] or "Austin", "15213", s[2], s[3], s[4], tract.get(s[1]), datetime.date(2024, 6, 1), 1500.0) for i, s in enumerate(SALES)], "sold_homes", "sale_id string, address string, city string, zip string, sold_price double, is_arms_length boolean, geocode_status string, tract_fips string, sold_date date, sqft double"),
        "house_snapshots": make([("a", "h1", datetime.date(2024, 1, 1), "redfin", "Active", 360000.0), ("b", "h1", datetime.date(2024, 3, 1), "redfin", "Active", 350000.0), ("c", "h2", None, "redfin", "Active", 1.0)], "house_snapshots", "snapshot_id string, house_id string, snapshot_date date, source_type string, status string, price double"),
        "crime_incidents": make([], "crime_incidents", "incident_id string"),
        "bike_routes": make([], "bike_routes", "route_id string"),
    }
    for name, df in w.items():
        df.createOrReplaceTempView(name)
    return w


def first(df, c):
    return [r[c].split(",")[0].split(" ")[0] for r in df.collect()]


def risk(w, metric, **k):
    return answers.metro_risk(w["census_msa"], w["cbsa_counties"], w["nri_tracts"], metric, universe=50, **k)


def test_counts_and_prices(world):
    h = world["houses"]
    r = h.agg(F.sum("price"), F.avg("price"), F.median("price"), F.avg("walk_score"), F.max("walk_score"), F.min("walk_score"), F.count("walk_score")).first()
    assert tuple(r) == (2589000, 431500, 414500, 68.4, 90, 45, 5)
    assert {r["status"]: r["count"] for r in h.groupBy("status").count().collect()} == {"Active": 4, "Sold": 1, "Pending": 1}
    assert [r["city"] for r in h.groupBy("city").agg(F.avg("price").alias("p")).orderBy(F.desc("p")).collect()] == ["Miami", "Denver", "Austin", "Pittsburgh"]


def test_average_walk_score_ignores_nulls(world):
    assert answers.average_walk_score(world["houses"], "Austin").first()[0] == 55.0
    assert answers.average_walk_score(world["houses"], "pittsburgh").first()[0] == 63.5


def test_metro_rankings(world):
    assert first(answers.metro_population(world["census_msa"], ["pittsburgh", "denver", "miami", "austin"]), "msa_name") == ["Miami", "Denver", "Pittsburgh", "Austin"]
    assert first(risk(world, "rfld_risks", highest=True), "msa_name") == ["Miami", "Denver", "Austin", "Pittsburgh"]
    assert first(risk(world, "risk_score", highest=True), "msa_name") == ["Miami", "Pittsburgh", "Denver", "Austin"]
    assert first(risk(world, "hrcn_risks", highest=True), "msa_name") == ["Miami", "Pittsburgh", "Austin", "Denver"]
    assert first(risk(world, "wfir_risks", highest=True), "msa_name") == ["Austin", "Denver", "Pittsburgh", "Miami"]
    assert risk(world, "rfld_risks").agg(F.round(F.avg("metric_value"), 3)).first()[0] == 30.175
    two = answers.metro_risk(world["census_msa"], world["cbsa_counties"], world["nri_tracts"], "risk_score", universe=2)
    assert first(two, "msa_name") == ["Denver", "Miami"]  # the two largest, then by risk
    assert {r["msa_name"].split(",")[0]: r["riverine_flood_risk"] for r in answers.metro_tradeoff(world["census_msa"], world["cbsa_counties"], world["nri_tracts"], ["miami", "pittsburgh"]).collect()} == {"Miami": 68.0, "Pittsburgh": 12.5}


def test_unmatched_metros(world):
    rows = answers.unmatched_metros(world["census_msa"], world["cbsa_counties"]).collect()
    assert [(r["msa_code"], r["match_status"]) for r in rows] == [("Xplaceholder1", "No CBSA/county match found")]
    assert homes.placeholder_repairs(world["census_msa"], world["cbsa_counties"]).count() == 0
    steps = {r["step"]: r["n"] for r in answers.join_report(world["census_msa"], world["cbsa_counties"], world["nri_tracts"]).collect()}
    assert steps["metros"] == 5 and steps["metros with tracts"] == 4


def test_sales_at_market(world):
    s = world["sold_homes"].filter(S.is_true_or_null("is_arms_length") & (F.col("sold_price") > 1000))
    assert s.agg(F.avg("sold_price")).first()[0] == 421000
    r = homes.price_stats(world["houses"], world["sold_homes"], "42003140300").first()
    assert (r["list_count"], r["sold_count"], r["sold_avg_price"], r["excluded_count"]) == (2, 1, 340000, 0)
    assert [x["sale_id"] for x in homes.sold_in_tract(world["sold_homes"], "12086001100").collect()] == ["s4"]  # unknown counts as at market


def test_enriched_takes_the_newest_dated_snapshot(world):
    rows = {r["house_id"]: r for r in homes.enriched(world["houses"], world["house_snapshots"], world["nri_tracts"], world["census_tracts"]).collect()}
    assert rows["h1"]["price"] == 350000 and rows["h2"]["price"] == 275000 and rows["h1"]["risk_score"] == 45.2 and rows["h1"]["tract_population"] == 4200
    assert [r["snapshot_id"] for r in homes.history(world["house_snapshots"], "h1").collect()] == ["b", "a"]


def test_sales_match_houses(world):
    rows = {r["sale_id"]: (r["house_id"], r["tier"]) for r in homes.match_sales(world["sold_homes"], world["houses"], world["house_snapshots"]).collect()}
    assert rows["s1"] == ("h1", 1) and rows["s5"] == ("h5", 1)
    made = homes.sold_snapshots(homes.match_sales(world["sold_homes"], world["houses"], world["house_snapshots"]))
    assert made.filter("source_type = 'sold'").count() == len(rows)


def test_metro_codes(spark, world):
    m = spark.createDataFrame([("Pittsburgh, PA Metro Area",), ("Denver-Aurora, CO",), ("Nowhere, ZZ",)], "name string")
    rows = {r["name"]: (r["cbsa_code"], r["tier"]) for r in homes.match_metros(m, world["cbsa_counties"]).collect()}
    assert rows == {"Pittsburgh, PA Metro Area": ("38300", 1), "Denver-Aurora, CO": ("19740", 2), "Nowhere, ZZ": (None, None)}
    coded = homes.coded_metros(m.withColumns({"msa_code": F.lit(None).cast("string"), "geo_id": F.lit(None).cast("string"), "population": F.lit(1)}), world["cbsa_counties"])
    assert sum(r["msa_code"].startswith("X") for r in coded.collect()) == 1


def test_renamed_metros_and_candidates(spark):
    counties = spark.createDataFrame([("19430", "Dayton-Kettering-Beavercreek, OH"), ("99991", "Fort Johnson, LA"), ("11111", "Green Valley Springs, OH"), ("22222", "Green Valley, KY")], "cbsa_code string, cbsa_title string")
    metros = spark.createDataFrame([("Dayton, OH Metro Area",), ("Fort Polk South, LA Micro Area",), ("Old Green Valley Lakes, OH Micro Area",), (None,)], "name string")
    found = {r["name"]: (r["cbsa_code"], r["tier"]) for r in homes.match_metros(metros, counties).collect()}
    assert found == {"Dayton, OH Metro Area": ("19430", 2), "Fort Polk South, LA Micro Area": ("99991", 4), "Old Green Valley Lakes, OH Micro Area": (None, None), None: (None, None)}
    # the new name itself is gone, its first city and state are still there
    moved = spark.createDataFrame([("99992", "Fort Johnson-Leesville, LA")], "cbsa_code string, cbsa_title string")
    assert [(r["cbsa_code"], r["tier"]) for r in homes.match_metros(metros.filter("name like 'Fort%'"), moved).collect()] == [("99992", 4)]
    told = [(r["name"], r["nth"], r["cbsa_code"]) for r in homes.metro_candidates(metros, counties).collect()]
    assert told == [("Old Green Valley Lakes, OH Micro Area", 1, "11111")]


def test_top_hazards(world):
    rows = homes.top_hazards(world["nri_tracts"].filter("county_fips = '12086'")).collect()
    assert [(r["hazard"], r["nth"]) for r in sorted(rows, key=lambda r: r["nth"])] == [("Riverine Flooding", 1), ("Hurricane", 2), ("Wildfire", 3)]


def test_only_queries_over_visible_tables(spark, world):
    ok = "```sql\nWITH a AS (SELECT city FROM houses), b AS (SELECT * FROM a) SELECT city, extract(year FROM current_date()) AS y, 'DROP TABLE x' AS t FROM b WHERE city IN (SELECT city FROM sold_homes);\n```"
    assert readonly.checked(spark, ok)[1] == {"houses", "sold_homes"}
    assert readonly.run(spark, "SELECT count(*) AS n FROM houses").first()[0] == 6
    for bad in ("", "DROP TABLE houses", "SELECT 1", "SELECT * FROM geocode_cache", "SELECT * FROM houses; SELECT * FROM houses", "INSERT INTO houses SELECT * FROM houses", "SELECT * FROM houses WHERE city = (SELECT max(address_key) FROM geocode_cache)", "WITH houses2 AS (SELECT * FROM nope) SELECT * FROM houses2", "SELECT * FROM (SELECT TRANSFORM(address) USING 'id' AS (x string) FROM houses) t", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM houses", "SELECT city FROM houses WHERE upper(java_method('java.lang.System', 'getProperty', 'user.home')) = 'A'", "WITH a AS (SELECT TRANSFORM(city) USING 'id' AS (x string) FROM houses) SELECT * FROM a", "SELECT * FROM houses WHERE city IN (SELECT reflect('java.lang.System', 'lineSeparator') FROM houses)", "SELECT * FROM read_files('/etc/passwd'), houses", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') x FROM houses", "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'lineSeparator') FROM houses", "SELECT city FROM houses ORDER BY IDENTIFIER('java_method')('java.lang.System', 'lineSeparator')", "SELECT * FROM IDENTIFIER('hou' || 'ses')", "SELECT IDENTIFIER('city') FROM houses"):
        with pytest.raises(readonly.NotAllowed):
            readonly.checked(spark, bad)
    for good in (
        "SELECT city, count(*) FILTER (WHERE price > 1.5e5) AS n, avg(price) OVER (PARTITION BY city ORDER BY price DESC NULLS LAST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) a FROM houses GROUP BY city, price HAVING count(*) >= 1 ORDER BY 1 LIMIT 3",
        "SELECT CASE WHEN beds BETWEEN 1 AND 3 THEN 'a' ELSE 'b' END k, CAST(price AS int) / 2, -price, price % 7, TRY_CAST(city AS int), city || '!' FROM houses WHERE city LIKE 'P%' AND NOT (beds IS NULL OR beds <=> 3) AND city NOT IN ('x') AND city ILIKE ANY ('a%', 'b%')",
        "SELECT h.city, (SELECT max(risk_score) FROM nri_tracts t WHERE t.tract_fips = h.tract_fips) m FROM houses h WHERE EXISTS (SELECT 1 FROM sold_homes s WHERE s.city = h.city) AND h.price > ?",
        "SELECT upper(trim(BOTH ' ' FROM city)), substring(city FROM 2 FOR 3), extract(year FROM current_date()), current_date, DATE '2024-01-01' + INTERVAL 1 DAY FROM houses GROUP BY ALL",
        "SELECT city, sum(price) FROM houses GROUP BY ROLLUP (city)", "SELECT * EXCEPT (city) FROM houses", "SELECT count(DISTINCT city) FROM houses UNION ALL SELECT 1 FROM sold_homes",
    ):
        assert readonly.checked(spark, good)[1] <= {"houses", "sold_homes", "nri_tracts"}
    asked = readonly.run(spark, "SELECT house_id FROM houses WHERE house_id = :id OR house_id = :other ORDER BY 1", args={"id": "h2", "other": "x' OR '1' = '1"})
    assert [r["house_id"] for r in asked.collect()] == ["h2"]
    assert "Empty tables: crime_incidents" in readonly.why_empty(spark, {"houses", "crime_incidents"})
    assert catalog.columns_for("which houses have the best walk score")[0][1] == "houses.walk_score"
    found = retrieval.lexical(catalog.documents(spark), "text", "flood risk of metro tracts", ["flood risk"], 3, "id").collect()
    assert found[0]["id"] == "term:nri_riverine_flood_risk"


def test_upserts(spark, tmp_path, world):
    store = changes.TableStore(spark, str(tmp_path))
    store.upsert("houses", world["houses"], ["house_id"])
    new = world["houses"].filter("house_id = 'h1'").withColumns({"price": F.lit(1.0), "is_favorite": F.lit(None).cast("boolean")})
    rows = {r["house_id"]: r for r in store.upsert("houses", new, ["house_id"], [F.col("price")], keep=["is_favorite"]).collect()}
    assert len(rows) == 6 and rows["h1"]["price"] == 1.0 and rows["h1"]["is_favorite"] is True
    shots = P.snapshots(world["houses"].withColumn("snapshot_date", F.lit(None).cast("date")))
    assert store.insert_ignore("s", shots, ["snapshot_id"]).count() == store.insert_ignore("s", shots, ["snapshot_id"]).count() == 6
    flipped = changes.toggle(world["houses"], F.col("house_id") == "h6", "is_favorite").filter("house_id = 'h6'").first()
    assert flipped["is_favorite"] is True


def test_documents(spark):
    store = retrieval.add_documents(spark.createDataFrame([], "entity string, doc_type string, text string, id string"), spark.createDataFrame([("h1", "note", "a"), ("h1", "note", "a"), ("h2", "description", "b")], "entity string, doc_type string, text string"))
    assert store.count() == 2
    after = retrieval.replace_documents(store, spark.createDataFrame([("h2", "description", "c")], "entity string, doc_type string, text string"), "description")
    assert sorted(r["text"] for r in after.collect()) == ["a", "c"]


def test_coverage_and_rendering(world):
    got = {r["measure"]: r["value"] for r in homes.coverage({k: world[k] for k in ("houses", "sold_homes")}).collect()}
    assert got["houses rows"] == 6 and got["sales off market"] == 1 and got["sales at market"] == 5 and round(got["share of sales with a tract"], 4) == round(5 / 6, 4)
    text = catalog.rendered(["houses"])
    assert "raw_json" not in text and "houses.tract_fips = nri_tracts.tract_fips" in text


def test_documents_listed_found_and_deleted(spark):
    kind = "entity string, doc_type string, text string"
    new = spark.createDataFrame([("h1", "note", "a"), ("h1", "photo", "b"), ("h2", "note", "a")], kind)
    store = retrieval.add_documents(spark.createDataFrame([], f"{kind}, id string"), new)
    of = retrieval.documents_of(store, spark.createDataFrame([("h1",), ("h1",), (None,)], "entity string"))
    assert {r["text"] for r in of.collect()} == {"a", "b"} and of.count() == 2
    asked = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h2", None)], "entity string, text string")
    assert [r["stored"] for r in retrieval.with_presence(asked, store).orderBy("entity", F.col("text").desc()).collect()] == [True, False, False]
    gone = store.filter("entity = 'h1' and text = 'a'").select("id").union(spark.createDataFrame([("none",), (None,)], "id string"))
    left = retrieval.delete_documents(store, gone)
    assert left.columns == store.columns and {(r["entity"], r["text"]) for r in left.collect()} == {("h1", "b"), ("h2", "a")}


def test_examples_and_guard(spark):
    golden = spark.createDataFrame([("a", ["x", "y"], "house"), ("b", ["y"], "city"), ("c", [], None)], "id string, tags array<string>, agent string")
    ids = lambda **k: sorted(r["id"] for r in retrieval.examples(golden, **k).collect())
    assert ids() == ["a", "b", "c"] and ids(ids=["a", "z"]) == ["a"] and ids(tags=["y"]) == ["a", "b"] and ids(without_agents=["house"]) == ["b", "c"] and ids(tags=["y"], without_agents=["house"]) == ["b"]
    rows = spark.createDataFrame([("Is it Walkable?", "90", None), ("Walk score?", "80", 80), ("Price?", "5", None), (None, "7", None)], "q string, reply string, score int")
    assert [r[0] for r in rows.select(retrieval.guarded("q", "reply", "score", ["walkable", "walk score"], "not known")).collect()] == ["not known", "80", "5", "7"]
