"""Houses, sales and metros: enriched lookups, price statistics, comparables, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalar as S
from ..sources.schema import HAZARDS
from .relational import latest_per_key, similar_pairs, tiered_match, top_per_key
from .shared import stored


def enriched(houses: DataFrame, snapshots: DataFrame, tracts: DataFrame, census: DataFrame) -> DataFrame:
    """Every house with its newest dated snapshot's price and status, its tract's risk and population."""
    newest = latest_per_key(snapshots.filter("snapshot_date is not null"), ["house_id"], [F.col("snapshot_date").desc(), F.col("created_at").desc_nulls_last(), F.col("snapshot_id")])
    newest = newest.select("house_id", F.col("price").alias("_price"), F.col("status").alias("_status"), "snapshot_date")
    rows = houses.join(newest, "house_id", "left").withColumns({"price": F.coalesce("_price", "price"), "status": F.coalesce("_status", "status")}).drop("_price", "_status")
    return rows.join(tracts.select("tract_fips", "risk_score", "risk_ratng", "county_name"), "tract_fips", "left").join(census.select("tract_fips", F.col("population").alias("tract_population")), "tract_fips", "left")


def history(snapshots: DataFrame, house_id: str) -> DataFrame:
    return snapshots.filter(F.col("house_id") == house_id).orderBy(F.col("snapshot_date").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "snapshot_id")


def risk_of(tracts: DataFrame, tract: str) -> DataFrame:
    return tracts.filter(F.col("tract_fips") == tract)


def top_hazards(tracts: DataFrame, k: int = 5) -> DataFrame:
    """tract_fips, hazard, score, nth: the k largest positive hazards of each tract."""
    pairs = F.array(*[F.struct(F.lit(label).alias("hazard"), F.col(f"{h}_risks").alias("score")) for h, label in HAZARDS.items()])
    rows = tracts.select("tract_fips", F.explode(pairs).alias("p")).select("tract_fips", "p.*").filter("score > 0")
    return top_per_key(rows, ["tract_fips"], [F.col("score").desc(), F.col("hazard")], k, "nth")


def sold_in_tract(sales: DataFrame, tract: str, at_market_only: bool = True) -> DataFrame:
    rows = sales.filter(F.col("tract_fips") == tract)
    if at_market_only:
        rows = rows.filter(S.is_true_or_null("is_arms_length"))
    return rows.orderBy(F.col("sold_date").desc_nulls_last(), "sale_id")


def price_stats(houses: DataFrame, sales: DataFrame, tract: str) -> DataFrame:
    """One row: list prices and sold prices of a tract.

    ``excluded_count`` keeps the count over rows at market, which is always zero; ``off_market_count`` is the true one.
    """
    listed = houses.filter((F.col("tract_fips") == tract) & (F.col("price") > 0))
    a = listed.agg(F.count(F.lit(1)).alias("list_count"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.median("price").alias("median_price"), F.median(F.col("price") / S.no_zero("sqft")).alias("median_price_per_sqft"))
    sold = sales.filter((F.col("tract_fips") == tract) & (F.col("sold_price") > 1000))
    keep = S.is_true_or_null("is_arms_length")
    price = F.when(keep, F.col("sold_price"))
    b = sold.agg(F.count(price).alias("sold_count"), F.avg(price).alias("sold_avg_price"), F.median(price).alias("sold_median_price"), F.median(price / S.no_zero("sqft")).alias("sold_median_price_per_sqft"), F.lit(0).cast("bigint").alias("excluded_count"), F.count_if(~keep).alias("off_market_count"))
    return a.join(F.broadcast(b))  # one row each


def comparables(houses: DataFrame, house_id: str, city: str, price: float | None, k: int = 8) -> DataFrame:
    """Listings of the city nearest in price."""
    rows = houses.filter((F.col("city") == city) & (F.col("house_id") != house_id) & (F.col("price") > 0))
    return rows.withColumn("unit_price", F.round(F.col("price") / S.no_zero("sqft"), 0)).orderBy(F.abs(F.col("price") - F.coalesce(F.lit(price), F.col("price"))), "house_id").limit(k)


def estimates(stats: DataFrame, sqft: float) -> DataFrame:
    return stats.select((F.col("median_price_per_sqft") * sqft).alias("by_listings"), (F.col("sold_median_price_per_sqft") * sqft).alias("by_sales"))


def geocode_stats(sales: DataFrame) -> DataFrame:
    return sales.groupBy("geocode_status", "geocode_source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "geocode_status", "geocode_source")


def keyed_addresses(rows: DataFrame) -> DataFrame:
    norm = N.address("address")
    return rows.withColumns({"norm": norm, "zip5": F.substring("zip", 1, 5)}).withColumns({"number": F.nullif(N.house_number("norm"), F.lit("")), "street": N.street_word("norm"), "city3": F.lower(F.substring("city", 1, 3))})


def match_sales(sales: DataFrame, houses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sales with the house they belong to (house_id, tier), in three tiers; sales already in the history are left out."""
    known = snapshots.filter("source_type = 'sold'").join(houses.select("house_id"), "house_id", "left_semi").select(F.col("snapshot_date").alias("sold_date"), F.col("price").alias("sold_price"))
    open_ = sales.filter("address is not null and sold_price > 0").join(known, ["sold_date", "sold_price"], "left_anti")
    have = keyed_addresses(houses.filter("address is not null")).select("house_id", "norm", "zip5", "number", "street", "city3")
    tiers = [("norm", "zip5"), ("number", "street", "zip5"), ("number", "zip5", "city3")]
    return tiered_match(keyed_addresses(open_), have, tiers, "house_id", [F.col("house_id")]).filter("house_id is not null")


def sold_snapshots(matched: DataFrame) -> DataFrame:
    from ..sources.property import snapshots

    rows = matched.select("house_id", "source_file", F.lit("Sold").alias("status"), F.col("sold_price").alias("price"), "beds", "baths", "sqft", "year_built", F.col("sold_date").alias("snapshot_date"))
    return snapshots(rows, "sold")


def _titles(counties: DataFrame) -> DataFrame:
    """cbsa_code, norm, city, state of the crosswalk's metros."""
    titles = counties.select("cbsa_code", N.metro("cbsa_title").alias("norm")).distinct()
    return titles.withColumns({"city": N.first_city("norm"), "state": N.first_state("norm")})


def _alike(rows: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """norm, title, code, score: titles of the same state whose words overlap enough."""
    own = rows.select("norm", "state", S.words("norm", 2).alias("w")).distinct()
    other = titles.select(F.col("norm").alias("title"), "state", S.words("norm", 2).alias("w")).distinct()
    pairs = similar_pairs(own, other, ["state"], "norm", "title", "w", least, S.jaccard)
    return pairs.join(titles.select(F.col("norm").alias("title"), F.col("cbsa_code").alias("code")), "title")


def match_metros(metros: DataFrame, counties: DataFrame, name: str = "name", least: float = 0.5) -> DataFrame:
    """Adds cbsa_code and tier: exact name (1), first city and state (2), word overlap within the state (3), known
    renaming by its new name or by that name's first city and state (4)."""
    titles = stored(_titles(counties))
    rows = metros.withColumn("norm", N.metro(name)).withColumns({"city": N.first_city("norm"), "state": N.first_state("norm")})
    rows = tiered_match(rows, titles, [("norm",), ("city", "state")], "cbsa_code", [F.col("norm"), F.col("cbsa_code")])
    scored = _alike(rows.filter("cbsa_code is null"), titles, least)
    best = latest_per_key(scored, ["norm"], [F.col("score").desc(), F.col("title"), F.col("code")]).select("norm", F.col("code").alias("_fuzzy"))
    new = rows.filter("cbsa_code is null").select("norm", N.lookup(N.RENAMED, F.col("norm")).alias("new")).filter("new is not null").distinct()
    named = new.select(F.col("norm").alias("_old"), F.col("new").alias("norm")).withColumns({"city": N.first_city("norm"), "state": N.first_state("norm")})
    named = tiered_match(named, titles, [("norm",), ("city", "state")], "cbsa_code", [F.col("norm"), F.col("cbsa_code")])
    renamed = named.select(F.col("_old").alias("norm"), F.col("cbsa_code").alias("_renamed"))
    rows = rows.join(best, "norm", "left").join(renamed, "norm", "left")
    tier = F.when(F.col("cbsa_code").isNotNull(), F.col("tier")).when(F.col("_fuzzy").isNotNull(), 3).when(F.col("_renamed").isNotNull(), 4)
    return rows.withColumns({"tier": tier, "cbsa_code": F.coalesce("cbsa_code", "_fuzzy", "_renamed")}).drop("_fuzzy", "_renamed", "city", "state", "norm")


def metro_candidates(metros: DataFrame, counties: DataFrame, name: str = "name", least: float = 0.4, most: int = 5) -> DataFrame:
    """name, nth, cbsa_code, title, score: what a metro without a match might be, the likeliest ``most`` of each."""
    rows = match_metros(metros.select(F.col(name).alias("name")), counties, "name").filter("cbsa_code is null").select("name").distinct()
    rows = stored(rows.withColumn("norm", N.metro("name")).withColumn("state", N.first_state("norm")))
    found = rows.select("name", "norm").join(_alike(rows, _titles(counties), least), "norm")
    order = Window.partitionBy("name").orderBy(F.col("score").desc(), "title", "code")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select("name", "nth", F.col("code").alias("cbsa_code"), "title", "score")


def coded_metros(metros: DataFrame, counties: DataFrame) -> DataFrame:
    """Rows of census_msa: the code of the file, else of the crosswalk, else a placeholder from the name."""
    found = match_metros(metros.withColumn("own", F.col("msa_code")).drop("msa_code"), counties)
    code = F.coalesce("own", "cbsa_code", F.concat(F.lit("X"), F.substring(F.md5("name"), 1, 7)))
    return latest_per_key(found.withColumn("msa_code", code), ["msa_code"], [F.col("population").desc_nulls_last(), F.col("name")]).select("msa_code", "geo_id", "name", "population")


def placeholder_repairs(metros: DataFrame, counties: DataFrame, least: float = 0.5) -> DataFrame:
    """old, new: codes for placeholders that match after all. Apply with changes.rekey."""
    found = match_metros(metros.filter(F.col("msa_code").startswith("X")), counties, least=least)
    return found.filter("cbsa_code is not null").select(F.col("msa_code").alias("old"), F.col("cbsa_code").alias("new"))


def bridge(metros: DataFrame, counties: DataFrame, tracts: DataFrame) -> DataFrame:
    """Metro to county to tract; placeholder codes are not metros."""
    real = metros.filter(~F.col("msa_code").startswith("X"))
    links = counties.select(F.col("cbsa_code").alias("msa_code"), F.concat("state_fips", "county_fips").alias("county_fips"))
    return real.join(links, "msa_code").join(tracts.drop("state_fips"), "county_fips")


def largest_metros(metros: DataFrame, counties: DataFrame, tracts: DataFrame, n: int = 50) -> DataFrame:
    rows = bridge(metros, counties, tracts).groupBy("msa_code", "name", "population")
    return rows.agg(F.avg("risk_score").alias("avg_risk"), F.avg("risk_npctl").alias("avg_percentile"), F.median("eal_valt").alias("median_loss")).orderBy(F.col("population").desc_nulls_last(), "name").limit(n)


def coverage(frames: dict[str, DataFrame]) -> DataFrame:
    """measure, value: rows of each table, share of located sales, sales at and off market."""
    sales = frames["sold_homes"]
    out = [df.agg(F.lit(f"{name} rows").alias("measure"), F.count(F.lit(1)).cast("double").alias("value")) for name, df in frames.items()]
    out.append(sales.agg(F.lit("share of sales with a tract").alias("measure"), F.avg(F.when(F.col("tract_fips").isNotNull(), 1.0).otherwise(0.0)).alias("value")))
    for name, condition in (("at", S.is_true_or_null("is_arms_length")), ("off", ~S.is_true_or_null("is_arms_length"))):
        out.append(sales.agg(F.lit(f"sales {name} market").alias("measure"), F.count_if(condition).cast("double").alias("value")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def as_condition(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
