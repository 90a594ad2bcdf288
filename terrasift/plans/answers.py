"""The standing questions as frames: metro risk rankings, populations, trade-offs, scores, unmatched metros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import homes
from ..operators.relational import universe_then_metric


def named_like(column: str, terms: Sequence[str]) -> Column:
    return homes.as_condition([F.lower(column).contains(t.lower()) for t in terms])


def real(metros: DataFrame) -> DataFrame:
    return metros.filter(F.col("population").isNotNull() & ~F.col("msa_code").startswith("X")).withColumn("population", F.col("population").cast("bigint"))


def metro_risk(metros: DataFrame, counties: DataFrame, tracts: DataFrame, metric: str, universe: int | None = None, names: Sequence[str] = (), highest: bool = False, result_limit: int = 10) -> DataFrame:
    """msa_name, population, metric_value, ranked by the mean of a tract metric.

    The universe is the ``universe`` largest metros, or those named; the result limit never cuts the universe.
    """
    rows = real(metros).filter(named_like("name", names)) if names else real(metros)
    links = counties.select(F.col("cbsa_code").alias("msa_code"), F.concat("state_fips", "county_fips").alias("county_fips")).distinct()
    order = [F.col("metric_value").desc() if highest else F.col("metric_value").asc(), F.col("name")]
    found = universe_then_metric(rows, universe or 1 << 30, [F.col("population").desc(), F.col("name")], links, "msa_code", tracts.select("county_fips", metric).filter(F.col(metric).isNotNull()), "county_fips", "msa_code", F.avg(metric), order, result_limit) if universe else _named_risk(rows, links, tracts, metric, order)
    return found.select(F.col("name").alias("msa_name"), "population", "metric_value")


def _named_risk(rows: DataFrame, links: DataFrame, tracts: DataFrame, metric: str, order) -> DataFrame:
    measured = rows.select("msa_code").join(links, "msa_code").join(tracts.filter(F.col(metric).isNotNull()), "county_fips").groupBy("msa_code").agg(F.avg(metric).alias("metric_value"))
    return rows.join(measured, "msa_code").orderBy(*order)


def metro_population(metros: DataFrame, names: Sequence[str]) -> DataFrame:
    return real(metros).filter(named_like("name", names)).select(F.col("name").alias("msa_name"), "population").orderBy(F.col("population").desc(), "msa_name")


def metro_tradeoff(metros: DataFrame, counties: DataFrame, tracts: DataFrame, names: Sequence[str]) -> DataFrame:
    return metro_risk(metros, counties, tracts, "rfld_risks", names=names).withColumnRenamed("metric_value", "riverine_flood_risk").orderBy("msa_name")


def average_walk_score(houses: DataFrame, city: str) -> DataFrame:
    """Over all houses of the city that have one, saved or not."""
    return houses.filter((F.lower("city") == city.lower()) & F.col("walk_score").isNotNull()).agg(F.avg("walk_score").alias("average_walk_score"))


def unmatched_metros(metros: DataFrame, counties: DataFrame) -> DataFrame:
    codes = counties.select(F.col("cbsa_code").alias("msa_code"), F.lit(True).alias("known")).distinct()
    status = F.when(F.col("known").isNull() | F.col("msa_code").startswith("X"), "No CBSA/county match found").otherwise("Matched")
    return metros.filter(F.col("msa_code").startswith("X")).join(codes, "msa_code", "left").select(F.col("name").alias("msa_name"), "msa_code", status.alias("match_status")).orderBy("msa_name")


def join_report(metros: DataFrame, counties: DataFrame, tracts: DataFrame) -> DataFrame:
    """step, n: how far rows get along the chain from metros to tracts."""
    links = counties.select(F.col("cbsa_code").alias("msa_code"), F.concat("state_fips", "county_fips").alias("county_fips")).distinct()
    steps = {
        "metros": metros,
        "metros with a real code": real(metros),
        "metros with counties": real(metros).join(links, "msa_code", "left_semi"),
        "counties with tracts": links.select("county_fips").distinct().join(tracts, "county_fips", "left_semi"),
        "metros with tracts": real(metros).join(links.join(tracts, "county_fips", "left_semi"), "msa_code", "left_semi"),
    }
    out = None
    for i, (name, df) in enumerate(steps.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("nth"), F.lit(name).alias("step"), "n")
        out = one if out is None else out.unionByName(one)
    return out
