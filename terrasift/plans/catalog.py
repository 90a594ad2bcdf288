"""What the tables are, how they join, and what words mean which columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.schema import HIDDEN, SCHEMAS


@dataclass(frozen=True)
class Relationship:
    left: str
    left_key: str
    right: str
    right_key: str
    cardinality: str
    confidence: str
    preferred: bool = True
    note: str = ""


# The documented joins, and the words for columns.
RELATIONSHIPS = (
    Relationship("houses", "tract_fips", "nri_tracts", "tract_fips", "many-to-one", "high"),
    Relationship("houses", "tract_fips", "census_tracts", "tract_fips", "many-to-one", "high"),
    Relationship("sold_homes", "tract_fips", "nri_tracts", "tract_fips", "many-to-one", "high", note="only geocoded sales have a tract"),
    Relationship("houses", "msa_code", "census_msa", "msa_code", "many-to-one", "low", False, "most houses have no metro code"),
    Relationship("census_msa", "msa_code", "cbsa_counties", "cbsa_code", "one-to-many", "high", note="codes that start with X are placeholders"),
    Relationship("cbsa_counties", "state_fips || county_fips", "nri_tracts", "county_fips", "one-to-many", "high"),
    Relationship("house_snapshots", "house_id", "houses", "house_id", "many-to-one", "high"),
    Relationship("houses", "crime_city", "crime_incidents", "city", "many-to-many", "medium", False, "aggregate one side first"),
)
GLOSSARY = {
    "walk_score": (("walkability", "walk score", "most walkable"), "houses.walk_score"),
    "favorite_house": (("my list", "saved houses", "favorites"), "houses.is_favorite"),
    "nri_overall_risk": (("overall risk", "nri risk", "composite risk"), "nri_tracts.risk_score"),
    "nri_riverine_flood_risk": (("flood risk", "riverine flood", "riverine flooding"), "nri_tracts.rfld_risks"),
    "nri_coastal_flood_risk": (("coastal flood", "coastal flooding"), "nri_tracts.cfld_risks"),
    "msa_population": (("top msa", "largest metros", "top 50 msas"), "census_msa.population"),
}


def visible() -> list[str]:
    return [t for t in SCHEMAS if t not in HIDDEN]


def columns_for(question: str) -> list[tuple[str, str, int]]:
    """(term, column, hits) of the glossary terms a question mentions, most hits first."""
    text = question.lower()
    found = [(term, column, sum(a in text for a in (term, *aliases))) for term, (aliases, column) in GLOSSARY.items()]
    return sorted((f for f in found if f[2]), key=lambda f: (-f[2], f[0]))


def joins_for(tables: set[str]) -> list[Relationship]:
    """Joins that touch any of the tables, the trusted ones first."""
    return sorted((r for r in RELATIONSHIPS if r.left in tables or r.right in tables), key=lambda r: (not r.preferred, r.confidence != "high", r.left, r.right))


def availability(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """table, rows: one count for each table, in one job."""
    from functools import reduce

    from pyspark.sql import functions as F

    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in frames.items()])


def documents(spark: SparkSession) -> DataFrame:
    """id, text: the catalog as rows for word search."""
    rows = [(f"table:{t}", f"{t} has columns {', '.join(c)}") for t, c in SCHEMAS.items() if t not in HIDDEN]
    rows += [(f"join:{r.left}:{r.right}", f"{r.left}.{r.left_key} = {r.right}.{r.right_key} {r.cardinality} {r.note}") for r in RELATIONSHIPS]
    rows += [(f"term:{k}", f"{k} {' '.join(a)} means {c}") for k, (a, c) in GLOSSARY.items()]
    return spark.createDataFrame(rows, "id string, text string")


def rendered(tables: list[str] | None = None) -> str:
    """The visible tables, their columns and their joins, one to a line."""
    chosen = tables or visible()
    lines = [f"{t}({', '.join(f'{c} {k}' for c, k in SCHEMAS[t].items() if c != 'raw_json')})" for t in chosen]
    return "\n".join(lines + [f"{r.left}.{r.left_key} = {r.right}.{r.right_key} ({r.cardinality})" for r in joins_for(set(chosen))])
