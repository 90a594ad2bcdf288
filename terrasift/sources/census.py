"""Tract, metro, metro-county and hazard exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.relational import align, latest_per_key
from .schema import HAZARDS, SCHEMAS
from .tabular import resolve

MISSING = "-9999"


def _whole(c) -> F.Column:
    return F.regexp_replace(F.trim(c), ",", "").try_cast("int")


def tracts(raw: DataFrame) -> DataFrame:
    """Rows whose GEO_ID names a tract; a description row falls out."""
    found = resolve(raw.columns, {"geo_id": ("GEO_ID",), "name": ("NAME",), "population": ("P1_001N", "P1_001")})
    rows = raw.select(*[F.col(f"`{c}`").alias(f) for f, c in found.items()]).filter(F.col("geo_id").startswith("1400000US"))
    rows = rows.withColumns({"tract_fips": S.zero_pad(F.substring("geo_id", 10, 11), 11), "population": _whole("population")})
    return latest_per_key(align(rows, SCHEMAS["census_tracts"]), ["tract_fips"], [F.col("population").desc_nulls_last()])


def metro_layout(header: list[str]) -> str:
    first = header[0].strip().lower()
    if "label" in first or "grouping" in first:
        return "wide"
    if any("GEO_ID" in c.upper() or "GEO ID" in c.upper() for c in header):
        return "long"
    return "wide" if sum(", " in c and ("Area" in c or "Metro" in c) for c in header) > 5 else "long"


def metros(raw: DataFrame) -> DataFrame:
    """name, population and, in the long layout, msa_code and geo_id."""
    if metro_layout(raw.columns) == "wide":
        label, *places = raw.columns
        total = raw.filter(F.lower(F.trim(F.col(f"`{label}`"))).startswith("total")).limit(1)
        long = total.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(places)]).unpivot([], [f"c{i}" for i in range(len(places))], "at", "population")
        names = raw.sparkSession.createDataFrame([(f"c{i}", c.strip()) for i, c in enumerate(places)], "at string, name string")
        rows = long.join(names, "at").select("name", _whole("population").alias("population"), F.lit(None).cast("string").alias("msa_code"), F.lit(None).cast("string").alias("geo_id"))
    else:
        at = {f: next((c for c in raw.columns if test(c.upper())), None) for f, test in (("geo_id", lambda u: "GEO_ID" in u or "GEO ID" in u), ("name", lambda u: u == "NAME"), ("population", lambda u: "P1_001" in u))}
        text = lambda f: F.trim(F.col(f"`{at[f]}`")) if at[f] else F.lit(None).cast("string")
        rows = raw.select(text("name").alias("name"), _whole(text("population")).alias("population"), S.zero_pad(F.element_at(F.split(text("geo_id"), "US"), -1), 5).alias("msa_code"), text("geo_id").alias("geo_id"))
        rows = rows.filter(F.col("geo_id").contains("US") | F.col("geo_id").startswith("31") | F.col("geo_id").startswith("33"))
    return latest_per_key(rows.filter("name is not null"), ["name"], [F.col("population").desc_nulls_last(), F.col("msa_code")])


def counties(raw: DataFrame) -> DataFrame:
    """The metro-county delineation; the caller skips title lines. Rows without a numeric code (notes) fall out."""
    wanted = {"cbsa_code": ("CBSA Code",), "cbsa_title": ("CBSA Title",), "msa_type": ("Metropolitan/Micropolitan Statistical Area",), "state_fips": ("FIPS State Code",), "county_fips": ("FIPS County Code",), "county_name": ("County/County Equivalent",), "state_name": ("State Name",)}
    rows = raw.select(*[F.trim(F.col(f"`{c}`")).alias(f) for f, c in resolve(raw.columns, wanted).items()]).filter(F.col("cbsa_code").rlike(r"^\d+$"))
    return align(rows.withColumns({"cbsa_code": S.zero_pad("cbsa_code", 5), "state_fips": S.zero_pad("state_fips", 2), "county_fips": S.zero_pad("county_fips", 3)}), SCHEMAS["cbsa_counties"])


def hazards(raw: DataFrame) -> DataFrame:
    """One row for each tract. Newer exports call riverine flooding inland, and the national percentile spatial."""
    number = lambda c: F.nullif(c.cast("string"), F.lit(MISSING)).try_cast("double")
    upper = raw.toDF(*[c.strip().upper() for c in raw.columns])
    first = lambda *names: next((F.col(f"`{n}`") for n in names if n in upper.columns), F.lit(None).cast("string"))
    fips = S.zero_pad(first("TRACTFIPS", "GEOID"), 11)
    columns = {"tract_fips": fips, "county_fips": F.substring(fips, 1, 5), "state_fips": F.substring(fips, 1, 2), "state_name": first("STATEABBRV"), "county_name": first("COUNTY"), "nri_id": first("NRI_ID")}
    for stem in ("risk", "eal", "sovi", "resl"):
        columns |= {f"{stem}_score": number(first(f"{stem}_score".upper())), f"{stem}_ratng": first(f"{stem}_ratng".upper())}
    columns |= {"risk_npctl": number(first("RISK_NPCTL", "RISK_SPCTL")), "eal_valt": number(first("EAL_VALT"))}
    for h in HAZARDS:
        stems = (h.upper(), "IFLD") if h == "rfld" else (h.upper(),)
        columns[f"{h}_risks"] = number(first(*[f"{s}_{end}" for s in stems for end in ("RISKS", "RISK")]))
    rows = upper.select(*[c.alias(n) for n, c in columns.items()]).filter("tract_fips is not null")
    return latest_per_key(align(rows, SCHEMAS["nri_tracts"]), ["tract_fips"], [F.col("risk_score").desc_nulls_last(), F.col("nri_id")])
