"""Listing exports and county sale exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalar as S
from ..operators.relational import align, latest_per_key
from .incidents import CITIES
from .schema import SCHEMAS
from .tabular import named, optional, packed, resolve

# Headers of listing and sale exports.
LISTING_FIELDS = {"address": ("address", "street address"), "city": ("city",), "state": ("state",), "zip": ("zip", "zip/postal code"), "listing_date": ("date",), "price": ("price", "list price"), "beds": ("beds",), "baths": ("baths",), "sqft": ("square feet", "sq_ft", "sq.ft.", "sqft"), "year_built": ("year built",), "hoa_fee": ("hoa/month",), "lat": ("latitude", "lat"), "lon": ("longitude", "lon"), "status": ("status",), "walk_score": ("walk score",), "bike_score": ("bike score",), "transit_score": ("transit score",), "nearest_big_city": ("nearest_big_city",), "crime_city": ("crime_city",), "is_favorite": ("favorite", "is_favorite")}
SALE_SIGNATURE = frozenset({"PARID", "MUNIDESC", "SCHOOLDESC", "SALECODE", "SALEDESC", "INSTRTYP"})
SALE_TEXTS = {"sale_code": "SALECODE", "sale_desc": "SALEDESC", "instr_type": "INSTRTYP", "instr_type_desc": "INSTRTYPDESC", "deed_book": "DEEDBOOK", "deed_page": "DEEDPAGE", "muni_code": "MUNICODE", "muni_desc": "MUNIDESC", "school_code": "SCHOOLCODE", "school_desc": "SCHOOLDESC", "parid": "PARID"}
GENERIC_SALE_FIELDS = {"address": ("address", "street address", "street"), "city": ("city",), "state": ("state",), "zip": ("zip", "zip code", "zipcode"), "sold_price": ("sold_price", "sale price", "price"), "sold_date": ("sold_date", "sale date", "date"), "lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "sqft": ("sqft", "square feet"), "beds": ("beds",), "baths": ("baths",), "list_price": ("list_price", "list price")}
DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd")


def date(c) -> Column:
    return S.first_date(c, *DATES).cast("date")


def date_in_name(name: str) -> str | None:
    """The date in a file's name, from 2000 to 2030."""
    for pattern in (r"(\d{4})[_\-](\d{2})[_\-](\d{2})", r"(\d{4})(\d{2})(\d{2})"):
        for y, m, d in re.findall(pattern, name):
            if 2000 <= int(y) <= 2030 and 1 <= int(m) <= 12 and 1 <= int(d) <= 31:
                return f"{y}-{m}-{d}"
    return None


def listings(raw: DataFrame, source: str | Column, modified: str | Column | None = None) -> DataFrame | None:
    """All rows of listing files of one header, in the columns of houses plus snapshot_date; None without coordinates.

    A row's own date comes first, then the file name's, then the file's time of change (an ISO date). ``source`` and
    ``modified`` may be columns, for rows of several files; ``modified`` then has regard to the name already.
    """
    found = resolve(raw.columns, LISTING_FIELDS)
    rows = named(raw, LISTING_FIELDS, ["address", "lat", "lon"], source)
    if rows is None:
        return None
    about = [c for c in ("source_file", "source_folder", "modified") if c in raw.columns]
    file, dated = (source, modified) if isinstance(source, Column) else (F.lit(source), F.lit(date_in_name(source) or modified))
    rows = raw.select(*[F.col(f"`{c}`").alias(f) for f, c in found.items()], packed(raw, [*found.values(), *about]).alias("raw_json"), file.alias("source_file"), dated.cast("date").alias("dated"))
    text = lambda c: S.null_if_blank(optional(rows, c))
    num = lambda c: S.number(optional(rows, c))
    city_key = F.lower(F.trim("city"))
    known = F.coalesce(F.nullif(F.lower(F.trim(optional(rows, "crime_city"))), F.lit("")), F.when(city_key.isin(*CITIES), city_key))
    out = rows.select(
        S.text_id(12, F.lower(F.trim("address")), F.lower(F.trim(optional(rows, "city"))), F.substring(F.trim(optional(rows, "zip")), 1, 5)).alias("house_id"), *[text(c).alias(c) for c in ("address", "city", "state", "zip", "status", "nearest_big_city")],
        *[num(c).alias(c) for c in ("lat", "lon", "price", "beds", "baths", "sqft", "hoa_fee")], *[num(c).cast("int").alias(c) for c in ("year_built", "walk_score", "bike_score", "transit_score")],
        known.alias("crime_city"), "raw_json", "source_file", F.lower(optional(rows, "is_favorite")).isin("y", "yes", "true", "1").alias("is_favorite"), F.coalesce(date(optional(rows, "listing_date")), F.col("dated")).alias("snapshot_date"))
    out = out.withColumn("price_per_sq_ft", F.col("price") / S.no_zero("sqft")).filter("address is not null")
    return align(out, SCHEMAS["houses"] | {"snapshot_date": "date"})


def latest(all_listings: DataFrame) -> DataFrame:
    """One row for each house: the newest, the later file name winning a tie."""
    return latest_per_key(all_listings, ["house_id"], [F.col("snapshot_date").desc_nulls_last(), F.col("source_file").desc(), F.col("price").desc_nulls_last(), F.col("status")])


def snapshots(rows: DataFrame, source_type: str = "redfin") -> DataFrame:
    """Every state of a house that a file shows, once."""
    made = S.text_id(14, "house_id", "source_file", "status", S.money_text("price"))
    rows = rows.withColumns({"snapshot_id": made, "source_type": F.lit(source_type)})
    return latest_per_key(align(rows, SCHEMAS["house_snapshots"]), ["snapshot_id"], [F.col("snapshot_date").desc_nulls_last()])


def county_sales(raw: DataFrame, source: str | Column, county: str = "Allegheny, PA", state: str = "PA", county_fips: str = "42003") -> DataFrame:
    """The assessor layout with street parts, codes and instruments."""
    rows = raw.toDF(*[c.strip().upper() for c in raw.columns])
    blank = lambda c: F.coalesce(S.null_if_blank(optional(rows, c)), F.lit(""))
    parts = F.concat_ws(" ", *[S.null_if_blank(optional(rows, c)) for c in ("PROPERTYHOUSENUM", "PROPERTYADDRESSDIR", "PROPERTYADDRESSSTREET", "PROPERTYADDRESSSUF")])
    unit = blank("PROPERTYUNITNO")
    out = rows.select(
        F.trim(F.when(unit != "", F.concat(parts, F.lit(" #"), unit)).otherwise(parts)).alias("address"), F.initcap(blank("PROPERTYCITY")).alias("city"), F.upper(F.coalesce(S.null_if_blank(optional(rows, "PROPERTYSTATE")), F.lit(state))).alias("state"), F.substring(blank("PROPERTYZIP"), 1, 5).alias("zip"),
        S.number(optional(rows, "PRICE")).alias("sold_price"), date(optional(rows, "SALEDATE")).alias("sold_date"), date(optional(rows, "RECORDDATE")).alias("record_date"), *[F.trim(optional(rows, c)).alias(n) for n, c in SALE_TEXTS.items()], _file(source, rows))
    return _sales(out.filter("address != ''"), county, county_fips, S.text_id(14, "parid", "sold_date"))


def generic_sales(raw: DataFrame, source: str | Column) -> DataFrame | None:
    rows = named(raw, GENERIC_SALE_FIELDS, ["address", "sold_price", "sold_date"], source)
    if rows is None:
        return None
    num = lambda c: S.number(optional(rows, c))
    out = rows.select(*[S.null_if_blank(optional(rows, c)).alias(c) for c in ("address", "city", "state")], F.substring(S.null_if_blank(optional(rows, "zip")), 1, 5).alias("zip"), date("sold_date").alias("sold_date"), *[num(c).alias(c) for c in ("sold_price", "lat", "lon", "sqft", "beds", "baths", "list_price")], "source_file")
    return _sales(out.filter("address is not null"), "Unknown", None, S.text_id(14, "address", "zip", "sold_date"))


def _file(source: str | Column, rows: DataFrame) -> Column:
    """The name of a row's file: as given, or from the column of that name whatever its case."""
    own = next((c for c in rows.columns if c.lower() == "source_file"), None)
    return (F.col(own) if isinstance(source, Column) and own else F.lit(source) if isinstance(source, str) else source).alias("source_file")


def _sales(rows: DataFrame, county: str, county_fips: str | None, sale_id: Column) -> DataFrame:
    told = rules.at_market(*(optional(rows, c) for c in ("sale_code", "sale_desc", "instr_type")), "sold_price")
    located = optional(rows, "lat", "double").isNotNull() & optional(rows, "lon", "double").isNotNull()
    rows = rows.withColumns({"sale_id": sale_id, "source_county": F.lit(county), "full_address": F.concat_ws(", ", "address", S.null_if_blank("city"), F.concat_ws(" ", S.null_if_blank("state"), S.null_if_blank("zip"))), "is_arms_length": told["is_arms_length"], "arms_length_flag": told["flag"], "geocode_status": F.when(located, "manual").otherwise("pending"), "geocode_source": F.when(located, "manual"), "county_fips": F.lit(county_fips).cast("string")})
    return latest_per_key(align(rows, SCHEMAS["sold_homes"]), ["sale_id"], [F.col("record_date").desc_nulls_last(), F.col("sold_price").desc_nulls_last()])


def sales(raw: DataFrame, source: str | Column) -> DataFrame | None:
    """The most specific layout whose signature the header has."""
    header = {c.strip().upper() for c in raw.columns}
    return county_sales(raw, source) if header >= SALE_SIGNATURE else generic_sales(raw, source)
