"""Addresses to coordinates: response layouts, cache, chunks. The network is behind a function the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .schema import SCHEMAS

CHUNK = 900


def address_key(c) -> F.Column:
    return F.md5(F.upper(F.trim(F.regexp_replace(S.col(c), r"\s+", " "))))


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """row_id, match, match_type, lat, lon, tract_fips, geocode_accuracy of batch response lines.

    A match has 12 fields with a quoted "lon,lat", or 13 with the two apart; other lines have three or more.
    """
    fields = F.from_csv(F.col(column), ", ".join(f"f{i} string" for i in range(13)), {"mode": "PERMISSIVE"})
    rows = lines.select(fields.alias("f"))
    f = [F.trim(F.col(f"f.f{i}")) for i in range(13)]
    pair = f[5].contains(",")
    hit = f[2] == "Match"
    lon = F.when(pair, F.split(f[5], ",")[0]).otherwise(f[5]).try_cast("double")
    lat = F.when(pair, F.trim(F.split(f[5], ",")[1])).otherwise(f[6]).try_cast("double")
    state, county, tract = (F.nullif(F.when(pair, f[i]).otherwise(f[i + 1]), F.lit("")) for i in (8, 9, 10))
    fips = F.concat(S.zero_pad(state, 2), S.zero_pad(county, 3), S.zero_pad(tract, 6))
    return rows.filter(f[2].isNotNull()).select(f[0].alias("row_id"), f[2].alias("match"), f[3].alias("match_type"), F.when(hit, lat).alias("lat"), F.when(hit, lon).alias("lon"), F.when(hit, fips).alias("tract_fips"), F.when(hit, f[3]).otherwise("No_Match").alias("geocode_accuracy"))


Geocoder = Callable[[list[tuple[str, str]]], Iterable[tuple[str, float | None, float | None, str | None, str]]]


def geocode(pending: DataFrame, geocoder: Geocoder, key: str = "address_key", text: str = "full_address") -> DataFrame:
    """Asks for chunks of at most CHUNK addresses on the executors.

    ``geocoder``: (key, address) pairs to (key, lat, lon, tract_fips, accuracy); what it leaves out has no match.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                told = {r[0]: r for r in geocoder(list(zip(part[key], part[text])))}
                rows = [told.get(k, (k, None, None, None, "No_Match")) for k in part[key]]
                yield pd.DataFrame(rows, columns=[key, "lat", "lon", "tract_fips", "geocode_accuracy"]).assign(**{text: part[text].to_numpy()})

    return pending.select(key, text).distinct().mapInPandas(run, f"{key} string, lat double, lon double, tract_fips string, geocode_accuracy string, {text} string")


def located(rows: DataFrame, cache: DataFrame, geocoder: Geocoder | None = None) -> tuple[DataFrame, DataFrame]:
    """Sales with coordinates from the cache, then from the geocoder; and the cache with what is new.

    Rows that have coordinates are left alone; what stays without remains ``pending`` and is asked for again later.
    """
    keyed = rows.withColumn("address_key", address_key("full_address"))
    if geocoder is not None:
        missing = keyed.filter("lat is null and full_address is not null").join(cache, "address_key", "left_anti")
        found = geocode(missing, geocoder).filter("lat is not null").withColumns({"geocode_source": F.lit("batch"), "geocoded_at": F.current_timestamp()})
        cache = cache.unionByName(found.select(*SCHEMAS["geocode_cache"]))
    known = cache.select("address_key", *[F.col(c).alias(f"_{c}") for c in ("lat", "lon", "tract_fips", "geocode_source", "geocode_accuracy")])
    out = keyed.join(known, "address_key", "left")
    fresh = F.col("lat").isNull() & F.col("_lat").isNotNull()
    out = out.withColumns({c: F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lat", "lon", "tract_fips", "geocode_source", "geocode_accuracy")} | {"geocode_status": F.when(fresh, "success").otherwise(F.col("geocode_status"))})
    return out.select(*rows.columns), cache


def best_place(candidates: DataFrame, city: str) -> DataFrame:
    """The candidate (display_name, importance, lat, lon) that names the city, then the most important."""
    named = F.lower("display_name").contains(city.lower())
    return candidates.orderBy(named.desc(), F.col("importance").desc_nulls_last(), "display_name").limit(1)
