"""Incident exports of eight cities, described as data: fields, bounds, and how times are written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalar as S
from ..operators.relational import align, latest_per_key
from .schema import SCHEMAS
from .tabular import joined, named, optional

#: Time formats tried in order where a city states none.
TIMES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy")


@dataclass(frozen=True)
class City:
    fields: dict[str, tuple[str, ...]]
    box: tuple[float, float, float, float] | None  # west, east, south, north
    times: tuple[str, ...] = field(default=TIMES)


# Headers and bounds of the cities' exports.
CITIES = {
    "baltimore": City({"time": ("CrimeDateTime", "Crime Date Time"), "lat": ("Latitude", "Lat"), "lon": ("Longitude", "Lon", "Long"), "kind": ("Description",), "detail": ("CrimeCode", "Crime Code"), "place": ("Location", "Block Address", "Location 1"), "natural_id": ("ObjectId", "Object_ID", "_id")}, (-76.8, -76.5, 39.0, 39.4)),
    "boston": City({"time": ("OCCURRED_ON_DATE",), "lat": ("Lat",), "lon": ("Long", "Lon"), "kind": ("OFFENSE_CODE_GROUP",), "detail": ("OFFENSE_DESCRIPTION",), "place": ("STREET", "Location"), "natural_id": ("INCIDENT_NUMBER",)}, (-71.4, -71.0, 42.0, 42.5)),
    "buffalo": City({"time": ("Incident Datetime", "Incident Date Time"), "lat": ("Latitude",), "lon": ("Longitude",), "kind": ("Incident Type Primary",), "detail": ("Parent Incident Type", "Incident Description"), "place": ("Address Line1", "Location"), "natural_id": ("Case Number",)}, (-79.1, -78.4, 42.5, 43.02)),
    "chicago": City({"time": ("Date",), "lat": ("Latitude",), "lon": ("Longitude",), "kind": ("Primary Type",), "detail": ("Description",), "place": ("Block",), "natural_id": ("ID",)}, None, ("MM/dd/yyyy hh:mm:ss a",)),
    "indianapolis": City({"time": ("DATE_", "Date"), "hour": ("TIME", "Time"), "lat": ("Y_COORD", "Y"), "lon": ("X_COORD", "X"), "kind": ("CRIME", "UCR_CRIME_CATEGORY", "Offense", "CRIME_DESCRIPTION"), "place": ("ADDRESS", "BLOCK_ADDRESS"), "natural_id": ("CASE_NUMBER", "INCIDENT_NUMBER")}, (-86.4, -85.9, 39.6, 40.0)),
    "minneapolis": City({"time": ("Occurred_Date", "OccurredDate", "DATE", "Reported_Date"), "lat": ("Latitude", "Lat"), "lon": ("Longitude", "Long", "Lon"), "kind": ("Offense", "OFFENSE"), "detail": ("Description", "OffenseDescription"), "place": ("Address", "Block Address"), "natural_id": ("ObjectId", "ControlNumber")}, (-93.4, -93.1, 44.8, 45.1)),
    "philadelphia": City({"time": ("dispatch_date_time", "dispatch_date"), "lat": ("lat",), "lon": ("lng", "lon"), "kind": ("text_general_code",), "place": ("location_block",), "natural_id": ("objectid", "dc_key")}, (-75.3, -74.9, 39.8, 40.2)),
    "pittsburgh": City({"time": ("INCIDENTTIME",), "lat": ("Y",), "lon": ("X",), "kind": ("INCIDENTHIERARCHYDESC", "HIERARCHYDESC", "HIERARCHY_DESC"), "detail": ("OFFENSES",), "place": ("INCIDENTLOCATION",), "natural_id": ("PK",)}, (-80.3, -79.6, 40.1, 40.7)),
}


def _time(df: DataFrame, times: tuple[str, ...]) -> Column:
    text = F.trim("time") if "hour" not in df.columns else F.concat_ws(" ", F.trim("time"), F.trim("hour"))
    return S.first_date(text, *times)


def incidents(raw: DataFrame, city: str, source: str | Column | None = None) -> DataFrame | None:
    """One file of a city's export as rows of crime_incidents; None if a needed column is missing."""
    spec = CITIES[city]
    rows = named(raw, spec.fields, ["time", "lat", "lon"], source)
    if rows is None:
        return None
    lat, lon = (F.nullif(S.number(c), F.lit(0.0)) for c in ("lat", "lon"))
    rows = rows.select(F.lit(city).alias("city"), "source_file", _time(rows, spec.times).alias("occurred_at"), lat.alias("lat"), lon.alias("lon"), joined(rows, "kind", "detail").alias("raw_type"), optional(rows, "place").alias("location_text"), S.null_if_blank(optional(rows, "natural_id")).alias("natural_id"))
    rows = rows.filter("occurred_at is not null and lat is not null and lon is not null")
    if spec.box:
        west, east, south, north = spec.box
        rows = rows.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    c = rules.heaviest("raw_type")
    own = S.text_id(16, "city", "natural_id")
    made = S.text_id(16, "city", "occurred_at", F.round("lat", 6), F.round("lon", 6), "raw_type")
    rows = rows.withColumns({"incident_id": F.when(F.col("natural_id").isNotNull(), own).otherwise(made), "year": F.year("occurred_at"), "month": F.month("occurred_at"), "year_month": F.date_format("occurred_at", "yyyy-MM"), "category": c["key"], "category_label": c["label"], "severity_weight": c["weight"]})
    return align(rows, SCHEMAS["crime_incidents"])


def combined(*parts: DataFrame | None) -> DataFrame:
    """All files together, each incident once."""
    frames = [p for p in parts if p is not None]
    out = frames[0]
    for p in frames[1:]:
        out = out.unionByName(p)
    return latest_per_key(out, ["incident_id"], [F.col("source_file"), F.col("occurred_at"), F.col("raw_type")])


def unclassified(rows: DataFrame, top: int = 10) -> tuple[float, DataFrame]:
    """Share of incidents without a category, and their commonest texts."""
    share = rows.agg(F.avg(F.when(F.col("category") == "other", 1.0).otherwise(0.0))).first()[0] or 0.0
    return share, rows.filter("category = 'other'").groupBy("raw_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "raw_type").limit(top)
