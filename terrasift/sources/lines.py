"""Line datasets, read from Parquet with a ``points`` column (array of struct(x, y) in degrees), and GeoJSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.relational import align
from ..operators.spatial import box
from .schema import SCHEMAS
from .tabular import packed

# Layer folders with type, label and colour; and the order in which layers are shown.
LAYERS = {
    "bike lanes": ("bike_lanes", "Bike Lanes", "steelblue"),
    "bikeable sidewalks": ("bikeable_sidewalks", "Bikeable Sidewalks", "lightblue"),
    "cautionary bike route": ("cautionary_bike_route", "Cautionary Bike Route", "red"),
    "on street bike route": ("on_street_bike_route", "On Street Bike Route", "lightgreen"),
    "protected bike lanes": ("protected_bike_lanes", "Protected Bike Lanes", "darkgreen"),
    "sharrows": ("sharrows", "Sharrows", "orange"),
    "trails": ("trails", "Trails", "pink"),
}
PRIORITY = {"protected_bike_lanes": 100, "bike_lanes": 90, "trails": 80, "bikeable_sidewalks": 70, "sharrows": 60, "cautionary_bike_route": 50, "on_street_bike_route": 40}
_POINTS = "array<array<double>>"


def line_json(points: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["x"], p["y"])).alias("coordinates")))


def parsed_points(geometry: Column) -> Column:
    """array of struct(x, y) of a GeoJSON line."""
    pairs = F.from_json(geometry, f"type string, coordinates {_POINTS}")["coordinates"]
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def lines(raw: DataFrame, city: str, folder: str, source: str) -> DataFrame:
    """Rows of bike_routes. ``raw``: points and properties; lines of fewer than two points fall out."""
    kind, label, colour = LAYERS[" ".join(folder.strip().lower().split())]
    b = box(F.col("points"))
    rows = raw.filter(F.size("points") >= 2).withColumn("geometry_json", line_json(F.col("points")))
    made = S.text_id(20, F.lit(city), F.lit(kind), F.lit(source), "geometry_json", packed(raw, ["points"]))
    rows = rows.withColumns({"route_id": made, "city": F.lit(city), "layer_type": F.lit(kind), "layer_label": F.lit(label), "color": F.lit(colour), "source_file": F.lit(source), "properties_json": packed(raw, ["points"]), **{c: b[c] for c in ("min_lon", "min_lat", "max_lon", "max_lat")}})
    return align(rows, SCHEMAS["bike_routes"]).dropDuplicates(["route_id"])


def point_features(rows: DataFrame, lon: str = "lon", lat: str = "lat", leave_out: tuple[str, ...] = ("raw_json",)) -> DataFrame:
    """feature: each located row as a GeoJSON point."""
    kept = [c for c in rows.columns if c not in (lon, lat, *leave_out)]
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*kept).alias("properties"))
    return rows.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))
