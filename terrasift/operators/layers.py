"""Map layers for a viewport: heat grid, tract polygons, lines by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.lines import PRIORITY, parsed_points
from .borders import simplify_shared
from .linework import uncovered
from .relational import capped
from .spatial import box, grid, meets, overlaps

#: Page caps of the layers: what a map can show, not what is computed.
MOST_CELLS, MOST_TRACTS, MOST_LINES = 6000, 2500, 5000


def heat(incidents: DataFrame, west: float, south: float, east: float, north: float, size: float, city: str | None = None, most: int = MOST_CELLS) -> tuple[DataFrame, bool]:
    """Cells by weight and whether more were left out. The window reaches the scan."""
    rows = incidents.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if city is not None:
        rows = rows.filter(F.col("city") == city)
    cells = grid(rows, "lon", "lat", size, "severity_weight")
    cells = cells.select(F.round("cell_y", 5).alias("lat"), F.round("cell_x", 5).alias("lon"), "n", F.round("weight", 3).alias("weight"))
    return capped(cells, [F.col("weight").desc(), F.col("n").desc(), F.col("lat"), F.col("lon")], most)


def choropleth(geometry: DataFrame, attributes: DataFrame, west: float, south: float, east: float, north: float, most: int = MOST_TRACTS, tolerance: float = 0.0004) -> tuple[DataFrame, bool]:
    """Tracts that meet the window (their box first, then their shape), simplified along shared borders, with their attributes; and whether more were left out.

    ``geometry``: tract_fips, ring (array of struct(x, y)).
    """
    shapes = geometry.withColumn("_b", box(F.col("ring"))).select("tract_fips", "ring", "_b.*").filter(overlaps(west, south, east, north) & meets(F.col("ring"), west, south, east, north))
    chosen, more = capped(shapes.select("tract_fips", "ring"), [F.col("tract_fips")], most)
    return simplify_shared(chosen, tolerance).join(attributes.select("tract_fips", "county_name", "state_name", "risk_score", "risk_ratng", "risk_npctl", "eal_valt", "sovi_ratng", "resl_ratng"), "tract_fips", "left"), more


def choropleth_notes(found: DataFrame, more: bool) -> DataFrame:
    """One row about an answer of ``choropleth``: tract_count, truncated, and warning, null where nothing is missing."""
    n, rated = F.count(F.lit(1)), F.count(F.coalesce(F.col("county_name"), F.col("state_name"), F.col("risk_score").cast("string")))
    warning = F.when((n > 0) & (rated == 0), "shapes were found, but no attributes for any of them")
    return found.agg(n.alias("tract_count"), F.lit(more).alias("truncated"), warning.alias("warning"))


def lines(routes: DataFrame, west: float, south: float, east: float, north: float, city: str | None = None, exclusive: bool = False, most: int = MOST_LINES) -> tuple[DataFrame, bool]:
    rows = routes.filter(overlaps(west, south, east, north))
    if city is not None:
        rows = rows.filter(F.col("city") == city)
    chosen, more = capped(rows, [F.col("layer_type"), F.col("route_id")], most)
    return (exclusive_pieces(chosen) if exclusive else chosen), more


def exclusive_pieces(routes: DataFrame, cell: float = 0.01) -> DataFrame:
    """route_id, layer_type, display_priority, pieces: of each feature what no feature of higher priority covers.

    Pieces come in order: ``at`` counts the line's segments, ``e`` has the ends of what is left of one.
    """
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    v = parsed_points(F.col("geometry_json"))
    priority = F.coalesce(F.try_element_at(rank, F.col("layer_type")), F.lit(0)).alias("display_priority")
    steps = routes.select("route_id", "layer_type", priority, F.posexplode(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("at", "e"))
    ends = [F.col(f"e.{k}.{c}").alias(f"{n}_{c}") for k, n in (("a", "src"), ("b", "dst")) for c in "xy"]
    left = uncovered(steps.select("route_id", "layer_type", "display_priority", (-F.col("display_priority")).alias("_nth"), "at", *ends), "route_id", ["_nth", "layer_type"], cell)
    place = lambda t: F.struct(*[F.when(F.col(t) == 1, F.col(f"dst_{c}")).otherwise(F.col(f"src_{c}") + (F.col(f"dst_{c}") - F.col(f"src_{c}")) * F.col(t)).alias(c) for c in "xy"])
    pieces = left.select("route_id", "layer_type", "display_priority", F.struct("at", F.col("t").alias("share"), F.struct(place("t").alias("a"), place("u").alias("b")).alias("e")).alias("piece"))
    return pieces.groupBy("route_id", "layer_type", "display_priority").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))


def corridor(ax: float, ay: float, bx: float, by: float, margin: float = 0.02) -> tuple[float, float, float, float]:
    return min(ax, bx) - margin, min(ay, by) - margin, max(ax, bx) + margin, max(ay, by) + margin


def hot_cells(incidents: DataFrame, city: str, size: float) -> DataFrame:
    """i, j, n, weight, intensity of the city's cells."""
    from .spatial import intensity

    rows = incidents.filter((F.col("city") == city) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    cells = rows.groupBy(S.cell_index("lon", size).alias("i"), S.cell_index("lat", size).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("severity_weight").cast("decimal(18,4)")).cast("double").alias("weight"))
    return intensity(cells)
