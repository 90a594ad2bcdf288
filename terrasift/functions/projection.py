"""Planar coordinates to degrees, as column expressions: transverse Mercator, Lambert conformal conic, Albers, Mercator.

Inverse formulas are series in the third flattening, good to far less than 1e-7 degrees within a few thousand
kilometres of a system's middle. A system is read from the text of a .prj file or named by an EPSG number. Datums are
not shifted: North American 1983 and WGS 84 differ by a metre or two.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col

# Ellipsoids as half axis in metres and inverse flattening, and the foot of surveyors in metres.
WGS84, GRS80 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)
SURVEY_FOOT = 1200 / 3937


@dataclass(frozen=True)
class System:
    """``kind``: degrees, mercator, transverse_mercator, lambert or albers. Angles are degrees; offsets are in units of
    ``unit`` metres, like the coordinates."""

    kind: str
    ellipsoid: tuple[float, float] = GRS80
    unit: float = 1.0
    values: Mapping[str, float] = field(default_factory=dict)

    def value(self, name: str, default: float = 0.0) -> float:
        return self.values.get(name, default)


def _series(first: list[list[float]], n: float) -> list[float]:
    """Coefficients, each a polynomial in n from its own lowest power on."""
    return [sum(c * n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(first, 1)]


def _flat(system: System) -> tuple[float, float, float]:
    """Half axis, first eccentricity, third flattening."""
    a, inverse = system.ellipsoid
    f = 1 / inverse if inverse else 0.0
    return a, math.sqrt(f * (2 - f)), f / (2 - f)


def _geographic(conformal: Column, n: float) -> Column:
    """Latitude from conformal latitude, both in radians."""
    terms = _series([[2, -2 / 3, -2, 116 / 45], [7 / 3, -8 / 5, -227 / 45], [56 / 15, -136 / 35], [4279 / 630]], n)
    out = conformal
    for j, c in enumerate(terms, 1):
        out = out + c * F.sin(2 * j * conformal)
    return out


def _conformal(lat: float, e: float) -> float:
    s = math.sin(lat)
    return math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))


def _transverse(system: System, x: Column, y: Column) -> tuple[Column, Column]:
    a, e, n = _flat(system)
    size = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * system.value("scale", 1.0)
    forward = _series([[1 / 2, -2 / 3, 5 / 16, 41 / 180], [13 / 48, -3 / 5, 557 / 1440], [61 / 240, -103 / 140], [49561 / 161280]], n)
    back = _series([[1 / 2, -2 / 3, 37 / 96, -1 / 360], [1 / 48, 1 / 15, -437 / 1440], [17 / 480, -37 / 840], [4397 / 161280]], n)
    low = _conformal(math.radians(system.value("origin")), e)
    start = low + sum(c * math.sin(2 * j * low) for j, c in enumerate(forward, 1))
    xi, eta = y / size + start, x / size
    up, out = xi, eta
    for j, c in enumerate(back, 1):
        up = up - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        out = out - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    lon = F.atan2(F.sinh(out), F.cos(up))
    return lon, _geographic(F.asin(F.sin(up) / F.cosh(out)), n)


def _isometric(lat: float, e: float) -> float:
    return math.tan(math.pi / 4 - _conformal(lat, e) / 2)


def _across(lat: float, e: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)


def _parallels(system: System) -> tuple[float, float, float]:
    low = system.value("first", system.value("origin"))
    return math.radians(low), math.radians(system.value("second", low)), math.radians(system.value("origin"))


def _cone(x: Column, y: Column, top: float, cone: float) -> tuple[Column, Column]:
    """Distance from the cone's top, and longitude from its middle."""
    side = 1.0 if cone > 0 else -1.0
    return F.sqrt(x * x + (top - y) * (top - y)), F.atan2(side * x, side * (top - y)) / cone


def _lambert(system: System, x: Column, y: Column) -> tuple[Column, Column]:
    a, e, n = _flat(system)
    first, second, origin = _parallels(system)
    m, t = _across(first, e), _isometric(first, e)
    cone = math.sin(first) if first == second else math.log(m / _across(second, e)) / math.log(t / _isometric(second, e))
    scale = a * m / (cone * t**cone) * system.value("scale", 1.0)
    far, lon = _cone(x, y, scale * _isometric(origin, e) ** cone, cone)
    return lon, _geographic(math.pi / 2 - 2 * F.atan(F.pow(far / abs(scale), F.lit(1 / cone))), n)


def _albers(system: System, x: Column, y: Column) -> tuple[Column, Column]:
    a, e, n = _flat(system)
    first, second, origin = _parallels(system)

    def area(lat: float) -> float:
        s = math.sin(lat)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e) if e else 2 * s

    m, q = _across(first, e), area(first)
    cone = math.sin(first) if first == second else (m**2 - _across(second, e) ** 2) / (area(second) - q)
    whole = m**2 + cone * q
    far, lon = _cone(x, y, a * math.sqrt(whole - cone * area(origin)) / cone, cone)
    beta = F.asin((whole - F.pow(far * cone / a, F.lit(2.0))) / (cone * area(math.pi / 2)))
    lat = beta
    for j, c in enumerate((e**2 / 3 + 31 * e**4 / 180 + 517 * e**6 / 5040, 23 * e**4 / 360 + 251 * e**6 / 3780, 761 * e**6 / 45360), 1):
        lat = lat + c * F.sin(2 * j * beta)
    return lon, lat


def _mercator(system: System, x: Column, y: Column) -> tuple[Column, Column]:
    a, _, n = _flat(system)
    chi = math.pi / 2 - 2 * F.atan(F.exp(-y / a))
    return x / a, chi if system.value("sphere") else _geographic(chi, n)


_KINDS = {"transverse_mercator": _transverse, "lambert": _lambert, "albers": _albers, "mercator": _mercator}


def degrees(system: System, x, y) -> Column:
    """struct(x, y): longitude and latitude of a place in the system; null where a coordinate is."""
    x, y = col(x).cast("double"), col(y).cast("double")
    if system.kind != "degrees":
        lon, lat = _KINDS[system.kind](system, (x - system.value("east")) * system.unit, (y - system.value("north")) * system.unit)
        x, y = F.degrees(lon) + system.value("middle"), F.degrees(lat)
    return F.struct(x.alias("x"), y.alias("y"))


# How .prj files name projections and their values.
_NAMES = {"transverse_mercator": "transverse_mercator", "gauss_kruger": "transverse_mercator", "lambert_conformal_conic": "lambert", "lambert_conformal_conic_2sp": "lambert", "lambert_conformal_conic_1sp": "lambert", "albers": "albers", "albers_conic_equal_area": "albers", "mercator_auxiliary_sphere": "mercator"}
_VALUES = {"false_easting": "east", "false_northing": "north", "central_meridian": "middle", "longitude_of_center": "middle", "scale_factor": "scale", "latitude_of_origin": "origin", "latitude_of_center": "origin", "standard_parallel_1": "first", "standard_parallel_2": "second"}


def from_prj(text: str | None) -> System | None:
    """The system that the text of a .prj file describes; None if it is not one of those above."""
    found = re.search(r'SPHEROID\["[^"]*",\s*([\d.]+),\s*([\d.]+)', text or "", re.I)
    if not found:
        return None
    ellipsoid = (float(found[1]), float(found[2]))
    if re.match(r"\s*GEOGCS", text, re.I):
        return System("degrees", ellipsoid)
    named = re.search(r'PROJECTION\["([^"]+)"', text, re.I)
    kind = _NAMES.get(named[1].lower()) if named else None
    units = re.findall(r'UNIT\["[^"]*",\s*([\d.eE+-]+)', text, re.I)
    if kind is None or len(units) < 2:
        return None
    values = {_VALUES[n.lower()]: float(v) for n, v in re.findall(r'PARAMETER\["([^"]+)",\s*([-+\d.eE]+)', text, re.I) if n.lower() in _VALUES}
    if kind == "mercator":
        values = {"sphere": 1.0, "middle": values.get("middle", 0.0), "east": values.get("east", 0.0), "north": values.get("north", 0.0)}
    return System(kind, ellipsoid, float(units[-1]), values)


def epsg(number: int) -> System | None:
    """Degrees, web Mercator, the UTM zones of WGS 84 and of North American 1983, and Albers for the lower states."""
    if number in (4326, 4269):
        return System("degrees", WGS84 if number == 4326 else GRS80)
    if number == 3857:
        return System("mercator", WGS84, values={"sphere": 1.0})
    if number == 5070:
        return System("albers", values={"origin": 23.0, "middle": -96.0, "first": 29.5, "second": 45.5})
    series, zone = divmod(number, 100)
    if (series in (326, 327) and 1 <= zone <= 60) or (series == 269 and 1 <= zone <= 23):
        values = {"middle": 6.0 * zone - 183, "scale": 0.9996, "east": 500_000.0, "north": 10_000_000.0 if series == 327 else 0.0}
        return System("transverse_mercator", GRS80 if series == 269 else WGS84, values=values)
    return None


def _moved(system: System, parts: str) -> Column:
    return F.transform(parts, lambda part: F.transform(part, lambda p: degrees(system, p["x"], p["y"])))


def reprojected(rows: DataFrame, parts: str, system: str, systems: Mapping[str, System | None]) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``parts``, arrays of lists of struct(x, y), are in degrees now, the rows left out).

    ``system`` is the column that names a row's system, ``systems`` says what those names mean. Rows go to the second
    frame, as they are, if their system is null or unknown, or a place of theirs comes out as no place on earth.
    """
    known = {name: s for name, s in systems.items() if s is not None}
    out = F.lit(None).cast(rows.schema[parts].dataType)
    for name, s in known.items():
        out = F.when(F.col(system) == name, _moved(s, parts)).otherwise(out)
    earthly = F.forall(F.flatten("_new"), lambda p: F.coalesce(p["x"].between(-360, 360) & p["y"].between(-90, 90), F.lit(False)))
    judged = rows.withColumn("_new", out).withColumn("_good", F.coalesce(earthly, F.lit(False)))
    return judged.filter("_good").withColumn(parts, F.col("_new")).drop("_new", "_good"), judged.filter(~F.col("_good")).drop("_new", "_good")
