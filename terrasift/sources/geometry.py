"""Shapes as well-known binary, and a store of them whose files follow a space-filling curve.

A shape is a struct of ``kind`` (line or polygon) and ``parts``, an array of lists of struct(x, y). A polygon's parts
are closed rings; a ring that turns clockwise is the outside of a piece, and the rings after it that turn the other way
are its holes, as in shapefiles. ``encoded`` and ``decoded`` work on Arrow batches.

A store is a folder: ``data``, Parquet with the key, the binary and the box of each shape, in the order of a curve over
the boxes' middles, in small row groups, so that a window's comparisons skip most of them; and ``about``, one JSON row
that says what the data should be. ``opened`` checks that before anything is read from it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import overlaps

POINTS = "array<array<struct<x:double,y:double>>>"
SHAPE = f"struct<kind:string,parts:{POINTS}>"
DEGREES = "EPSG:4326"
_LINE, _POLYGON, _LINES, _POLYGONS = 2, 3, 5, 6
_PARTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


class Unreadable(ValueError):
    """A binary that is no line or polygon, or a store that is not what it says."""


def clockwise(ring: np.ndarray) -> bool:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) < 0


def _counted(kind: int, bodies: list[bytes]) -> bytes:
    return struct.pack("<BII", 1, kind, len(bodies)) + b"".join(bodies)


def _points(xy: np.ndarray) -> bytes:
    return struct.pack("<I", len(xy)) + np.ascontiguousarray(xy, "<f8").tobytes()


def to_binary(kind: str, parts: list[np.ndarray]) -> bytes:
    """``parts``: arrays of (x, y) rows."""
    if kind == "line":
        lines = [struct.pack("<BI", 1, _LINE) + _points(p) for p in parts]
        return lines[0] if len(lines) == 1 else _counted(_LINES, lines)
    pieces: list[list[bytes]] = []
    for ring in parts:
        if not pieces or clockwise(ring):
            pieces.append([])
        pieces[-1].append(_points(ring))
    polygons = [_counted(_POLYGON, p) for p in pieces]
    return polygons[0] if len(polygons) == 1 else _counted(_POLYGONS, polygons)


def from_binary(data: bytes) -> tuple[str, list[np.ndarray]]:
    """Either byte order; further coordinates, flagged the one way or the other, are left out."""

    def head(at: int) -> tuple[str, int, int, int]:
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
        more = bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[kind % 0x10000000 // 1000 % 4]
        return order, kind % 0x10000000 % 1000, 2 + more, at + 5 + 4 * bool(kind & 0x20000000)

    def count(order: str, at: int) -> tuple[int, int]:
        return struct.unpack_from(f"{order}I", data, at)[0], at + 4

    def points(order: str, width: int, at: int) -> int:
        n, at = count(order, at)
        end = at + 8 * width * n
        if end > len(data):
            raise Unreadable("the binary ends early")
        out.append(np.frombuffer(data, f"{order}f8", width * n, at).reshape(n, width)[:, :2])
        return end

    def shape(at: int, wanted: Sequence[int]) -> tuple[int, int]:
        order, kind, width, at = head(at)
        if kind not in wanted:
            raise Unreadable(f"kind {kind} of shape")
        if kind == _LINE:
            return points(order, width, at), kind
        n, at = count(order, at)
        for _ in range(n):
            at = points(order, width, at) if kind == _POLYGON else shape(at, (_LINE,) if kind == _LINES else (_POLYGON,))[0]
        return at, kind

    out: list[np.ndarray] = []
    try:
        _, kind = shape(0, (_LINE, _POLYGON, _LINES, _POLYGONS))
    except (struct.error, IndexError) as e:
        raise Unreadable(str(e)) from None
    return ("line" if kind in (_LINE, _LINES) else "polygon"), [p.astype(np.float64) for p in out]


def _encode(kinds: pa.Array, parts: pa.Array) -> pa.Array:
    whole, lists = parts.offsets.to_numpy(), parts.values
    ends, xy = lists.offsets.to_numpy(), lists.values
    xy = np.stack([xy.field(k).to_numpy(zero_copy_only=False) for k in "xy"], axis=1) if len(xy) else np.zeros((0, 2))
    out = []
    for i, kind in enumerate(kinds.to_pylist()):
        own = [xy[ends[k] : ends[k + 1]] for k in range(whole[i], whole[i + 1])] if kind and parts.is_valid().to_pylist()[i] else []
        out.append(to_binary(kind, own) if own else None)
    return pa.array(out, pa.binary())


def encoded(kind: Column | str, parts: Column | str) -> Column:
    """The binary of a shape; null without parts."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, lists in batches:
            yield _encode(kinds, lists)

    return run(F.lit(kind) if kind in ("line", "polygon") else kind, parts)


def decoded(binary: Column | str) -> Column:
    """struct(kind, parts, error): what a binary holds, or why it can't be read."""

    @F.arrow_udf(f"struct<kind:string,parts:{POINTS},error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            kinds, errors, valid, whole, ends, xy = [], [], [], [0], [0], []
            for value in column:
                kind, parts, error = None, [], None
                if value.is_valid:
                    try:
                        kind, parts = from_binary(value.as_py())
                    except Unreadable as e:
                        error = str(e)
                kinds.append(kind)
                errors.append(error)
                valid.append(kind is not None)
                xy += parts
                ends += [ends[-1] + n for n in np.cumsum([len(p) for p in parts]).tolist()]
                whole.append(whole[-1] + len(parts))
            flat = np.concatenate([np.zeros((0, 2)), *xy])
            places = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
            rings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)
            parts = pa.ListArray.from_arrays(pa.array(whole, pa.int32()), rings, mask=pa.array([not v for v in valid]))
            yield pa.StructArray.from_arrays([pa.array(kinds, pa.string()), parts.cast(_PARTS), pa.array(errors, pa.string())], ["kind", "parts", "error"])

    return run(binary)


def along_curve(lon: Column, lat: Column) -> Column:
    """Place on a curve that visits a square's four quarters one after another: the bits of both axes take turns."""

    def spread(c: Column, low: float, wide: float) -> Column:
        v = F.least(F.lit(65535), F.greatest(F.lit(0), F.floor((c - low) / wide * 65536))).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return v

    return spread(lon, -180.0, 360.0).bitwiseOR(F.shiftleft(spread(lat, -90.0, 180.0), 1))


def boxed(shapes: DataFrame, parts: str = "parts") -> DataFrame:
    """Adds the box of all parts."""
    places = F.flatten(parts)
    low = lambda k: F.array_min(F.transform(places, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(places, lambda p: p[k]))
    return shapes.withColumns(dict(zip(_BOX, (low("x"), low("y"), high("x"), high("y")))))


def write_store(shapes: DataFrame, path: str, key: str, files: int = 1, group_bytes: int = 1 << 20) -> None:
    """``shapes``: the key, kind, parts, in degrees. Rows with an empty key or without parts are left out."""
    kept = shapes.filter((F.trim(F.col(key).cast("string")) != "") & (F.size(F.coalesce("parts", F.array().cast(POINTS))) > 0))
    rows = boxed(kept.select(F.col(key).cast("string").alias(key), "kind", "parts"))
    rows = rows.select(key, encoded("kind", "parts").alias("geometry"), *_BOX, along_curve((F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2).alias("curve"))
    laid = rows.repartitionByRange(files, "curve").sortWithinPartitions("curve", key)
    # a group is closed every few hundred rows at most, whatever the size of a shape, and pages have their own extent
    laid.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.block.row.count.limit", 1000).parquet(f"{path}/data")
    spark = shapes.sparkSession
    about = spark.read.parquet(f"{path}/data").agg(*_about(key)).withColumns({"key": F.lit(key), "system": F.lit(DEGREES)})
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def _about(key: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(key, "geometry")), F.lit(0)).cast("string").alias("digest")]


@dataclass
class Store:
    """A store that was checked: its key and rows."""

    key: str
    data: DataFrame

    def window(self, west: float, south: float, east: float, north: float) -> DataFrame:
        """The key, kind and parts of the shapes whose box meets the window; other row groups are not read."""
        rows = self.data.filter(overlaps(west, south, east, north))
        return rows.select(self.key, decoded("geometry").alias("shape")).select(self.key, "shape.kind", "shape.parts")

    def shapes(self) -> DataFrame:
        return self.data.select(self.key, decoded("geometry").alias("shape")).select(self.key, "shape.kind", "shape.parts")


def opened(spark: SparkSession, path: str, key: str) -> Store:
    """Raises Unreadable if the store is missing, damaged or not in degrees. Reads its key and binary once."""
    try:
        about = spark.read.json(f"{path}/about").first()
        data = spark.read.parquet(f"{path}/data")
        missing = {key, "geometry", *_BOX} - set(data.columns)
        if about is None or missing:
            raise Unreadable(f"{path}: no {', '.join(sorted(missing)) or 'description'}")
        if about["system"] != DEGREES or about["key"] != key:
            raise Unreadable(f"{path}: {about['key']} in {about['system']}")
        found = data.agg(*_about(key)).first()
    except Unreadable:
        raise
    except Exception as e:  # what Spark raises for missing and broken files is no one class
        raise Unreadable(f"{path}: {str(e).splitlines()[0][:200]}") from None
    if (found["rows"], found["digest"]) != (about["rows"], about["digest"]) or not found["rows"]:
        raise Unreadable(f"{path}: {found['rows']} rows, not what was written")
    return Store(key, data)


def first_readable(sources: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[str, DataFrame, list[str]]:
    """(name, shapes, why those before were passed over) of the first source that can be read and has a shape.

    A source is a name and a function that gives key, kind and parts, for instance ``opened(...).shapes``.
    """
    refused = []
    for name, load in sources:
        try:
            shapes = load()
            if not shapes.isEmpty():
                return name, shapes, refused
            refused.append(f"{name}: no shape")
        except Exception as e:  # a damaged source must not hide the next one
            refused.append(f"{name}: {str(e).splitlines()[0][:200]}")
    raise Unreadable("; ".join(refused))


#: The columns of tract shapefiles that hold a tract's code, the newest first.
TRACT_CODES = ("GEOID", "GEOID20", "GEOID10")


def tract_shapes(records: DataFrame) -> DataFrame:
    """tract_fips, kind, parts of shapefile records (file, record, points, properties), a row for each shape."""
    code = F.coalesce(*[F.try_element_at("properties", F.lit(c)) for c in TRACT_CODES])
    rows = records.withColumns({"tract_fips": F.lpad(code, 11, "0"), "nth": F.monotonically_increasing_id()}).filter("tract_fips is not null")
    found = rows.groupBy("file", "record", "tract_fips").agg(F.array_sort(F.collect_list(F.struct("nth", "points"))).alias("p"))
    return found.select("tract_fips", F.lit("polygon").alias("kind"), F.transform("p", lambda p: p["points"]).alias("parts"))


def tracts(spark: SparkSession, store: str, shapefiles: str) -> tuple[str, DataFrame, list[str]]:
    """Tract shapes from the store or, if that is missing or damaged, from shapefiles."""
    from .shapefile import read

    return first_readable([("store", lambda: opened(spark, store, "tract_fips").shapes()), ("shapefiles", lambda: tract_shapes(read(spark, shapefiles)))])
