"""Shapefiles in geographic coordinates, read by the executors: one file, with its attribute table, is one task.

Lines and polygons only (with or without measures); null shapes are left out. Coordinates are taken as they are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTED = {3, 5, 13, 15, 23, 25}


def shapes(data: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """The parts of every record, in order; None for a record without a shape."""
    out, at = [], 100
    while at + 8 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        body, at = at + 8, at + 8 + 2 * words
        if struct.unpack_from("<i", data, body)[0] not in _PARTED:
            out.append(None)
            continue
        parts, points = struct.unpack_from("<2i", data, body + 36)
        starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", data, body + 44 + 4 * parts)
        xy = list(zip(flat[::2], flat[1::2]))
        out.append([xy[a:b] for a, b in zip(starts, starts[1:])])
    return out


def attributes(data: bytes) -> list[dict[str, str | None]]:
    """The rows of a dBase table as text."""
    rows, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    out = []
    for i in range(rows):
        at, row = head + i * width + 1, {}
        for name, size in fields:
            row[name] = data[at : at + size].decode("utf-8", "replace").strip() or None
            at += size
        out.append(row)
    return out


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for stem, shp, dbf in zip(frame["stem"], frame["shp"], frame["dbf"]):
            table = attributes(dbf) if dbf is not None else []
            rows = [
                (stem, i, [{"x": x, "y": y} for x, y in part], table[i] if i < len(table) else {})
                for i, parts in enumerate(shapes(shp))
                for part in parts or []
            ]
            yield pd.DataFrame(rows, columns=["file", "record", "points", "properties"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """file, record, points, properties: a row for each part of each shape of the folder's files, at any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = found.select(F.regexp_replace("path", r"(?i)\.(shp|dbf)$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    pairs = found.filter("kind = 'shp'").select("stem", F.col("content").alias("shp")).join(found.filter("kind = 'dbf'").select("stem", F.col("content").alias("dbf")), "stem", "left")
    return pairs.mapInPandas(_parsed, "file string, record int, points array<struct<x:double,y:double>>, properties map<string,string>")
