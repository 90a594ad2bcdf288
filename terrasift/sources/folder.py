"""Folders of exports whose headers and encodings drift, read once.

All CSV files of a tree are scanned together, without headers, byte for byte, into one table of (file, row number,
values), stored in the shared folder. What a file is, its header, its encoding and its place in the tree, is worked out
from that table; files are then named by header, a frame for each different header and folder, and handed to a parser.
So every byte of the source is read once however many files and layouts there are, and a parser runs once for a layout,
not for a file: ``source_file`` and ``modified`` are columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import union_all
from ..operators.shared import stored

COLUMNS = 512
_OWN = ("source_file", "source_folder", "modified")


@dataclass
class Layout:
    """Files of one folder with one header: ``rows`` has the header's columns as text, and source_file, source_folder
    (the path below the root) and modified (a timestamp)."""

    folder: str
    header: list[str]
    files: list[str]
    rows: DataFrame


def date_in_name(name: Column) -> Column:
    """The first date, from 2000 to 2030, in a file's name: year, month and day, with dashes or underscores or none."""
    found = F.lit(None).cast("date")
    for pattern in (r"(\d{4})(\d{2})(\d{2})", r"(\d{4})[_\-](\d{2})[_\-](\d{2})"):
        hits = F.regexp_extract_all(name, F.lit(pattern), F.lit(0))
        dates = F.transform(hits, lambda h: F.regexp_replace(h, r"[_\-]", "").cast("string"))
        days = F.transform(dates, lambda d: F.try_to_date(d, "yyyyMMdd"))
        good = F.filter(days, lambda d: d.isNotNull() & F.year(d).between(2000, 2030))
        found = F.coalesce(F.get(good, F.lit(0)), found)
    return found


def scanned(spark: SparkSession, path: str, columns: int = COLUMNS) -> DataFrame:
    """file, folder, path, modified, utf8, width (of its longest row), nth (0 is the header), cells: every row of every CSV file below a folder.

    Raises if a row has more than ``columns`` values. A file that is not UTF-8 is taken as Latin-1.
    """
    names = [f"c{i}" for i in range(columns + 1)]
    reader = spark.read.options(header=False, multiLine=True, quote='"', escape='"', encoding="ISO-8859-1", recursiveFileLookup=True, pathGlobFilter="*.[cC][sS][vV]", mode="PERMISSIVE")
    raw = reader.schema(", ".join(f"{n} string" for n in names)).csv(path)
    # a file is one task's, in order, so row numbers grow along it; latin-1 keeps every byte as it is
    cells = F.array(*names)
    last = F.array_max(F.transform(cells, lambda c, i: F.when(c.isNotNull(), i)))
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.monotonically_increasing_id().alias("id"), F.slice(cells, F.lit(1), F.coalesce(last, F.lit(0)) + 1).alias("cells"))
    rows = stored(rows)
    valid = F.forall("cells", lambda c: F.coalesce(F.is_valid_utf8(F.encode(c, "ISO-8859-1").cast("string")), F.lit(True)))
    files = rows.groupBy("path").agg(F.min("id").alias("first"), F.bool_and(valid).alias("utf8"), F.max(F.size("cells")).alias("width"))
    files = stored(files)
    if wide := files.filter(F.col("width") > columns).first():
        raise ValueError(f"{wide['path']}: a row of more than {columns} values")
    told = rows.join(files, "path")
    text = F.when(F.col("utf8"), F.transform("cells", lambda c: F.decode(F.encode(c, "ISO-8859-1"), "UTF-8"))).otherwise(F.col("cells"))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    plain = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    below = F.regexp_extract(plain, r"^(.*)/[^/]*$", 1)
    folder = F.regexp_replace(F.element_at(F.split(F.concat(below, F.lit("/")), f"/\\Q{root}\\E/"), -1), "^/+|/+$", "")
    return told.select(F.element_at(F.split(plain, "/"), -1).alias("file"), folder.alias("folder"), "path", "modified", "utf8", "width", (F.col("id") - F.col("first")).alias("nth"), text.alias("cells"))


def layouts(spark: SparkSession, path: str, columns: int = COLUMNS) -> list[Layout]:
    """The different headers of the folders below ``path``. Only headers and file names come to the driver."""
    rows = scanned(spark, path, columns)
    clean = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", "")))
    heads = rows.filter("nth = 0").select("folder", "file", "path", "width", clean.alias("header"))
    found: dict[tuple, list] = {}
    for r in heads.orderBy("path").collect():
        found.setdefault((r["folder"], tuple(r["header"])), []).append(r)
    out = []
    for (folder, header), files in found.items():
        names = _unique(header + ("",) * (max(r["width"] for r in files) - len(header)))
        own = rows.filter(F.col("path").isin([r["path"] for r in files]) & (F.col("nth") > 0) & F.exists("cells", lambda c: c.isNotNull()))
        cells = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]
        out.append(Layout(folder, names, [r["file"] for r in files], own.select(*cells, F.col("file").alias("source_file"), F.col("folder").alias("source_folder"), "modified")))
    return out


def _unique(header: tuple[str, ...]) -> list[str]:
    """Column names that differ, whatever their case, from each other and from those of the source."""
    out, seen = [], {n.lower() for n in _OWN}
    for i, name in enumerate(header):
        name = name or f"column {i + 1}"
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def load_tree(spark: SparkSession, path: str, parse: Callable[[Layout], DataFrame | None], columns: int = COLUMNS) -> tuple[DataFrame | None, list[str]]:
    """(what ``parse`` makes of all layouts, put together by name; the files of the layouts that it refused)."""
    frames, refused = [], []
    for layout in layouts(spark, path, columns):
        if (found := parse(layout)) is None:
            refused += [f"{layout.folder}/{f}".lstrip("/") for f in layout.files]
        else:
            frames.append(found)
    return (union_all(*frames) if frames else None), refused


def listings(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """Rows of houses with snapshot_date from a folder of listing exports; and the files without coordinates."""
    from . import property as P

    def parse(layout: Layout) -> DataFrame | None:
        named = F.coalesce(date_in_name(F.col("source_file")), F.col("modified").cast("date"))
        return P.listings(layout.rows, F.col("source_file"), named)

    return load_tree(spark, path, parse)


def sales(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """Rows of sold_homes from a folder of county exports of any known layout, each sale once."""
    from . import property as P
    from ..operators.relational import latest_per_key

    found, refused = load_tree(spark, path, lambda layout: P.sales(layout.rows, F.col("source_file")))
    if found is None:
        return None, refused
    return latest_per_key(found, ["sale_id"], [F.col("record_date").desc_nulls_last(), F.col("sold_price").desc_nulls_last(), F.col("source_file")]), refused


def incidents(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """Rows of crime_incidents from a tree with a folder for each city, each incident once; files elsewhere are refused."""
    from . import incidents as I

    def parse(layout: Layout) -> DataFrame | None:
        city = layout.folder.split("/")[0].strip().lower()
        return I.incidents(layout.rows, city, F.col("source_file")) if city in I.CITIES else None

    found, refused = load_tree(spark, path, parse)
    return (None if found is None else I.combined(found)), refused
