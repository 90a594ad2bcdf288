"""Readers for exports whose headers drift: a logical field is the first of its spellings that the file has."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.relational import union_all


def folded(name: str) -> str:
    return re.sub(r"[\s_.﻿]", "", name).lower()


def resolve(header: Sequence[str], wanted: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """logical field -> column of the file, whatever the case, blanks, underscores and stops."""
    have = {}
    for name in header:
        have.setdefault(folded(name), name)
    found = {field: next((have[folded(s)] for s in spellings if folded(s) in have), None) for field, spellings in wanted.items()}
    return {field: name for field, name in found.items() if name is not None}


def csv_parts(spark: SparkSession, path: str, **options) -> list[DataFrame]:
    """The CSV files of a file, pattern or folder tree, one frame for all files of the same header and encoding.

    UTF-8 with or without a byte order mark; a file that is not UTF-8 is read as Latin-1. All columns are text. Only
    the files' paths and headers come to the driver; a file is looked at whole once, by one task, to judge its encoding.
    """
    content = F.expr("cast(content as string)")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").format("binaryFile").load(path)
    looked = files.select("path", F.is_valid_utf8(content).alias("utf8"), F.substring_index(content, "\n", 1).alias("header"))
    groups: dict[tuple[str, bool], list[str]] = {}
    for r in looked.orderBy("path").collect():
        groups.setdefault((r["header"].strip("\ufeff\r"), r["utf8"]), []).append(r["path"])
    opened = spark.read.options(header=True, multiLine=True, quote='"', escape='"', **options)
    return [opened.option("encoding", "UTF-8" if utf8 else "ISO-8859-1").csv(paths) for (_, utf8), paths in groups.items()]


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """All files of ``csv_parts`` as one frame, by column name, with nulls for the columns that a file lacks."""
    if not (parts := csv_parts(spark, path, **options)):
        raise FileNotFoundError(f"no CSV file at {path}")
    return union_all(*parts)


def read_excel(path: str, spark: SparkSession, **options) -> DataFrame:
    """A workbook's first sheet, through pandas on the driver: workbooks are small, and Spark has no reader for them."""
    import pandas as pd

    frame = pd.read_excel(path, dtype=str, **options)
    return spark.createDataFrame(frame.where(frame.notna(), None))


def named(df: DataFrame, wanted: Mapping[str, Sequence[str]], required: Sequence[str] = (), source: str | Column | None = None) -> DataFrame | None:
    """The wanted fields under their logical names, and ``source_file``; None if a required one is missing.

    Columns that are not wanted are never read: the selection reaches the file scan.
    """
    found = resolve(df.columns, wanted)
    if any(field not in found for field in required):
        return None
    file = source if isinstance(source, Column) else F.lit(source) if source is not None else F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.select(*[F.col(f"`{name}`").alias(field) for field, name in found.items()], file.alias("source_file"))


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def joined(df: DataFrame, *names: str, sep: str = " ") -> Column:
    """The texts of the columns that are there, blanks left out."""
    return F.concat_ws(sep, *[S.null_if_blank(n) for n in names if n in df.columns])


def packed(df: DataFrame, known: Sequence[str]) -> Column:
    """All other columns as one JSON text, without those that are null."""
    rest = [c for c in df.columns if c not in known]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit("{}")


def json_rows(df: DataFrame) -> DataFrame:
    """value: each row as JSON with nulls kept; numbers that JSON has no form for become null."""
    safe = [S.json_safe(c).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def preview(df: DataFrame, rows: int = 50) -> tuple[list, int]:
    """The first rows, and the number of all."""
    return df.limit(rows).collect(), df.count()
