"""What the operators of this subpackage share: table access, code shipping, batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile

import terrasift
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import discard, new_path, remove, stored

__all__ = ["SPACES", "alone", "discard", "id_and_text", "id_type", "new_path", "quoted", "remove", "ship", "sized", "stored", "table", "whole_row"]

#: ASCII white space, as the contracts write it.
SPACES = r"[\x20\x09-\x0D]+"

TEXTS_AT_ONCE = 1000
BYTES_AT_ONCE = 8 << 20
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(batches):
    """The batches in slices whose second column, the text, holds at most BYTES_AT_ONCE, or one text."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = b.num_rows - at
            while n > 1 and b.column(1).slice(at, n).nbytes > BYTES_AT_ONCE:
                n //= 2
            yield b.slice(at, n)
            at += n


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so tasks can import it on any executor.

    Also lowers the session's Arrow batches to TEXTS_AT_ONCE rows: rows are whole texts here, and Spark's own limit
    would hold tens of megabytes of them several times over in each task.
    """
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXTS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(terrasift.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "terrasift.zip")  # read by the driver only, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; columns with clashing names stay behind.

    Whole numbers become bigint; ids of any other type are passed through as they are.
    """
    key = F.col(id_col).cast("bigint") if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "void") else F.col(id_col)
    return docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))


def id_type(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def quoted(name: str) -> str:
    """A column's name as it stands, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> F.Column:
    """All columns as one struct ``row``, so that none clashes with an operator's own; ``row.*`` gives them back."""
    return F.struct(*map(quoted, df.columns)).alias("row")


_kept: list[dict] = []


def alone(table: dict | None = None) -> None:
    """Says in a Python worker that ``table``, what it keeps from task to task, is in use now: those that other operators
    left behind in the same worker are emptied, and their memory goes back to the system."""
    left = [t for t in _kept if t is not table and t]
    if table is not None and all(t is not table for t in _kept):
        _kept.append(table)
    if left:
        for t in left:
            t.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
