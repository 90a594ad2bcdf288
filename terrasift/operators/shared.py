"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; ``clear`` removes it, at the latest when Python ends.

    Where that setting is unset, one machine (a local master) has a temporary folder; a cluster is an error, because
    its executors could not read a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-")
        _folders[sc.applicationId] = f"{named.rstrip('/')}/terrasift-{sc.applicationId}"
        atexit.register(_clear_quietly, spark)
    return _folders[sc.applicationId]


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table: its lineage is cut, a lost executor loses nothing of it, and Spark knows its size."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Removes the files of ``stored`` frames that nothing will read again."""
    for df in frames:
        if df is not None and (path := getattr(df, "_stored_at", None)):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. Frames that read them can't be used any more."""
    if path := _folders.pop(spark.sparkContext.applicationId, None):
        remove(spark, path)


def _clear_quietly(spark: SparkSession) -> None:
    try:
        clear(spark)
    except Exception:  # the session is closed already  # noqa: BLE001
        pass
