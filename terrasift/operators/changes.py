"""Upsert, insert-or-ignore, toggle and rekey as result frames, and an atomic replacement of a stored table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import latest_per_key


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    return latest_per_key(df, keys, order) if order else df.dropDuplicates(list(keys))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), keep: Sequence[str] = ()) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same key, by column name; of several new rows the first in ``order`` counts.

    Columns in ``keep`` retain the old value where the new one is null.
    """
    new = first_of_key(new, keys, order)
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        new = new.join(before, list(keys), "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_old_{c}")) for c in keep}).drop(*[f"_old_{c}" for c in keep])
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    new = first_of_key(new, keys, order)
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def toggle(df: DataFrame, where: Column, flag: str) -> DataFrame:
    return df.withColumn(flag, F.when(where, ~F.coalesce(F.col(flag), F.lit(False))).otherwise(F.col(flag)))


def rekey(df: DataFrame, key: str, repairs: DataFrame, old: str, new: str) -> DataFrame:
    """Replaces keys by a repair table; a repair that would meet a key already there, or another repair, is left out."""
    free = latest_per_key(repairs.join(df.select(F.col(key).alias(new)), new, "left_anti"), [new], [F.col(old)])
    free = free.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(free, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


KEPT_VERSIONS = 2


class TableStore:
    """Parquet tables below a shared folder. Every write is a new version; readers follow the newest complete one.

    The version before stays for readers that are still at it; older ones are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath() for s in self._fs.listStatus(folder)]
        return sorted(p.getName() for p in found if self._fs.exists(self._path(f"{p.toString()}/_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self._versions(name)[-1]}")

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Replaces the table; a run that fails leaves the version before in place."""
        number = int(self._versions(name)[-1].split("-")[0]) + 1 if self.exists(name) else 0
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{number:010d}-{uuid.uuid4().hex}")
        for old in self._versions(name)[:-KEPT_VERSIONS]:
            self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), keep: Sequence[str] = ()) -> DataFrame:
        return self.write(name, upsert(self.read(name), new, keys, order, keep) if self.exists(name) else first_of_key(new, keys, order))

    def insert_ignore(self, name: str, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
        return self.write(name, insert_ignore(self.read(name), new, keys, order) if self.exists(name) else first_of_key(new, keys, order))
