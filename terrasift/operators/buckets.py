"""Keyed tables in buckets: an upsert rewrites only the buckets that its keys fall into.

A table is a folder: ``data`` holds Parquet, a folder for each bucket of each write, and ``manifests`` a small JSON file
for each version, which lists the folder of every bucket, what was committed by whom, and the schema. A version is
committed by creating the next manifest, which fails if someone else has: then the work is done again upon theirs. So
readers see whole versions, and a run that is lost leaves only files that no manifest names, which later writes remove.

A batch can have a number: of one source, numbers up to the last committed change nothing, so a stream that repeats a
batch, or a run that starts over, is safe.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .changes import first_of_key, upsert
from .shared import discard, stored

KEPT_VERSIONS = 3
_BUCKET = "_bucket"


class Overtaken(RuntimeError):
    """Others committed again and again while this write was at work."""


@dataclass
class Manifest:
    """``buckets``: number -> folder; ``batches``: source -> last batch."""

    keys: list[str]
    count: int
    schema: str
    buckets: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    version: int = 0


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, count: int = 64):
        self.spark, self.root, self.count = spark, root.rstrip("/"), count
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils

    # manifests

    def _listed(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _numbers(self, name: str) -> list[int]:
        return [int(n[:-5]) for n in self._listed(f"{self.root}/{name}/manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def _load(self, name: str, number: int) -> Manifest:
        stream = self._fs.open(self._path(f"{self.root}/{name}/manifests/{number:010d}.json"))
        try:
            return Manifest(**json.loads(self._text.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def manifest(self, name: str) -> Manifest | None:
        numbers = self._numbers(name)
        return self._load(name, numbers[-1]) if numbers else None

    def _commit(self, name: str, new: Manifest) -> bool:
        """Whether this was the first to commit the version."""
        at = f"{self.root}/{name}/manifests/{new.version:010d}.json"
        try:
            stream = self._fs.create(self._path(at), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            stream.close()
        return True

    def _tidied(self, name: str) -> None:
        """Removes manifests beyond the last few, and folders of writes that older manifests alone name."""
        numbers = self._numbers(name)
        old = numbers[:-KEPT_VERSIONS]
        gone = {w for n in old for w in self._load(name, n).buckets.values()}
        for n in numbers[-KEPT_VERSIONS:]:
            gone -= set(self._load(name, n).buckets.values())
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        for n in old:
            self._fs.delete(self._path(f"{self.root}/{name}/manifests/{n:010d}.json"), False)

    # tables

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def _read(self, manifest: Manifest, only: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        folders = [f for b, f in manifest.buckets.items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """The newest version. It stays readable until KEPT_VERSIONS writes later."""
        if (manifest := self.manifest(name)) is None:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return self._read(manifest)

    def upsert(self, name: str, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), keep: Sequence[str] = (), source: str | None = None, batch: int | None = None) -> DataFrame:
        """``changes.upsert`` of the buckets that ``new`` has keys in. Columns of ``new`` that the table lacks are added."""
        return self._changed(name, new, keys, order, lambda old, rows: upsert(old, rows, keys, keep=keep), source, batch)

    def insert_ignore(self, name: str, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), source: str | None = None, batch: int | None = None) -> DataFrame:
        """Only rows whose key the table doesn't have."""
        fresh = lambda old, rows: old.unionByName(rows.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
        return self._changed(name, new, keys, order, fresh, source, batch)

    def _changed(self, name: str, new: DataFrame, keys: Sequence[str], order: Sequence[Column], change: Callable[[DataFrame, DataFrame], DataFrame], source: str | None, batch: int | None, tries: int = 5) -> DataFrame:
        rows = stored(first_of_key(new, keys, order))
        try:
            for _ in range(tries):
                before = self.manifest(name)
                if before and source is not None and batch is not None and batch <= before.batches.get(source, -1):
                    return self._read(before)
                after = self._written(name, rows, list(keys), change, before)
                if source is not None and batch is not None:
                    after.batches[source] = batch
                if self._commit(name, after):
                    self._tidied(name)
                    return self._read(after)
                for folder in set(after.buckets.values()) - set(before.buckets.values() if before else ()):
                    self._fs.delete(self._path(folder), True)
            raise Overtaken(f"{name}: {tries} commits by others")
        finally:
            discard(rows)

    def _written(self, name: str, rows: DataFrame, keys: list[str], change, before: Manifest | None) -> Manifest:
        if before and before.keys != keys:
            raise ValueError(f"{name} has the keys {before.keys}, not {keys}")
        count = before.count if before else self.count
        bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")
        touched = [str(r[0]) for r in rows.select(bucket).distinct().collect()]  # at most ``count``
        old = self._read(before, touched) if before else rows.limit(0)
        merged = change(old, rows).withColumn(_BUCKET, bucket)
        schema = StructType([f for f in merged.schema.fields if f.name != _BUCKET])
        place = f"{self.root}/{name}/data/{uuid.uuid4().hex}"
        merged.repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(place)
        written = {n.split("=")[1]: f"{place}/{n}" for n in self._listed(place) if n.startswith(f"{_BUCKET}=")}
        kept = {b: f for b, f in (before.buckets if before else {}).items() if b not in touched}
        return Manifest(keys, count, schema.json(), kept | written, dict(before.batches) if before else {}, before.version + 1 if before else 0)


def in_chunks(store: BucketStore, name: str, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], chunks: int) -> int:
    """``work`` on the rows whose key the table lacks, a share of 1/``chunks`` at a time; each share's result is
    committed before the next begins, so a run that is interrupted goes on where it stopped. How many chunks ran."""
    todo = rows if not store.exists(name) else rows.join(store.read(name).select(key), key, "left_anti")
    todo, ran = stored(todo), 0
    for n in range(chunks):
        part = todo.filter(F.pmod(F.xxhash64(key), F.lit(chunks)) == n)
        if not part.isEmpty():
            store.upsert(name, work(part), [key])
            ran += 1
    discard(todo)
    return ran
