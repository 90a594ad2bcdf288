"""Incremental loading: new files of a drop folder upsert the current rows and add to the history.

The batch rules hold for every micro-batch: rows are keyed by content, so a file that comes again changes nothing. Into
a ``BucketStore`` a micro-batch is committed with its number, so one that Spark repeats is not even looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.buckets import BucketStore
from ..operators.changes import TableStore
from ..operators.shared import discard, stored


def watch(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(folder)


def upsert_stream(stream: DataFrame, store: TableStore | BucketStore, table: str, keys: Sequence[str], checkpoint: str, order: Sequence[Column] = (), history: str | None = None, history_keys: Sequence[str] = ()) -> StreamingQuery:
    """Runs until the folder has nothing new."""

    def write(batch: DataFrame, number: int) -> None:
        batch = stored(batch)
        named = {"source": checkpoint, "batch": number} if isinstance(store, BucketStore) else {}
        store.upsert(table, batch, keys, order, **named)
        if history:
            store.insert_ignore(history, batch, history_keys, order, **named)
        discard(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
