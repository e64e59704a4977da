"""Incremental loads by Structured Streaming: new files in a folder become upserts; repeated contents are dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.parsing import posted
from ..operators.snapshots import SnapshotTable


def stream_of_files(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def fresh(rows: DataFrame, as_of: Column, posted_col: str = "posted_at") -> DataFrame:
    """rows with posted_at as a timestamp and ``posted_days_ago`` at ``as_of``."""
    return rows.withColumn("p", posted(as_of, F.col(posted_col).cast("string"))).withColumns({posted_col: F.col("p.posted_at"), "posted_days_ago": F.col("p.posted_days_ago")}).drop("p")


def without_repeats(rows: DataFrame, content: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each content once within ``delay`` of event time; state older than that is let go."""
    return rows.withColumn("content_sha1", F.sha1(F.col(content))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_sha1"])


class _FirstOfContent(StatefulProcessor):
    """Per content the size and name of the file that stands for it; a row goes out when there is none yet, or an earlier one came late."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "size long, name string", self.days * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = lambda size, name: (size, name.lower(), name)
        best = None
        for part in rows:
            for row in part.itertuples(index=False):
                if best is None or order(row.size, row.name) < order(best.size, best.name):
                    best = row
        old = self.first.get() if self.first.exists() else None
        if best is not None and (old is None or order(best.size, best.name) < order(*old)):
            self.first.update((int(best.size), best.name))
            yield pd.DataFrame([{"content_sha1": key[0], "size": int(best.size), "name": best.name, "path": best.path, "corrects": old[1] if old else None}])

    def close(self) -> None:
        pass


def first_files(files: DataFrame, content: str, days: int = 30) -> DataFrame:
    """(content_sha1, size, name, path, corrects) of a stream of files: the file that stands for each content, first by size, lower-case name and name.

    When an earlier file of a known content arrives late, it goes out too, with the name it takes the place of in ``corrects``; so the last row of
    a content is what ``maintain.first_of_content`` finds over all files. Files with a null size, name or content take no part. State, a size and a
    name a content, is let go ``days`` after its last change; a content that comes again after that counts as new. Only hashes, sizes, names and
    paths are shuffled; a content's rows of a batch are streamed through one task. State values need
    ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider. With the trigger ``availableNow``, ``spark.sql.streaming.noDataMicroBatches.enabled`` must be false, as the time
    limit alone starts batches without end.
    """
    provider = files.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if "RocksDB" not in provider:
        raise ValueError("spark.sql.streaming.stateStore.providerClass must be the RocksDB provider")
    c = F.col
    rows = files.select(F.sha1(c(content)).alias("content_sha1"), c("size").cast("long").alias("size"), c("name").cast("string").alias("name"), c("path").cast("string").alias("path")).filter("content_sha1 is not null and size is not null and name is not null")
    out = T.StructType().add("content_sha1", "string").add("size", "long").add("name", "string").add("path", "string").add("corrects", "string")
    return rows.groupBy("content_sha1").transformWithStateInPandas(_FirstOfContent(days), out, "Update", "ProcessingTime")


def stream_upserts(rows: DataFrame, table: SnapshotTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Each micro-batch, prepared, into the table: of each key the newest row by the table's time stamp stays, in whatever order they come.

    A batch that runs again after a failure has its number in the table's manifest already and changes nothing.
    """

    def load(batch: DataFrame, number: int) -> None:
        table.commit(prepare(batch) if prepare else batch, batch=number)

    writer = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
