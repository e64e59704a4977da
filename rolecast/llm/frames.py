"""Small helpers shared by the text operators: shared storage, column checks and batch slicing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once. A longer text is still handled whole, alone.
SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder in ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, a new temporary folder serves a local master; on a cluster that is an error, as
    executors could not read each other's files.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if place is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


#: A key with this share of all rows or more (and ``HOT_ROWS`` of them) is joined by broadcast; there are at most as many such keys.
HOT_SHARE = 100_000
HOT_ROWS = 1_000


def fresh(name: str, taken: list[str]) -> str:
    """The name, or it with underscores behind, so that no column of ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined with right, whose ``key`` is unique and whose column ``n`` counts the left rows of it, ``total`` in all.

    Keys with many rows are joined by broadcast, as no more than ``HOT_SHARE`` of them can exist; the others, each
    of which is small, by a shuffle. No task reads all rows of a hot key.
    """
    least = max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = right.filter(F.col(n) >= least).drop(n), right.filter(F.col(n) < least).drop(n)
    few = F.broadcast(hot)
    return left.join(few, key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on ``keys``, where neither need be unique and left may have any number of rows of a key.

    A key of many left rows is dealt by the hash of the columns ``spread`` into shares of about the same size, and
    right's rows of it are repeated for each share. Shares of all keys together are no more than twice ``HOT_SHARE``.
    """
    total = left.count()
    least = max(HOT_ROWS, total // HOT_SHARE)
    n, share = fresh("__n", left.columns + right.columns), fresh("__share", left.columns + right.columns)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) >= least)
    hot = F.broadcast(cut(hot.select(*keys, F.ceil(F.col(n) / least).cast("long").alias(n))))
    shares = F.coalesce(F.col(n), F.lit(1).cast("long"))
    dealt = left.join(hot, keys, "left").withColumn(share, F.pmod(F.xxhash64(*spread), shares)).drop(n)
    repeated = right.join(hot, keys, "left").withColumn(share, F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop(n)
    return dealt.join(repeated, [*keys, share], how).drop(share)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables by Spark's own reader, so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with batches of ``BATCH_ROWS`` rows at most: texts are long, and a task holds a few batches
    on either side of the pipe."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; every text is whole in one range."""
    n = len(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i in range(n):
        total += int(sizes[i])
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < n:
        yield start, n
