"""What the two classifiers share: the held-out rule, bounded samples and the choice of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import counted, vectors
from .frames import cut, map_batches


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Bytes of texts that a task holds before it hands on the best of each id so far.
HELD_BYTES = 16 << 20


def _best_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (sample_id, label, hash, text): of each id the text of the least hash among those that this task holds at once."""
    best: dict = {}

    def out() -> pa.RecordBatch:
        rows = [(i, *row) for i, row in best.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["sample_id", "label", "hash", "text"])

    kinds, held = [], 0
    for batch in batches:
        kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.string()]
        ids, labels, hashes = (batch.column(i).to_pylist() for i in range(3))
        for i, label, h, text in zip(ids, labels, hashes, batch.column(3)):
            if i not in best or h < best[i][1]:
                text = text.as_py()
                held += len(text or "") - (len(best[i][2] or "") if i in best else 0)
                best[i] = (label, h, text)
        if held > HELD_BYTES:
            yield out()
            best, held = {}, 0
    if best:
        yield out()


def _one_text(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(sample_id, label, text) of the ids(sample_id, label) in both: of an id that stands several times, the text of the least hash.

    A task hands on the best of its own rows, so an id however often it stands is a row for each task; the few rows left, whose
    number is known, are put in order by their hash without their texts.
    """
    found = rows.join(F.broadcast(ids), "sample_id").select("sample_id", "label", F.xxhash64("text").alias("hash"), "text")  # ids: at most max_rows
    kind = found.schema["sample_id"].dataType.simpleString()
    some = cut(map_batches(found, _best_texts, f"sample_id {kind}, label int, hash long, text string"))
    least = some.groupBy("sample_id").agg(F.min(F.col("hash")).alias("hash"))
    once = some.select("sample_id", "hash", "label", "text").withColumn("row", F.monotonically_increasing_id())
    first = once.join(F.broadcast(least), ["sample_id", "hash"]).groupBy("sample_id").agg(F.min("row").alias("row"))
    return once.join(F.broadcast(first), ["sample_id", "row"]).select("sample_id", "label", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sample_id, label, text) of at most ``max_rows`` labelled ids that aren't held out, one row each, the same ones on every run.

    Ids with contradicting labels, and null labels, are left out.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("sample_id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .filter("label = other")
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(max_rows)
        .select("sample_id", F.col("label").cast("int").alias("label"))
    )
    return _one_text(docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).cast("string").alias("text")), known)


def unlabelled_sample(docs: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sample_id, text) of at most ``max_rows`` ids that aren't held out, one row each, whatever their labels."""
    ids = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("sample_id")).distinct()
    ids = ids.orderBy(F.xxhash64("sample_id", F.lit(7)), "sample_id").limit(max_rows).withColumn("label", F.lit(0))
    return _one_text(docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).cast("string").alias("text")), ids)


def choose(sample: DataFrame, most: int, form: bool, least_texts: int = 3) -> np.ndarray:
    """The ``most`` features whose share of texts differs most between the labels 1 and 0, by its z value."""
    counts = counted(sample, form)
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = max(totals.get(1, 0), 1), max(totals.get(0, 0), 1)
    both = counts.groupBy("feature").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    share = (F.col("a") + F.col("b") + 1) / F.lit(pos + neg + 2)
    z = F.abs(F.col("a") / pos - F.col("b") / neg) / F.sqrt(share * (1 - share))
    best = both.filter(F.col("a") + F.col("b") >= least_texts).orderBy(z.desc(), "feature").limit(most).select("feature")
    return np.array(sorted(r["feature"] for r in best.collect()), np.int64).view(np.uint64)


def matrix(sample: DataFrame, chosen: np.ndarray, form: bool) -> tuple[np.ndarray, np.ndarray]:
    """(counts, labels) of a bounded sample, dense."""
    chosen = np.sort(chosen)
    rows = vectors(sample, chosen, form).toArrow()
    x = np.zeros((rows.num_rows, max(1, len(chosen))), np.float32)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"])):
        if len(at):
            x[i, at.values.to_numpy(zero_copy_only=False)] = n.values.to_numpy(zero_copy_only=False)
    return x, rows["label"].to_numpy().astype(np.float64) if rows.num_rows else np.zeros(0)


def adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam from zero; gradient(w) is the loss's gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
