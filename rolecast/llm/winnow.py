"""Benchmark decontamination by winnowing.

Texts become words; every run of ``gram`` = 5 words has a hash, and of any ``window`` - ``gram`` + 1 = 6
successive hashes the least is kept (the last of equals), once per place. Two texts that share 10 words share
the six hashes in them, so they keep the same least one: every shared window has a common fingerprint.
Fingerprints of documents and of benchmark items are joined, and each hit is extended: of the windows around
it, those that occur in the item are found by the hash of all their words. An item of fewer than ``window``
words is one window; its length is too short for the guarantee, so documents keep all runs of that length.

The benchmark's windows are broadcast as two sorted arrays if there are at most ``broadcast_windows`` (16
bytes each); beyond that the same steps run as shuffled joins of fingerprints, then of windows. Both give the
same rows. Equality of words is equality of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, join_salted, map_batches, text_slices
from .tokens import Words, grams, letter_words, whole, words

WINDOW = 10
GRAM = 5
BROADCAST_WINDOWS = 2_000_000


def winnowed(g: np.ndarray, first: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Places of the grams kept: for each window of words within a row, its least gram, the last of equals."""
    span = window - gram + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, span):
        less = g[j : j + n] <= best
        best[less] = g[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at[whole(first, n, window)])


def run_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words within a row."""
    g = grams(w.hashes(), size)
    at = np.flatnonzero(whole(w.first, len(g), size))
    return at, g[at]


def _item_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(1)):
                ids, texts = batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a)
                w = words(texts, letter_words())
                h, sizes = w.hashes(), np.diff(w.first)
                full_at, full = run_hashes(w, window)
                g = grams(h, gram)
                kept = winnowed(g, w.first, gram, window)
                parts = [(w.doc[full_at], full, window, 0), (w.doc[kept], g[kept], gram, 1)]
                for size in np.unique(sizes[(sizes > 0) & (sizes < window)]):
                    at, x = run_hashes(w, int(size))
                    one = sizes[w.doc[at]] == size
                    parts.append((w.doc[at][one], x[one], int(size), 0))
                for doc, x, size, kind in parts:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(doc)), pa.array(x.view(np.int64)), pa.array(np.full(len(x), size, np.int32)), pa.array(np.full(len(x), kind, np.int32))],
                        ["item", "hash", "size", "kind"],
                    )

    return run


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item, hash, size, kind): kind 0 the windows of each item, of ``size`` words; kind 1 its fingerprints."""
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, _item_rows(window, gram), "item string, hash long, size int, kind int").distinct()


class Index:
    """The benchmark's fingerprints and windows, sorted; items by their number in order of their ids as strings."""

    def __init__(self, rows: pa.Table) -> None:
        kind, size = rows["kind"].to_numpy(), rows["size"].to_numpy()
        h, item = rows["hash"].to_numpy().view(np.uint64), rows["item"].to_numpy(zero_copy_only=False)
        self.prints = np.unique(h[kind == 1])
        win = kind == 0
        self.ids, number = np.unique(item[win], return_inverse=True)  # Python strings, however long some are
        self.by_size = {}
        for s in np.unique(size[win]):
            one = size[win] == s
            order = np.lexsort((number[one], h[win][one]))
            self.by_size[int(s)] = (h[win][one][order], number[one][order])


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def window_hits(w: Words, index: Index, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, size, item number) of every occurrence of a window, reached from common fingerprints."""
    at, sizes, items = [], [], []
    h = w.hashes()
    for size, (values, number) in index.by_size.items():
        g = grams(h, size)
        ok = whole(w.first, len(g), size)
        if size == window:
            kept_g = grams(h, gram)
            kept = winnowed(kept_g, w.first, gram, window)
            kept = kept[_member(index.prints, kept_g[kept])]
            near = (kept[:, None] - np.arange(window - gram + 1)).ravel()  # windows that hold the fingerprint
            near = np.unique(near[near >= 0])
            near = near[near < len(g)]
            starts = near[ok[near]]
        else:
            starts = np.flatnonzero(ok)
        lo, hi = np.searchsorted(values, g[starts], "left"), np.searchsorted(values, g[starts], "right")
        n = hi - lo
        at.append(np.repeat(starts, n))
        sizes.append(np.full(n.sum(), size))
        items.append(number[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())])
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (at, sizes, items))


def covered(n: int, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of n words lie in some run."""
    delta = np.bincount(at, minlength=n + 1) - np.bincount(at + sizes, minlength=n + 1)[: n + 1]
    return np.cumsum(delta)[:n] > 0


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string"


def _digest(names) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _match(index: Index, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(1)):
                w = words(batch.column(1).slice(a, z - a), letter_words())
                at, sizes, items = window_hits(w, index, window, gram)
                hit = np.bincount(w.doc[covered(len(w.start), at, sizes)], minlength=z - a)
                n_items, digests = np.zeros(z - a, np.int64), np.full(z - a, _digest(()), object)
                pairs = np.unique(np.stack([w.doc[at], items], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                for doc in np.unique(pairs[:, 0]):
                    mine = pairs[pairs[:, 0] == doc, 1]
                    n_items[doc], digests[doc] = len(mine), _digest(index.ids[mine])
                cols = [pa.array(np.diff(w.first)), pa.array(hit), pa.array(n_items), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *cols], ["id", "n_words", "n_hit", "n_items", "items_sha256"])

    return run


def _doc_prints(window: int, gram: int, short: dict[int, np.ndarray | None]):
    """(row, hash, size, at, around): fingerprints with the windows around them, and runs of the sizes of short items.

    ``short`` has the sorted hashes that items have of a size, or None where all runs of that size go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(1)):
                w = words(batch.column(1).slice(a, z - a), letter_words())
                h = w.hashes()
                g, big = grams(h, gram), grams(h, window)
                ok = whole(w.first, len(big), window)
                kept = winnowed(g, w.first, gram, window)
                near = kept[:, None] - np.arange(window - gram + 1)
                fine = (near >= 0) & (near < len(big))
                fine &= ok[np.clip(near, 0, max(0, len(big) - 1))] if len(big) else False
                row = batch.column(0).slice(a, z - a)
                counts = fine.sum(1)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                at = pa.ListArray.from_arrays(pa.array(ends), pa.array((near - w.first[w.doc[kept]][:, None])[fine]))
                hs = pa.ListArray.from_arrays(pa.array(ends), pa.array(big[near[fine]].view(np.int64) if len(big) else np.zeros(0, np.int64)))
                cols = [row.take(pa.array(w.doc[kept])), pa.array(g[kept].view(np.int64)), pa.array(np.full(len(kept), window, np.int32)), at, hs]
                yield pa.RecordBatch.from_arrays(cols, ["row", "hash", "size", "at", "around"])
                for size, values in short.items():
                    p, x = run_hashes(w, size)
                    if values is not None:
                        met = _member(values, x)
                        p, x = p[met], x[met]
                    one = np.arange(len(p) + 1, dtype=np.int32)
                    cols = [row.take(pa.array(w.doc[p])), pa.array(x.view(np.int64)), pa.array(np.full(len(p), size, np.int32)), pa.ListArray.from_arrays(pa.array(one), pa.array(p - w.first[w.doc[p]])), pa.ListArray.from_arrays(pa.array(one), pa.array(x.view(np.int64)))]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "hash", "size", "at", "around"])

    return run


def _counts() -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column(1), letter_words())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.first))], ["row", "n_words"])

    return run


def _by_join(rows: DataFrame, index: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    """(row, n_words, n_hit, n_items, items_sha256) by shuffled joins; rows(row, text) has unique row numbers.

    Up to ``most`` windows of short items go to the tasks, which then send on only runs that are one of them.
    Passages that very many documents share are dealt in shares (``join_salted``).
    """
    brief = index.filter((F.col("kind") == 0) & (F.col("size") < window)).select("hash", "size").distinct()
    short = {r["size"]: None for r in brief.select("size").distinct().collect()}  # fewer than window
    if brief.count() <= most:
        few = brief.toArrow()
        sizes, hashes = few["size"].to_numpy(), few["hash"].to_numpy().view(np.uint64)
        short = {size: np.sort(hashes[sizes == size]) for size in short}
    prints = cut(map_batches(rows, _doc_prints(window, gram, short), "row long, hash long, size int, at array<long>, around array<long>"))
    known = index.filter("kind = 1").select("hash", F.lit(window).alias("size")).unionByName(brief).distinct()
    near = join_salted(prints, known, ["hash", "size"], ["row", "at"], "left_semi").select("row", "size", F.explode(F.arrays_zip("at", "around")).alias("x"))
    near = cut(near.select("row", "size", F.col("x.at").alias("at"), F.col("x.around").alias("hash")).distinct())
    found = join_salted(near, index.filter("kind = 0").select("item", "hash", "size"), ["hash", "size"], ["row", "at"])
    names = found.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    # Words covered: the runs of one document in order of place; each adds what reaches beyond those before.
    from pyspark.sql import Window as W

    runs = found.groupBy("row", "at").agg(F.max("size").alias("size")).withColumn("end", F.col("at") + F.col("size"))
    before = F.coalesce(F.max("end").over(W.partitionBy("row").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = runs.select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("at", before)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    counts = map_batches(rows, _counts(), "row long, n_words long")
    out = counts.join(spans, "row", "left").join(names, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs, repeats included.

    Null or empty texts have no words and hit nothing; items of null id or without words match nothing; rows of
    the same item id are one item. An empty benchmark leaves all documents clean, empty docs give no rows.
    Columns besides the named ones are never read.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    index = cut(item_windows(items, item_col, item_text, window, gram))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if index.count() <= broadcast_windows:
        out = map_batches(rows, _match(Index(index.toArrow()), window, gram), f"id {kind}, {RESULT}")
    else:
        numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        out = _by_join(numbered.select("row", "text"), index, window, gram, broadcast_windows).join(numbered.select("row", "id"), "row")
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
