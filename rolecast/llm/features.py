"""Sparse features of whole texts: hashes of words and of their beginnings, and binned measures of form.

A feature is a 64-bit hash, the same in every task. Training picks a bounded number of them by a grouped
count in Spark; scoring looks only those up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, text_slices
from .tokens import _POWERS, Words, letter_words, mix, space_words, text_bytes, words

#: Bytes of a word's beginning that are features of their own, besides the word.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
_FILTER_BITS = 24


def word_features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, feature hash) arrays: all words, then all beginnings of each length."""
    n = len(w.data)
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.mapped.astype(np.uint64) * up[:n], out=total[1:])
    base, scale, size = total[w.start], down[w.start], w.end - w.start
    yield np.arange(len(w.start)), mix((total[w.end] - base) * scale)
    for k in BEGINNINGS:
        at = np.flatnonzero(size > k)
        yield at, mix((total[w.start[at] + k] - base[at]) * scale[at] + np.uint64(k))


#: Names of the measures of form and the upper ends of their bins; a last bin is open.
FORM = {
    "n_words": (0, 2, 5, 10, 20, 50, 200, 1000),
    "symbols_per_word": (0.0, 0.02, 0.1, 0.3, 1.0),
    "upper_share": (0.02, 0.05, 0.1, 0.3, 0.6),
    "exclaim_per_word": (0.0, 0.02, 0.1, 0.5),
    "digit_share": (0.0, 0.02, 0.1, 0.3),
    "other_share": (0.02, 0.05, 0.1, 0.2),
    "same_as_before": (0.0, 0.05, 0.1, 0.2, 0.4),
    "same_as_two_before": (0.05, 0.1, 0.2, 0.4),
    "repeated_lines": (0.0, 0.1, 0.2, 0.3, 0.5),
    "mean_word": (2.0, 3.0, 4.0, 5.0, 7.0, 9.0, 12.0),
}


def form_measures(texts: pa.Array) -> np.ndarray:
    """One row a text, one column a name of FORM; a text without words has zeros."""
    data, bounds = text_bytes(texts)
    w = words(texts, space_words())
    n = np.maximum(np.diff(w.first), 1)
    size = np.maximum(np.diff(bounds), 1)
    kind = np.zeros(256, np.uint8)
    for code, chars in enumerate((b"#*$%&|<>", bytes(range(65, 91)), b"!", b"0123456789", bytes(x for x in range(33, 127) if not chr(x).isalnum())), 1):
        kind[list(chars)] |= 1 << code
    flags = kind[data]

    def share(code: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags >> code & 1, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    h = w.hashes()
    same = [np.bincount(w.doc[k:][(h[k:] == h[:-k]) & (w.doc[k:] == w.doc[:-k])], minlength=len(n)) if len(h) > k else np.zeros(len(n)) for k in (1, 2)]
    lines, repeated = line_counts(texts, w)
    return np.stack(
        [np.diff(w.first), share(1) / n, share(2) / size, share(3) / n, share(4) / size, share(5) / size, same[0] / n, same[1] / n, repeated / np.maximum(lines, 1), np.bincount(w.doc, w.end - w.start, len(n)) / n], 1
    )


def line_counts(texts: pa.Array, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its \\n-split lines with a word, and those of them equal to an earlier line."""
    n = len(texts)
    whole = np.ones(256, np.uint16) + np.arange(256, dtype=np.uint16)
    whole[10] = 0
    lines = words(texts, whole)  # runs without \n, so a line with white space around is itself
    if not len(lines.start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    doc, h = lines.doc[full], lines.hashes()[full]
    order = np.lexsort((h, doc))
    again = np.zeros(len(order), bool)
    again[1:] = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return np.bincount(doc, minlength=n), np.bincount(doc[order][again], minlength=n)


def form_features(measures: np.ndarray) -> np.ndarray:
    """The hash of the bin of each measure."""
    out = [mix(np.searchsorted(ends, measures[:, i], "left").astype(np.uint64) + np.uint64(1 + 64 * (i + 1))) for i, ends in enumerate(FORM.values())]
    return np.stack(out, 1)


def form_names() -> np.ndarray:
    """The hashes of all bins of all measures."""
    bins = [np.arange(len(ends) + 1, dtype=np.uint64) + np.uint64(1 + 64 * (i + 1)) for i, ends in enumerate(FORM.values())]
    return mix(np.concatenate(bins))


def all_features(texts: pa.Array, form: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature hash), repeats included."""
    w = words(texts, letter_words())
    for at, h in word_features(w):
        yield w.doc[at], h
    if form:
        f = form_features(form_measures(texts))
        yield np.repeat(np.arange(len(texts)), f.shape[1]), f.ravel()


def counted(docs: DataFrame, form: bool) -> DataFrame:
    """(label, feature, n): in how many texts of docs(label, text) a feature is, combined in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            for a, z in text_slices(texts):
                pairs = list(all_features(texts.slice(a, z - a), form))
                doc, h = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = labels[a:z][doc[once]], h[once]
                for label in np.unique(doc):
                    names, n = np.unique(h[doc == label], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), label, np.int32)), pa.array(names.view(np.int64)), pa.array(n)], ["label", "feature", "n"])

    rows = docs.select(F.col("label").cast("int").alias("label"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "label int, feature long, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))


class Lookup:
    """Finds the chosen features among many hashes: a bit filter first, then a search."""

    def __init__(self, chosen: np.ndarray) -> None:
        self.chosen = np.sort(chosen.astype(np.uint64))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._low(self.chosen)] = True

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, number of the feature) of those found."""
        at = np.flatnonzero(self.filter[self._low(h)])
        if not len(self.chosen) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.chosen, h[at]), len(self.chosen) - 1)
        hit = self.chosen[k] == h[at]
        return at[hit], k[hit]

    def rows(self, texts: pa.Array, form: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature number, count) of the chosen features in each text."""
        doc, num = [], []
        for d, h in all_features(texts, form):
            at, k = self.find(h)
            doc.append(d[at])
            num.append(k)
        pair, n = np.unique(np.concatenate(doc) * max(1, len(self.chosen)) + np.concatenate(num), return_counts=True)
        return pair // max(1, len(self.chosen)), pair % max(1, len(self.chosen)), n


def vectors(docs: DataFrame, chosen: np.ndarray, form: bool) -> DataFrame:
    """(label, at, n): of each text of docs(label, text) the numbers of its chosen features and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(chosen)
        for batch in batches:
            texts = batch.column(1)
            for a, z in text_slices(texts):
                doc, num, n = look.rows(texts.slice(a, z - a), form)
                ends = np.searchsorted(doc, np.arange(z - a + 1)).astype(np.int32)
                at = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (num, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *at], ["label", "at", "n"])

    rows = docs.select(F.col("label").cast("int").alias("label"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "label int, at array<int>, n array<int>")


def scored(docs: DataFrame, text_col: str, chosen: np.ndarray, weights: np.ndarray, bias: float, form: bool, score_col: str = "score") -> DataFrame:
    """docs with ``score_col``, which no column of docs may be called: logistic of the bias and the weights times log(1 + count), over every whole text."""
    order = np.argsort(chosen)
    chosen, weights = chosen[order], weights[order]
    kept = docs.schema.fields
    text_at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(chosen)
        for batch in batches:
            texts = batch.column(text_at)
            for a, z in text_slices(texts):
                doc, num, n = look.rows(texts.slice(a, z - a), form)
                s = bias + (np.bincount(doc, weights[num] * np.log1p(n), z - a) if len(doc) else np.zeros(z - a))
                p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, z - a).columns, pa.array(p)], [*(f.name for f in kept), score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_batches(docs.select(*[F.col(f"`{f.name}`") for f in kept]), run, f"{schema}, `{score_col}` double")
