"""Quality rules with thresholds taken from the data: quantile sketches per language and source.

Measures of every whole text are counted in one pass. A sketch of a measure is a histogram over buckets
whose bounds grow by ``GAMMA``: any quantile is known within about one per cent, and two sketches merge by
adding counts. So a grouped count, combined before the shuffle, makes the sketches of all (language, source)
groups, of the languages, and of everything, without a group ever being in one place. A group's quartiles are
drawn towards its language's, and those towards the overall ones, as if ``strength`` texts of the wider group were in it: so
a small group borrows its thresholds and a large one has its own, without a step between.

A text is kept if its base checks hold and each rate lies within the fences of its group: from
q25 - 3 (q75 - q25) - slack to q75 + 3 (q75 - q25) + slack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import line_counts
from .frames import cut, join_hot, map_batches, text_slices
from .tokens import grams, mix, space_words, whole, words

GAMMA = 1.02
#: Texts of the wider group that count into a narrower one.
STRENGTH = 200.0
REPEAT_WINDOW = 8
#: Rates that get fences, and the slack that a rate may have beyond them.
RATES = {"mean_word": 1.0, "symbols": 0.1, "dup_lines": 0.05, "repeats": 0.1}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(first: np.ndarray, h: np.ndarray, doc: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of each of n texts: the words inside runs of ``size`` words that it has twice or more."""
    g = grams(h, size)
    at = np.flatnonzero(whole(first, len(g), size))
    key = g[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    delta = np.bincount(at[again], minlength=len(h) + 1) - np.bincount(at[again] + size, minlength=len(h) + 1)
    return np.bincount(doc[np.cumsum(delta)[: len(h)] > 0], minlength=n)


def _measure_rows(texts: pa.Array) -> list[np.ndarray]:
    w, n = words(texts, space_words()), len(texts)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[w.bounds[1:]] - sums[w.bounds[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    chars = total((w.mapped > 0) & ((w.data & 0xC0) != 0x80))
    return [np.diff(w.first), chars, total(symbol[w.data]), line_counts(texts, w)[1], repeated_words(w.first, w.hashes(), w.doc, REPEAT_WINDOW, n)]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the five counts of every whole text; null has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(3)):
                kept = [batch.column(i).slice(a, z - a) for i in range(3)]
                counts = [pa.array(c, pa.int64()) for c in _measure_rows(batch.column(3).slice(a, z - a))]
                yield pa.RecordBatch.from_arrays(kept + counts, ["id", "lang", "source", *_COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def with_rates(counts: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumns(
        {"mean_word": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines") / n, "repeats": F.col("n_repeat_words") / n}
    )


def sketches(rates: DataFrame) -> DataFrame:
    """(level, lang, source, rate, bucket, n): level 0 a language and source, 1 a language, 2 everything."""
    long = rates.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, RATES)), F.array(*RATES))).alias("rate", "x"))
    bucket = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.lit(float(np.log(GAMMA))))).otherwise(F.lit(-1_000_000)).cast("int")
    base = long.groupBy("lang", "source", "rate", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    by_lang = base.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("rate", "bucket").agg(F.sum("n").alias("n"))
    return (
        base.withColumn("level", F.lit(0))
        .unionByName(by_lang.withColumns({"level": F.lit(1), "source": none}))
        .unionByName(overall.withColumns({"level": F.lit(2), "lang": none, "source": none}))
    )


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, rate, n, q1, q3) from the merged sketches."""
    group = W.partitionBy("level", "lang", "source", "rate")
    upto = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    value = F.when(F.col("bucket") == -1_000_000, F.lit(0.0)).otherwise(F.lit(2.0) * F.pow(F.lit(GAMMA), F.col("bucket")) / F.lit(GAMMA + 1))
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group), "value": value})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("value")))
    return ranked.groupBy("level", "lang", "source", "rate").agg(F.first("total").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(box: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """(lang, source, texts, and low_ and high_ of each rate) of each language and source."""
    level = lambda i, *keys: box.filter(F.col("level") == i).select(*keys, "rate", *[F.col(c).alias(f"{c}_{i}") for c in ("n", "q1", "q3")])
    drawn = lambda q, i, above: (F.col(f"n_{i}") * F.col(f"{q}_{i}") + F.lit(strength) * above) / (F.col(f"n_{i}") + F.lit(strength))
    langs = level(1, F.col("lang").alias("l")).join(F.broadcast(level(2)), "rate")  # one row a rate
    langs = langs.select("l", "rate", *[drawn(q, 1, F.col(f"{q}_2")).alias(f"{q}_lang") for q in ("q1", "q3")])
    groups = level(0, "lang", "source").join(langs.withColumnRenamed("rate", "r"), F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("r")))
    groups = groups.select("lang", "source", "rate", F.col("n_0").alias("n"), *[drawn(q, 0, F.col(f"{q}_lang")).alias(q) for q in ("q1", "q3")])
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv]), F.col("rate"))
    reach = 3 * (F.col("q3") - F.col("q1")) + slack
    groups = groups.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    return groups.groupBy("lang", "source").agg(F.max("n").alias("texts"), *[F.max(F.when(F.col("rate") == r, F.col(side))).alias(f"{side}_{r}") for r in RATES for side in ("low", "high")])


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", strength: float = STRENGTH) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row for each of docs.

    Null or empty texts have no words and fail. Null languages and sources are groups of their own. Repeated
    rows count as often as they stand; other columns are never read. An empty table gives no rows.
    """
    rates = cut(with_rates(measures(docs, id_col, text_col, lang_col, source_col)))
    # A group's name as one string, so that null and any text are told apart and a hot group can be joined by broadcast.
    name = F.to_json(F.struct("lang", "source"))
    box = cut(fences(quartiles(sketches(rates)), strength).withColumn("name", name))
    fine = F.lit(True)
    for r in RATES:
        fine &= F.coalesce(F.col(r).between(F.col(f"low_{r}"), F.col(f"high_{r}")), F.lit(True))
    passed = join_hot(rates.filter(~F.col("base_failed")).withColumn("name", name), box.drop("lang", "source"), "name", "texts", box.agg(F.sum("texts")).first()[0] or 0)
    verdicts = passed.select("id", *_COUNTS, "base_failed", fine.alias("kept")).unionByName(rates.filter("base_failed").select("id", *_COUNTS, "base_failed", F.lit(False).alias("kept")))
    return verdicts.withColumnRenamed("id", id_col)
