"""Language identification by Bayesian fusion of four kinds of evidence.

* text: a naive Bayes likelihood over byte trigrams of the lower-cased letters, trained on the corpus itself
  (texts grouped by the language that they declare, which is right for most);
* the declared markup language: P(declared | language), counted over the corpus;
* the address suffix (country domains, or a language in the path): P(suffix | language), counted likewise;
* the host: P(language | host), smoothed towards its domain, that towards its top level, that towards all.

All tables come from grouped aggregates that combine before the shuffle. The text's own first guess, not the
declaration, is what the other tables count, so that a wrong declaration is seen as one. Tables by host stay
in Spark and are joined; only the trigram table and those by language come to the driver: at most
``MAX_LANGUAGES`` languages, the most declared ones, have tables, and trigrams ``BUCKETS`` buckets, so their size is bounded.

The languages are those that some row declares. A text of another one, noise, or a text that mixes languages is
told by a rival that no row declares: the better of even trigrams and an even mixture of all languages' tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, join_hot, map_batches, text_slices
from .tokens import letter_words, text_bytes

BUCKETS = 1 << 14
#: Weight of a trigram's log-likelihood: neighbours overlap and repeat each other's evidence.
TEMPER = 0.3
UNKNOWN = "und"
#: Share of texts of none of the declared languages, as it is before any text is seen.
PRIOR_OTHER = 0.01
#: Languages that get a table, those declared most; it has BUCKETS cells each, 8 bytes a cell.
MAX_LANGUAGES = 128


def primary(code: Column) -> Column:
    """The primary subtag in lower case; null unless it has two or three letters."""
    tag = F.lower(F.regexp_extract(code.cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name, or three where the last is a country's and the one before a class such as co or ac."""
    return F.regexp_extract(host, r"([^.]+\.(?:co|com|net|org|ac|edu|gov|or|ne|go|gob|gouv)\.[a-z]{2}|[^.]+\.[^.]+)$|^([^.]+)$", 0)


def suffix_of(url: Column) -> Column:
    """The language-like part of an address: a path's first segment of two letters, else a two-letter top level."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    top = F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)
    return F.when(path != "", F.concat(F.lit("/"), path)).when(top != "", F.concat(F.lit("."), top))


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each trigram with a letter; other characters are one blank, runs of blanks are dropped."""
    data, bounds = text_bytes(texts)
    kind = letter_words()
    kind[0x30:0x3A] = 0  # digits say nothing
    m = kind[data].astype(np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keep = m > 0
    keep[1:] |= (m[:-1] > 0) & (doc[1:] == doc[:-1])  # the first blank after a word stays
    m, doc = m[keep], doc[keep]
    if len(m) < 2:
        return doc[:0], doc[:0]
    before = np.zeros(len(m), np.uint32)
    before[1:] = np.where(doc[1:] == doc[:-1], m[:-1], 0)
    after = np.zeros(len(m), np.uint32)
    after[:-1] = np.where(doc[1:] == doc[:-1], m[1:], 0)
    h = (before * np.uint32(0x9E3779B1)) ^ (m * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return doc[m > 0], (h >> np.uint32(32 - 14))[m > 0].astype(np.int64)


def trigram_table(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log-probabilities [language, bucket] over all texts of rows(declared, text)."""
    number = {c: i for i, c in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            code = np.array([number.get(c, -1) for c in batch.column(0).to_pylist()], np.int64)
            for a, z in text_slices(batch.column(1)):
                doc, bucket = trigrams(batch.column(1).slice(a, z - a))
                c = code[a:z][doc]
                total += np.bincount((c * BUCKETS + bucket)[c >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = map_batches(rows.filter("declared is not null"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts = counts.reshape(len(languages), BUCKETS) + 0.5
    return np.log(counts / counts.sum(1, keepdims=True)) if languages else counts


def text_evidence(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """rows with (n_trigrams, evidence, other): the tempered log-likelihood of each language and of none, the text left out.

    None is the better of even trigrams and, with two languages or more, their even mixture.
    """
    small = table.astype(np.float32)
    even = -np.log(BUCKETS)
    mixed = np.log(np.exp(table).mean(0)).astype(np.float32) if len(languages) > 1 else None
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, z in text_slices(texts):
                doc, bucket = trigrams(texts.slice(a, z - a))
                e = np.stack([np.bincount(doc, small[i][bucket], z - a) for i in range(len(languages))], 1) if languages else np.zeros((z - a, 0))
                flat = pa.array(TEMPER * e.ravel())
                n = np.bincount(doc, minlength=z - a)
                other = even * n if mixed is None else np.maximum(even * n, np.bincount(doc, mixed[bucket], z - a))
                ends = pa.array((np.arange(z - a + 1) * len(languages)).astype(np.int32))
                cols = [batch.column(i).slice(a, z - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.ListArray.from_arrays(ends, flat), pa.array(TEMPER * other)], [*(k for k, _ in kinds), "n_trigrams", "evidence", "other"])

    schema = ", ".join(f"`{k}` {t}" for k, t in kinds)
    return map_batches(rows.select(*(k for k, _ in kinds), "text"), run, f"{schema}, n_trigrams long, evidence array<double>, other double")


def _argmax(scores: Column, languages: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(scores, F.array_max(scores)).cast("int"))


def _shares(guessed: DataFrame, seen: str, languages: list[str], strength: float = 1.0) -> DataFrame:
    """(seen, array of log P(seen | language)): counts with ``strength`` spread over all values seen."""
    n = guessed.filter(F.col(seen).isNotNull()).groupBy(seen).pivot("guess", languages).count().fillna(0, languages)
    totals = n.agg(F.count(F.lit(1)).alias("values"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in languages]).first()
    spread = strength / max(1, totals["values"])
    one = [F.log((F.col(c) + F.lit(spread)) / F.lit(totals[c] + strength)) for c in languages]
    return n.select(F.col(seen).alias(f"{seen}_key"), F.array(*one).alias(f"{seen}_evidence"))


def host_priors(guessed: DataFrame, languages: list[str], strength: float = 10.0) -> DataFrame:
    """(host, texts, array of log P(language | host)), each level smoothed by ``strength`` counts of the one above."""
    by_host = guessed.groupBy("host", "domain", "top").pivot("guess", languages).count().fillna(0, languages).withColumn("texts", sum((F.col(c) for c in languages), F.lit(0)))
    sums = [F.sum(c).alias(c) for c in languages]

    def smooth(level: DataFrame, above: list[Column], keys: list[str]) -> DataFrame:
        n = sum((F.col(c) for c in languages), F.lit(0))
        return level.select(*keys, *[((F.col(c) + strength * a) / (n + strength)).alias(f"p_{c}") for c, a in zip(languages, above)])

    names = [f"p_{c}" for c in languages]
    totals = by_host.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in languages]).first()
    n_all = sum(totals)
    overall = [(totals[c] + strength / len(languages)) / (n_all + strength) for c in languages]
    tops = smooth(by_host.groupBy("top").agg(*sums), [F.lit(p) for p in overall], ["top"])
    domains = smooth(by_host.groupBy("domain", "top").agg(*sums).join(tops, "top"), [F.col(c) for c in names], ["domain"])
    hosts = smooth(by_host.join(domains, "domain"), [F.col(c) for c in names], ["host", "texts"])
    return hosts.select("host", "texts", F.array(*[F.log(c) for c in names]).alias("host_evidence"))


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str | Column | None = "lang", host: str | Column | None = "source", suffix: Column | None = None, min_confidence: float = 0.5, keep: tuple[str, ...] | None = None, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """id, declared, language, confidence (6 digits), n_trigrams, kept: one row for each row of docs.

    ``declared``, ``host`` and ``suffix`` are columns or expressions; None leaves that evidence out. kept is
    false for a text without a letter (language 'und', confidence 0), for a confidence below
    ``min_confidence``, for a text that is rather of no declared language, noise or a mixture (the confidence is among
    the declared ones and doesn't tell), and, with ``keep``, for other languages. Null evidence says nothing. At most ``max_languages`` languages, those
    that most rows declare, are told apart; the rarer ones are no declared language. Corpora without
    any declared language give 'und' for all. Ties go to the language first in the alphabet. Repeated rows count as
    often as they stand; other columns are never read.
    """
    none = F.lit(None).cast("string")
    col = lambda c: none if c is None else F.col(c) if isinstance(c, str) else c
    rows = docs.select(
        F.col(id_col).alias("id"), primary(col(declared)).alias("declared"), F.coalesce(F.lower(col(host).cast("string")), F.lit("")).alias("host"), col(suffix).alias("suffix"), F.col(text_col).cast("string").alias("text")
    )
    most = rows.filter("declared is not null").groupBy("declared").count().orderBy(F.desc("count"), "declared").limit(max_languages)
    languages = sorted(r["declared"] for r in most.collect())
    if not languages:
        return rows.select(F.col("id").alias(id_col), "declared", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept"))
    table = trigram_table(rows.select("declared", "text"), languages)
    seen = cut(text_evidence(rows, languages, table))
    guessed = seen.filter("n_trigrams > 0").select(
        "host", domain_of(F.col("host")).alias("domain"), F.regexp_extract("host", r"([^.]+)$", 1).alias("top"), "declared", "suffix", _argmax(F.col("evidence"), languages).alias("guess")
    )
    priors = cut(host_priors(guessed, languages))
    texts = priors.agg(F.sum("texts")).first()[0] or 0
    no_text = seen.filter("n_trigrams = 0").withColumn("host_evidence", F.lit(None).cast("array<double>"))  # nothing is concluded from their host
    out = join_hot(seen.filter("n_trigrams > 0"), priors, "host", "texts", texts).unionByName(no_text)
    for name in ("declared", "suffix"):
        out = out.join(_shares(guessed, name, languages), F.col(name) == F.col(f"{name}_key"), "left")
    zero = F.array_repeat(F.lit(0.0), len(languages))
    total = F.col("evidence")
    for name in ("host", "declared", "suffix"):
        total = F.zip_with(total, F.coalesce(f"{name}_evidence", zero), lambda a, b: a + b)
    out = out.withColumn("total", total).withColumn("top_score", F.array_max("total"))
    share = 1 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top_score")))
    letters = F.col("n_trigrams") > 0
    language = F.when(letters, _argmax(F.col("total"), languages)).otherwise(UNKNOWN)
    out = out.select("id", "declared", language.alias("language"), F.when(letters, F.round(share, 6)).otherwise(0.0).alias("confidence"), "n_trigrams", (F.col("other") + math.log(PRIOR_OTHER) > F.array_max("evidence")).alias("none_fits"))
    kept = letters & (F.col("confidence") >= min_confidence) & ~F.col("none_fits")
    if keep is not None:
        kept &= F.col("language").isin(*keep)
    return out.select(F.col("id").alias(id_col), "declared", "language", "confidence", "n_trigrams", kept.alias("kept"))


def identify_pages(pages: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """The same for pages(page_id, url, html): markup language, address suffix and host are all there."""
    stripped = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    rows = pages.select("page_id", stripped.alias("text"), markup_language(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"), suffix_of(F.col("url")).alias("suffix"))
    return identify_language(rows, "page_id", "text", "declared", "host", F.col("suffix"))
