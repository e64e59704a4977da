"""The corpus pipeline: toxicity, language, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again as the next one's
docs. All but the last return the columns of docs. A row is known by the hash of all its columns, so null and
repeated ids are decided row by row; rows equal in every column share their decision, and the near-duplicate
stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.llm.frames import cut, fresh, table
from rolecast.llm.language import identify_language
from rolecast.llm.sentencepiece_codec import encode
from rolecast.llm.simhash import simhash_components
from rolecast.llm.toxicity import reject_toxic
from rolecast.llm.winnow import contamination

BROADCAST_KEYS = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the hash of each row's columns, and that column's name, which no column of docs has."""
    key = fresh("__row_key", docs.columns)
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return docs.withColumn(key, F.xxhash64(*plain, F.lit(0))), key


def _without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """docs without the rejected keys; up to ``BROADCAST_KEYS`` of them (8 bytes each) spare the texts a shuffle."""
    keys = cut(rejected.select(key).distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, of none that the corpus declares, of several, or of one more likely wrong than right, go."""
    keyed, key = _keyed(docs)
    return _without(keyed, identify_language(keyed, key).filter("not kept"), key).drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the least id stays (of equal ids or none, the one of the least key)."""
    keyed, key = _keyed(docs)
    named = keyed.select(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col(key).alias("key")).alias("row"), "text")
    found = cut(simhash_components(named, "row"))
    out = _without(keyed, found.filter("row <> component_id").select(F.col("row.key").alias(key)), key)
    if not found.groupBy("row").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([key]).select(*[F.col(f"`{c}`").alias(c) for c in out.columns])  # columns of their own, not those of docs
    return out.drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    keyed, key = _keyed(docs)
    return _without(keyed, contamination(keyed, table(spark, sf_dir, "benchmark"), key).filter("contaminated"), key).drop(key)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding gives the text back."""
    back = encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    return back.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the search for the best tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each cut into the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
