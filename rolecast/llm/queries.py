"""The numbered operators on the given tables, with the columns that their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import source_divergence
from .exact_dedup import exact_groups
from .frames import table
from .hard_negatives import hard_negatives, quantised, usable
from .html import main_text
from .language import identify_language, identify_pages
from .licenses import scan_licenses
from .oracles import ORACLES
from .quality_model import quality_scores
from .quality_rules import quality_verdicts
from .sentencepiece_codec import token_counts
from .simhash import simhash_components
from .toxicity import toxicity_scores
from .warc import audit, damaged_copy, manifest
from .winnow import contamination


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where address and markup are known too."""
    return identify_pages(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(manifest(pages), manifest(damaged_copy(pages)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is an anchor; labels of every seventh are wrong, as labels are."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    items = rows.select(F.col("vec_id").alias("id"), label.alias("label"), quantised(F.col("embedding")).alias("v"))
    return hard_negatives(items, items.filter("id % 100 = 0"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "language_id_pages": language_id_pages,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_winnowing": op4_winnowing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_license_scan": op6_license_scan,
    "op7_quality_model": op7_quality_model,
    "op8_html_text": op8_html_text,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_simhash": op10_simhash,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLES", "QUERIES"]
