"""Readers and writers of openings and people: JSON in several layouts, dumps, text files, camel-case JSON, logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing
from ..functions.skills import extract_skills, names_skill
from ..functions.text import blank_null, dedupe_ci, first_present, json_string_list, split_delims
from .json_arrays import read_elements

#: Fields of all layouts, read tolerantly: what isn't a string there is its JSON text.
RAW = "id string, job_id string, title string, company string, department string, location string, job_type string, summary string, description string, salary string, experience string, education string, posted_at string, url string, skills string, skill_requirements string, education_constraints string, tags string, job_name string, jd string, skill_tags string, work_address string, city string, company_industry string, job_keys string, company_name string, _detail_url string, basic_info struct<title: string, location: string, job_type: string, summary: string, salary_min: string, salary_max: string>"


def read_jobs_json(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Openings of JSON files whose root is a list or {"jobs": [...]}, a large file in several tasks; other roots raise.

    0 or None: no limit; else the first of the files in order of path and place.
    """
    elements = read_elements(spark, path)
    if limit and limit > 0:
        elements = elements.orderBy("path", "pos").limit(limit)
    return elements.select("pos", F.from_json("text", f"struct<{RAW}>").alias("raw")).select("pos", "raw.*")


def dialect(row: DataFrame) -> Column:
    """standard, board_a, board_b or other, by which fields are there."""
    has = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    board = has("job_name") & has("jd")
    return (
        F.when(has("title") | has("description") | has("summary") | has("skill_requirements") | has("education_constraints"), "standard")
        .when(board & (has("skill_tags") | has("education") | has("experience") | has("work_address")), "board_a")
        .when(board & has("job_keys"), "board_b")
        .otherwise("other")
    )


def map_boards(raw: DataFrame) -> DataFrame:
    """All layouts as one flat record in a single pass: id, title, company, location, summary, text, pay, years, degree, skills, industry."""
    c = F.col
    rows = raw.withColumn("dialect", dialect(raw))
    board = c("dialect").isin("board_a", "board_b")
    jd = parsing.description_text(c("jd"))
    text = F.when(board, jd).otherwise(F.coalesce(c("description"), c("summary"), c("basic_info.summary")))
    title = first_present(F.when(board, c("job_name")), c("title"), c("basic_info.title"))
    place = first_present(c("work_address"), c("location"), c("city"), c("basic_info.location"))
    tags = F.concat(json_string_list(c("skill_tags")), split_delims(F.coalesce("job_keys", F.lit(""))), json_string_list(c("skills")))
    skills = dedupe_ci(F.concat(extract_skills(F.concat_ws("\n", title, text)), F.filter(tags, names_skill)))
    pay = parsing.parse_salary(F.coalesce(c("salary"), text))
    years = parsing.parse_years(F.coalesce(c("experience"), text))
    return rows.select(
        parsing.job_id(c("id"), c("job_id"), F.coalesce(c("url"), c("_detail_url")), F.concat_ws("\n", title, text)).alias("id"), "dialect", title.alias("title"), first_present(c("company"), c("company_name")).alias("company"), place.alias("location"),
        parsing.compose_summary(c("summary"), text, title).alias("summary"), text.alias("text"), pay.alias("pay"), years.alias("years"), F.coalesce(parsing.norm_degree(c("education")), parsing.degree_in_text(text)).alias("min_degree"),
        skills.alias("skills"), F.filter(tags, lambda t: ~names_skill(t)).alias("general"), split_delims(F.coalesce("company_industry", F.lit(""))).alias("industry"), c("posted_at"),
    )


def scan_resume_files(spark: SparkSession, path: str, suffixes=("pdf", "docx", "doc", "txt", "md"), skip=("readme", "template", "sample")) -> DataFrame:
    """(path, name, size, content) of files with a known suffix and no skipped word in the name.

    The order of an import, small ones first, is that of size, lower-case name and path; nothing here is sorted, lest all files' bytes
    go through one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.col("length").alias("size"), "content")
    return rows.filter(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*suffixes) & ~F.lower("name").rlike("|".join(skip)))


def decode_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``text``, rejects with ``error``): UTF-8, with or without a mark, else GB18030, else Latin-1."""
    valid = F.col("content").isNotNull() & F.is_valid_utf8(F.col("content").cast("string"))
    plain = files.filter(valid).withColumn("text", blank_null(F.regexp_replace(F.col("content").cast("string"), "^﻿", "")))
    rows = plain.unionByName(files.filter(~valid).withColumn("text", blank_null(_other_charsets(F.col("content")))))
    return rows.filter("text is not null"), rows.filter("text is null").drop("text").withColumn("error", F.lit("empty"))


@F.pandas_udf(T.StringType())
def _other_charsets(content: pd.Series) -> pd.Series:
    """Bytes that aren't UTF-8, as GB18030 if they are that, else as Latin-1. Spark's decode knows few charsets."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            return data.decode("gb18030")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    return content.map(one)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def _renamed(c: Column, kind: T.DataType) -> Column:
    """The same value with field names in camel case, at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_renamed(c[f.name], f.dataType).alias(camel(f.name)) for f in kind.fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: _renamed(x, kind.elementType))
    return c


def to_json_camel(df: DataFrame) -> DataFrame:
    """df with ``json``: the record with camel-case names; nulls are left out."""
    fields = [_renamed(F.col(f"`{f.name}`"), f.dataType).alias(camel(f.name)) for f in df.schema.fields]
    return df.withColumn("json", F.to_json(F.struct(*fields)))


def from_payload(df: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    """The typed record of a JSON payload; missing fields and wrong types are null."""
    return df.select(*[c for c in df.columns if c != column], F.from_json(column, schema).alias("record")).select(*[c for c in df.columns if c != column], "record.*")


def match_audit(pairs: DataFrame, columns: list[str], by: str = "resume_id", order: str = "recall_rank") -> DataFrame:
    """(by, entry): one JSON object a person with all candidates in order, for a log of decisions."""
    item = F.struct(F.col(order).alias("__order"), *[F.col(c).alias(camel(c)) for c in columns])
    rows = pairs.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("c"))
    plain = F.transform("c", lambda x: F.struct(*[x[camel(c)].alias(camel(c)) for c in columns]))
    return rows.select(by, F.to_json(F.struct(F.col(by).alias(camel(by)), plain.alias("candidates"))).alias("entry"))

