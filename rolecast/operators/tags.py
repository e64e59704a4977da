"""Tags of openings and people: built from fields, merged, read back as facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dictionaries import TAG_BLOCKLIST, TAG_CATEGORIES, TAG_LIMITS
from ..functions.text import clean_text, none_of, slug, strings

TAG = "struct<name: string, category: string, weight: int, slug: string, filterable: boolean, facet_key: string, facet_value: string>"


def facet_tags(values: Column, category: str, key: str) -> Column:
    """One tag for each value of a facet."""
    return F.transform(
        F.coalesce(values, strings()),
        lambda v: F.struct(v.alias("name"), F.lit(category).alias("category"), none_of("int").alias("weight"), F.coalesce(slug(v), v).alias("slug"), F.lit(True).alias("filterable"), F.lit(key).alias("facet_key"), v.alias("facet_value")),
    )


def one(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c)).otherwise(strings())


def resume_tags(roles: Column, cities: Column, modes: Column, ai: Column, seniority: Column, salary: Column) -> Column:
    """The standard tags of a person; ``salary`` is a struct(min, max)."""
    pay = F.when(salary.isNotNull(), F.concat_ws(":", salary["min"].cast("string"), salary["max"].cast("string")))
    band = F.transform(
        one(pay), lambda v: F.struct(F.concat(F.lit("salary:"), F.replace(v, F.lit(":"), F.lit("-"))).alias("name"), F.lit("salary_band").alias("category"), none_of("int").alias("weight"), F.replace(v, F.lit(":"), F.lit("_")).alias("slug"), F.lit(True).alias("filterable"), F.lit("inferred_salary_range").alias("facet_key"), v.alias("facet_value"))
    )
    return F.concat(facet_tags(roles, "role", "role_categories"), facet_tags(cities, "city", "target_cities"), facet_tags(modes, "work_mode", "preferred_work_modes"), facet_tags(ai, "ai_capability", "ai_capabilities"), facet_tags(one(seniority), "seniority", "seniority_level"), band)


def job_tags(roles: Column, modes: Column, cities: Column, ai: Column, internship: Column, seniority: Column, band: Column) -> Column:
    """The standard tags of an opening."""
    kind = F.when(internship, "intern").when(~internship, "fulltime")
    return F.concat(
        facet_tags(roles, "role", "role_categories"), facet_tags(modes, "work_mode", "work_modes"), facet_tags(cities, "city", "city_tokens"), facet_tags(ai, "ai_capability", "ai_capabilities"),
        facet_tags(one(kind), "job_type", "is_internship"), facet_tags(one(seniority), "seniority", "seniority_level"), facet_tags(one(band), "salary_band", "salary_band"),
    )


def facet_values(tags: Column, key: str, fallback: Column | None = None) -> Column:
    """Values of a facet among filterable tags, else the fallback."""
    found = F.transform(F.filter(F.coalesce(tags, F.array().cast(f"array<{TAG}>")), lambda t: F.coalesce(t["filterable"], F.lit(False)) & (t["facet_key"] == key)), lambda t: t["facet_value"])
    return F.when(F.size(found) > 0, found).otherwise(fallback if fallback is not None else strings())


def merge_tags(base: DataFrame, derived: DataFrame, key: str = "job_id") -> DataFrame:
    """Both long tables, each (category, facet, slug or name) of a record once; base goes first."""
    rows = base.withColumn("source", F.lit(0)).unionByName(derived.withColumn("source", F.lit(1)), allowMissingColumns=True)
    names = ["facet_key", "facet_value", "slug"]
    rows = rows.withColumns({n: none_of("string") for n in names if n not in rows.columns})
    same = [key, "category", F.coalesce("facet_key", F.lit("")), F.coalesce("facet_value", F.lit("")), F.lower(F.coalesce("slug", "name"))]
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*same).orderBy("source", "name"))).filter("rn = 1").drop("rn", "source")


def build_tags(candidates: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, name, category, weight, position) from (key, name, category, weight, pos).

    Of one name the first category in priority stays (a skill is its own name space), then the heavier, then the
    earlier; each category has a limit; order is by priority, weight, name.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in TAG_CATEGORIES]), F.col("category"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in TAG_LIMITS.items() for x in kv]), F.col("category"))
    rows = candidates.filter(F.col("category").isin(*TAG_CATEGORIES)).withColumn("name", clean_text(F.col("name"))).filter(F.col("name").isNotNull() & ~F.lower("name").isin(*TAG_BLOCKLIST) & (F.length("name") >= 2))
    low = F.lower("name")
    rows = rows.withColumns({"priority": order, "k": F.when(F.col("category") == "tech", F.concat(F.lit("tech:"), low)).otherwise(low)})
    best = rows.withColumn("rn", F.row_number().over(W.partitionBy(key, "k").orderBy("priority", F.desc("weight"), "pos"))).filter("rn = 1")
    some = best.withColumn("rc", F.row_number().over(W.partitionBy(key, "category").orderBy(F.desc("weight"), low))).filter(F.col("rc") <= limit)
    return some.select(key, "name", "category", "weight", F.row_number().over(W.partitionBy(key).orderBy("priority", F.desc("weight"), low)).alias("position"))
