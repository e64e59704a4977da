"""Facets of openings and people: roles, work modes, seniority, pay bands, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import (
    AI_KEYWORDS, CAMPUS_PATTERN, ENTRY_ROLE_KEYWORDS, INTERN_KEYWORDS, JOB_ENTRY_WORDS, JOB_SENIOR_WORDS, MAJOR_CITIES, MODE_KEYWORDS, RESUME_AI_KEYWORDS,
    RESUME_LEAD_KEYWORDS, RESUME_MODE_KEYWORDS, RESUME_ROLE_KEYWORDS, ROLE_KEYWORDS, SENIOR_ROLE_KEYWORDS,
)
from .text import city_tokens, contains_any, keyword_categories, none_of, strings


def joined(*columns: Column) -> Column:
    """Non-empty parts in lower case, one blank between."""
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns]))


def role_categories(title: Column, summary: Column, tags: Column | None = None) -> Column:
    parts = [title, summary] + ([F.array_join(tags, " ")] if tags is not None else [])
    return keyword_categories(joined(*parts), ROLE_KEYWORDS)


def facets_of(text: Column) -> Column:
    """struct(roles, modes, ai, internship) of a text already in lower case.

    For long texts: put the lowered text into a column first, as each of some hundred look-ups reads it.
    """
    return F.struct(
        keyword_categories(text, ROLE_KEYWORDS).alias("roles"), keyword_categories(text, MODE_KEYWORDS).alias("modes"), keyword_categories(text, AI_KEYWORDS).alias("ai"), F.when(contains_any(text, INTERN_KEYWORDS), True).when(text != "", False).alias("internship")
    )


def resume_roles(facet_roles: Column, *text: Column) -> Column:
    """Given roles, else those named in the texts; a full-stack engineer is a backend and a frontend one too."""
    given = F.transform(F.coalesce(facet_roles, strings()), F.lower)
    roles = F.when(F.size(given) > 0, given).otherwise(keyword_categories(joined(*text), RESUME_ROLE_KEYWORDS))
    both = F.array_union(roles, strings("backend_engineer", "frontend_engineer"))
    return F.when(F.array_contains(roles, "fullstack_engineer"), both).otherwise(roles)


def work_modes(title: Column, location: Column, summary: Column) -> Column:
    found = keyword_categories(joined(title, location, summary), MODE_KEYWORDS)
    return F.when((F.size(found) == 0) & (F.coalesce(location, F.lit("")) != ""), strings("onsite")).otherwise(found)


def resume_work_modes(text: Column) -> Column:
    return keyword_categories(F.lower(F.coalesce(text, F.lit(""))), RESUME_MODE_KEYWORDS)


def is_internship(title: Column, job_type: Column, summary: Column) -> Column:
    text = joined(title, job_type, summary)
    return F.when(contains_any(text, INTERN_KEYWORDS), True).when(text != "", False)


def job_seniority(title: Column, summary: Column, job_type: Column, min_years: Column, max_years: Column) -> Column:
    text = joined(title, summary, job_type)
    return (
        F.when(contains_any(text, JOB_ENTRY_WORDS), "entry").when(contains_any(text, JOB_SENIOR_WORDS), "senior").when(min_years >= 5, "senior").when(max_years <= 2, "entry").when(min_years >= 3, "mid")
    )


def salary_band(salary_min: Column, salary_max: Column, intern_amount: Column) -> Column:
    top = F.coalesce(F.nullif(salary_max, F.lit(0)), F.nullif(salary_min, F.lit(0)), intern_amount)
    return F.when(top <= 0, none_of("string")).when(top < 12000, "entry").when(top < 20000, "mid").when(top < 30000, "senior").when(top.isNotNull(), "lead")


def ai_capabilities(*text: Column) -> Column:
    return keyword_categories(joined(*text), AI_KEYWORDS)


def resume_seniority(title: Column, summary: Column, years: Column) -> Column:
    return F.when(contains_any(joined(title, summary), RESUME_LEAD_KEYWORDS) | (years >= 8), "lead").when(years >= 5, "senior").when(years >= 3, "mid").otherwise("junior")


def inferred_salary(years: Column, seniority: Column, roles: Column, city: Column, text: Column) -> Column:
    """struct(min, max) of the pay to expect, null without years; steps for rank, trade, AI and large cities."""
    pick = lambda *steps: F.when(years >= 9, steps[0]).when(years >= 7, steps[1]).when(years >= 5, steps[2]).when(years >= 3, steps[3]).otherwise(steps[4])
    trade = F.arrays_overlap(roles, strings("backend_engineer", "fullstack_engineer", "algorithm_engineer", "data_engineer"))
    ai = contains_any(F.lower(F.coalesce(text, F.lit(""))), RESUME_AI_KEYWORDS)
    large = contains_any(F.coalesce(city, F.lit("")), MAJOR_CITIES)
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    low = pick(30000, 26000, 22000, 16000, 10000) + F.when(seniority == "lead", 5000).when(seniority == "senior", 2000).otherwise(0) + add(trade, 2000) + add(ai, 3000) + add(large, 2000)
    high = pick(42000, 36000, 30000, 22000, 15000) + F.when(seniority == "lead", 8000).when(seniority == "senior", 4000).otherwise(0) + add(trade, 3000) + add(ai, 5000) + add(large, 3000)
    return F.when(years > 0, F.struct(low.cast("int").alias("min"), high.cast("int").alias("max")))


def target_cities(current_city: Column, text: Column) -> Column:
    """The current city and those of labelled lines in the text."""
    line = lambda p: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit(""))
    lines = F.concat_ws(",", F.nullif(current_city, F.lit("")), line(r"(?i)(?:期望城市|意向城市|target city|preferred city)[:：]\s*([^\n]+)"), line(r"(?:工作地点|意向地点)[:：]\s*([^\n]+)"))
    return city_tokens(lines)


def is_campus(text: Column) -> Column:
    return text.rlike(CAMPUS_PATTERN)


def experience_band(internship: Column, text: Column, min_years: Column, max_years: Column) -> Column:
    """struct(low, high, tag) of the years that an opening is meant for; ``text`` is its lower-case title, type, summary."""
    campus = is_campus(text)
    intern = F.coalesce(internship, F.lit(False))
    entry = intern | campus | contains_any(text, ENTRY_ROLE_KEYWORDS) | F.coalesce(max_years <= 2, F.lit(False)) | F.coalesce((min_years <= 1) & (max_years <= 3), F.lit(False))
    senior = contains_any(text, SENIOR_ROLE_KEYWORDS) | F.coalesce(min_years >= 5, F.lit(False))
    low = F.coalesce(min_years.cast("double"), F.greatest(F.lit(0.0), max_years - 2.0))
    high = F.coalesce(max_years.cast("double"), min_years + F.when(senior, 6.0).otherwise(4.0))
    neither = min_years.isNull() & max_years.isNull()
    band = lambda a, b, t: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high"), F.lit(t).alias("tag") if isinstance(t, str) else t.alias("tag"))
    return (
        F.when(intern, band(F.lit(0), F.lit(1), "internship"))
        .when(campus, band(F.lit(0), F.lit(2), "campus"))
        .when(neither & entry, band(F.lit(0), F.lit(3), "entry"))
        .when(neither & senior, band(F.lit(5), F.lit(12), "senior"))
        .when(neither, band(none_of("double"), none_of("double"), "unknown"))
        .otherwise(band(low, high, F.when(entry, "entry").when(senior, "senior").otherwise("standard")))
    )


def match_city_list(location: Column) -> Column:
    """City tokens of an opening's location; none without one."""
    return F.coalesce(city_tokens(location), strings())
