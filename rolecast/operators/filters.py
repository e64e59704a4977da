"""Eligibility of pairs: requested filters, then built-in ones; the first that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig
from ..functions.text import dedupe_ci, positive, strings, strip


def overlaps(wanted: Column, offered: Column) -> Column:
    """No wish, or a shared value; case doesn't count."""
    low = lambda a: F.transform(F.coalesce(a, strings()), F.lower)
    return (F.coalesce(F.size(wanted), F.lit(0)) <= 0) | F.arrays_overlap(low(wanted), low(offered))


def range_passes(want_min: Column, want_max: Column, job_min: Column, job_max: Column) -> Column:
    """The years asked for and those wished for meet; a missing end takes the other one, none at all passes."""
    low, high = F.coalesce(job_min, job_max), F.coalesce(job_max, job_min)
    return ~F.coalesce(high < want_min, F.lit(False)) & ~F.coalesce(low > want_max, F.lit(False))


def internship_reason(preference: Column, internship: Column) -> Column:
    flag = F.coalesce(internship, F.lit(False))
    return F.when((preference == "intern") & ~flag, "user_internship_filtered").when((preference == "fulltime") & flag, "user_fulltime_filtered")


def freshness_passes(within: Column, days_ago: Column) -> Column:
    return within.isNull() | F.coalesce(days_ago <= within, F.lit(False))


def far_above_budget(has_reference: Column, want_min: Column, job_max: Column, cfg: MatchConfig = DEFAULT) -> Column:
    return has_reference & (want_min > 0) & (want_min > job_max * cfg.salary_ratio)


def direction_mismatch(resume_tags: Column, job_tags: Column, aligned: Column, cfg: MatchConfig = DEFAULT) -> Column:
    """Both sides have enough tags of their direction, share none, and nothing else brings them together."""
    n = cfg.direction_tags
    return (F.size(F.array_distinct(resume_tags)) >= n) & (F.size(F.array_distinct(job_tags)) >= n) & ~F.arrays_overlap(resume_tags, job_tags) & ~aligned


def directional_alignment(resume_roles: Column, job_roles: Column, resume_signals: Column, job_signals: Column) -> Column:
    ends = strings("frontend_engineer", "backend_engineer")
    full = lambda a, b: F.array_contains(a, "fullstack_engineer") & F.arrays_overlap(b, ends)
    return F.arrays_overlap(resume_roles, job_roles) | full(resume_roles, job_roles) | full(job_roles, resume_roles) | F.arrays_overlap(resume_signals, job_signals)


def entry_mismatch(years: Column, internship: Column, campus: Column) -> Column:
    return (years >= 3) & (F.coalesce(internship, F.lit(False)) | campus)


def role_mismatch(resume_roles: Column, job_roles: Column) -> Column:
    has = F.array_contains
    back = lambda r: has(r, "backend_engineer") | has(r, "fullstack_engineer")
    front_only = has(resume_roles, "frontend_engineer") & ~back(resume_roles) & back(job_roles) & ~has(job_roles, "frontend_engineer")
    algorithm = has(job_roles, "algorithm_engineer") & ~has(resume_roles, "algorithm_engineer")
    data = has(job_roles, "data_engineer") & ~(has(resume_roles, "data_engineer") | back(resume_roles))
    return front_only | algorithm | data


def reason(steps: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds, else 'passed'. A null condition doesn't hold."""
    out = F.when(F.lit(False), F.lit(""))
    for condition, name in steps:
        out = out.when(condition, name)
    return out.otherwise("passed")


def with_filter_reason(pairs: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """pairs with ``filter_reason``. Columns: the wishes (want_roles, want_modes, want_internship, want_days, want_min_years,
    want_max_years), the opening's facets (roles, modes, is_internship, posted_days_ago, min_years, max_years, campus,
    has_salary, salary_max), and gate, want_min, years, resume_roles, resume_tags, job_tags, aligned."""
    c = F.col
    steps = [
        (~overlaps(c("want_roles"), c("roles")), "user_role_category_filtered"),
        (~overlaps(c("want_modes"), c("modes")), "user_work_mode_filtered"),
        (internship_reason(c("want_internship"), c("is_internship")) == "user_internship_filtered", "user_internship_filtered"),
        (internship_reason(c("want_internship"), c("is_internship")) == "user_fulltime_filtered", "user_fulltime_filtered"),
        (~freshness_passes(c("want_days"), c("posted_days_ago")), "user_post_time_filtered"),
        (~range_passes(c("want_min_years"), c("want_max_years"), c("min_years"), c("max_years")), "user_experience_filtered"),
        (c("gate") < cfg.degree_gate, "education_below_threshold"),
        (far_above_budget(c("has_salary"), c("want_min"), c("salary_max"), cfg), "salary_far_above_budget"),
        (direction_mismatch(c("resume_tags"), c("job_tags"), c("aligned"), cfg), "direction_mismatch"),
        (entry_mismatch(c("years"), c("is_internship"), c("campus")), "overqualified_entry_level"),
        (role_mismatch(c("resume_roles"), c("roles")), "role_mismatch"),
    ]
    return pairs.withColumn("filter_reason", reason(steps))


def normalize_filters(df: DataFrame) -> DataFrame:
    """Wishes brought into form: lower-case lists without repeats, a known internship word or 'all', numbers above 0;
    ``is_active`` tells whether anything is left."""
    lists = lambda n: F.transform(dedupe_ci(F.coalesce(F.col(n), strings())), F.lower)
    word = F.lower(strip(F.col("internship_preference")))
    out = df.select(
        "resume_id", lists("role_categories").alias("role_categories"), lists("work_modes").alias("work_modes"), F.when(word.isin("intern", "fulltime"), word).otherwise("all").alias("internship_preference"),
        positive(F.col("posted_within_days")).cast("int").alias("posted_within_days"), positive(F.col("min_experience_years")).alias("min_experience_years"), positive(F.col("max_experience_years")).alias("max_experience_years"),
    )
    active = (
        (F.size("role_categories") > 0) | (F.size("work_modes") > 0) | (F.col("internship_preference") != "all") | F.col("posted_within_days").isNotNull()
        | F.col("min_experience_years").isNotNull() | F.col("max_experience_years").isNotNull()
    )
    return out.withColumn("is_active", active)
