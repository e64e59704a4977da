"""What stands between people and the openings that fit them best, and where candidates are lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_skills(lists: Column) -> Column:
    """The skills of lists of lacking skills, each once whatever its case, in order of first appearance; nulls are none."""
    every = F.array_compact(F.flatten(F.transform(lists, lambda x: F.coalesce(x, F.array().cast("array<string>")))))
    lower = F.transform(every, lambda x: F.lower(x))
    return F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def gap_report(matches: DataFrame, resumes: DataFrame) -> DataFrame:
    """One row a person: titles in order, missing skills, and gaps of pay and years to the average top match.

    matches: (resume_id, rank, title, salary_max, job_years, missing); resumes: (resume_id, want_max, years).
    """
    tops = F.array_sort(F.collect_list(F.struct("rank", "title", "missing")))
    per = matches.groupBy("resume_id").agg(tops.alias("tops"), F.avg("salary_max").alias("pay"), F.avg("job_years").alias("job_years"))
    per = per.withColumns({"baseline_roles": F.transform("tops", lambda x: x["title"]), "missing": missing_skills(F.transform("tops", lambda x: x["missing"]))}).drop("tops")
    out = resumes.join(per, "resume_id", "left")
    gap = lambda a, b: F.when(a.isNull() | b.isNull(), 0).otherwise(F.greatest(F.lit(0), F.bround(a - b, 0).cast("int")))
    none = F.array().cast("array<string>")
    return out.select(
        "resume_id", F.coalesce("baseline_roles", none).alias("baseline_roles"), F.coalesce("missing", none).alias("missing_skills"),
        gap(F.col("pay"), F.when(F.col("want_max") > 0, F.col("want_max"))).alias("salary_gap"), gap(F.col("job_years"), F.col("years").cast("double")).alias("experience_gap_years"),
    )


def job_gaps(pairs: DataFrame) -> DataFrame:
    """Rule-based insights of each match: (…, years_gap, skill_status, years_status, salary_status, insight).

    pairs: (resume_id, job_id, missing, years, min_years, has_salary, salary_min, salary_max, want_min, want_max).
    """
    lack = F.size("missing")
    years = F.greatest(F.lit(0), F.ceil(F.coalesce("min_years", F.lit(0)) - F.coalesce("years", F.lit(0))).cast("int"))
    skill = F.when(lack == 0, "ready").when(lack <= 2, "close").otherwise("gap")
    when = F.when(years == 0, "ready").when(years == 1, "close").otherwise("gap")
    pay = (
        F.when(~F.col("has_salary") | (F.coalesce("want_min", F.lit(0)) <= 0), "unknown").when(F.col("salary_max") < F.col("want_min"), "below").when(F.col("salary_min") > F.col("want_max"), "above").otherwise("overlap")
    )
    out = pairs.withColumns({"years_gap": years, "skill_status": skill, "years_status": when, "salary_status": pay})
    text = F.concat_ws(
        "; ", F.when(lack > 0, F.concat(F.lit("missing "), F.array_join(F.slice("missing", 1, 3), ", "))), F.when(F.col("years_gap") > 0, F.concat(F.lit("short of "), F.col("years_gap").cast("string"), F.lit(" years"))),
        F.when(F.col("salary_status") == "below", "pays less than expected"),
    )
    return out.withColumn("insight", F.coalesce(F.nullif(text, F.lit("")), F.lit("no gap")))


def funnel(pairs: DataFrame) -> DataFrame:
    """Counts by person, status and reason, with totals over people (resume_id null)."""
    return pairs.rollup("resume_id", "status", "filter_reason").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).filter("level in (0, 3)").drop("level")
