"""Agreement of two rankings, and reports over many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip


def spearman(ranks: DataFrame, by: str = "resume_id", a: str = "rank_a", b: str = "rank_b", k: int = 5) -> DataFrame:
    """(by, n, rho, distance, normalised_distance, top_overlap) of two complete rankings; one item agrees fully."""
    d = F.col(a) - F.col(b)
    n = F.col("n").cast("double")
    rows = ranks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("distance"), F.count_if((F.col(a) <= k) & (F.col(b) <= k)).alias("top_overlap"))
    full = n * (n * n - 1)
    rho = F.when(n <= 1, 1.0).otherwise(F.round(1 - 6.0 * F.col("distance") / full, 6))
    return rows.select(by, "n", rho.alias("rho"), "distance", F.when(n <= 1, 0.0).otherwise(F.round(3.0 * F.col("distance") / full, 6)).alias("normalised_distance"), "top_overlap")


def rho_label(rho: Column) -> Column:
    return F.when(rho >= 0.8, "strong").when(rho >= 0.5, "medium").otherwise("weak")


def rank_shift(ranks: DataFrame, by: str = "resume_id", item: str = "item", a: str = "rank_a", b: str = "rank_b", big: int = 3) -> DataFrame:
    """How far each item moves, with its place in the list of largest moves."""
    shift = F.col(a) - F.col(b)
    out = ranks.withColumns({"shift": shift, "is_big": F.abs(shift) >= big})
    return out.withColumn("shift_order", F.row_number().over(W.partitionBy(by).orderBy(F.desc(F.abs("shift")), a, item)))


def same_items(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on one side only; none if the two sets are equal."""
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def repair_order(listed: DataFrame, candidates: DataFrame, by: str = "resume_id", item: str = "job_id") -> DataFrame:
    """A complete order from a listed one: unknown items go, the first of repeats stays, missing ones follow in candidate order.

    listed: (by, item, pos); candidates: (by, item, rank).
    """
    first = listed.groupBy(by, item).agg(F.min("pos").alias("pos"))
    rows = candidates.select(by, item, "rank").join(first, [by, item], "left")
    order = F.row_number().over(W.partitionBy(by).orderBy(F.col("pos").isNull(), "pos", "rank"))
    return rows.select(by, item, order.alias("position"), F.col("pos").isNull().alias("appended"))


def against_algorithm(algorithm: DataFrame, external: DataFrame, by: str = "resume_id", item: str = "job_id") -> DataFrame:
    """(by, item, rank_a, rank_b) of the items that both have: the algorithm's order and that of external scores.

    algorithm and external: (by, item, rank). Ranks are counted anew among the common items, so that ``spearman`` holds.
    """
    rows = algorithm.select(by, item, F.col("rank").alias("a")).join(external.select(by, item, F.col("rank").alias("b")), [by, item])
    place = lambda order: F.row_number().over(W.partitionBy(by).orderBy(order, item))
    return rows.select(by, item, place("a").alias("rank_a"), place("b").alias("rank_b"))


def validate_scores(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with ``score`` (0 to 100, one digit) and the parts that are valid, from a JSON payload; else null."""
    p = F.from_json(payload, "score string, skill string, experience string, domain string, location string, education string, salary string")
    ok = lambda x: F.when(x.try_cast("double").between(0, 100), F.round(x.try_cast("double"), 1))
    names = ("score", "skill", "experience", "domain", "location", "education", "salary")
    return df.withColumn("p", p).withColumns({n: ok(F.col(f"p.{n}")) for n in names}).drop("p")


def summarize(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """count, mean, median, min and max of each column, four digits."""
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        out += [F.count(x).alias(f"{c}_n"), F.round(F.avg(x), 4).alias(f"{c}_mean"), F.round(F.median(x), 4).alias(f"{c}_median"), F.round(F.min(x), 4).alias(f"{c}_min"), F.round(F.max(x), 4).alias(f"{c}_max")]
    return df.groupBy(*(by or [])).agg(*out)


def fill_report(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(field, filled, kept, lost): how often processing fills a field that the source left empty, by field name.

    ``pairs``: name to (source, processed). Null and '' are empty.
    """
    full = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    each = F.array(*[F.struct(F.lit(n).alias("field"), full(a).alias("before"), full(b).alias("after")) for n, (a, b) in pairs.items()])
    rows = df.select(F.explode(each).alias("x")).select("x.*")
    return rows.groupBy("field").agg(F.count_if(~F.col("before") & F.col("after")).alias("filled"), F.count_if(F.col("before") & F.col("after")).alias("kept"), F.count_if(F.col("before") & ~F.col("after")).alias("lost"))


#: Paths of raw openings, any of which may hold a field, and the field's path in the normalised record.
FILL_PATHS = (
    (("department", "basic_info.department"), "basic_info.department"),
    (("location", "basic_info.location"), "basic_info.location"),
    (("job_type", "basic_info.job_type"), "basic_info.job_type"),
    (("salary_negotiable", "basic_info.salary_negotiable"), "basic_info.salary_negotiable"),
    (("salary_min", "basic_info.salary_min", "salary_range.min"), "basic_info.salary_min"),
    (("salary_max", "basic_info.salary_max", "salary_range.max"), "basic_info.salary_max"),
    (("salary_months_min", "basic_info.salary_months_min"), "basic_info.salary_months_min"),
    (("salary_months_max", "basic_info.salary_months_max"), "basic_info.salary_months_max"),
    (("intern_salary_amount", "basic_info.intern_salary_amount"), "basic_info.intern_salary_amount"),
    (("intern_salary_unit", "basic_info.intern_salary_unit"), "basic_info.intern_salary_unit"),
    (("responsibilities", "basic_info.responsibilities"), "basic_info.responsibilities"),
    (("highlights", "basic_info.highlights"), "basic_info.highlights"),
    (("skill_requirements.required",), "skill_requirements.required"),
    (("skill_requirements.bonus",), "skill_requirements.bonus"),
    (("experience_requirements.core",), "experience_requirements.core"),
    (("experience_requirements.min_total_years", "experience_years", "min_total_years"), "experience_requirements.min_total_years"),
    (("experience_requirements.max_total_years", "max_total_years"), "experience_requirements.max_total_years"),
    (("education_constraints.min_degree", "min_degree"), "education_constraints.min_degree"),
    (("education_constraints.prefer_degrees",), "education_constraints.prefer_degrees"),
    (("education_constraints.required_majors",), "education_constraints.required_majors"),
    (("education_constraints.preferred_majors",), "education_constraints.preferred_majors"),
    (("education_constraints.languages",), "education_constraints.languages"),
    (("education_constraints.certifications",), "education_constraints.certifications"),
    (("education_constraints.age_range",), "education_constraints.age_range"),
    (("education_constraints.other",), "education_constraints.other"),
    (("tags",), "tags"),
)


def _paths_schema(paths) -> str:
    """The DDL of a record whose paths, one or two names deep, are all texts (JSON text where they hold more)."""
    tree: dict[str, list[str]] = {}
    for head, _, leaf in (p.partition(".") for p in paths):
        tree.setdefault(head, []).extend([leaf] if leaf else [])
    return ", ".join(f"{head} struct<{', '.join(f'{x}: string' for x in leaves)}>" if leaves else f"{head} string" for head, leaves in tree.items())


def job_fill_report(raw: DataFrame, jobs: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """``fill_report`` of raw openings (id, JSON payload) and their normalised records over ``FILL_PATHS``.

    Blank texts, empty lists and empty objects are empty. A payload is parsed once; records without the other side are left out.
    """
    parsed = F.from_json(F.col(payload_col), _paths_schema([p for paths, _ in FILL_PATHS for p in paths]))
    source = raw.select(F.col(id_col).alias("__id"), parsed.alias("__raw"))
    rows = source.join(jobs.withColumnRenamed(id_col, "__id"), "__id")
    given = lambda c: F.when(~strip(c).isin("", "[]", "{}"), c)
    lists = lambda c, kind: F.when(F.size(c) > 0, "x") if kind.startswith("array") else strip(c.cast("string"))
    schema = rows.schema  # once: each look at a frame's schema plans all it is made of

    def kind(path: str) -> str:
        at = schema
        for name in path.split("."):
            at = at[name].dataType
        return at.simpleString()

    return fill_report(rows, {path: (F.coalesce(*[given(F.col(f"__raw.{p}")) for p in paths]), lists(F.col(path), kind(path))) for paths, path in FILL_PATHS})


def prompt_payload(title: Column, summary: Column, skills: Column, keywords: Column, top: int = 12) -> Column:
    """A compact JSON of one record: the head of each list, the summary in brief."""
    return F.to_json(F.struct(title.alias("title"), F.substring(summary, 1, 400).alias("summary"), F.slice(skills, 1, top).alias("skills"), F.slice(keywords, 1, top).alias("keywords")))
