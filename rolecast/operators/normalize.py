"""Raw postings and resumes brought into the nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import facets, parsing
from ..functions.dictionaries import STACK_WORDS, STACKS
from ..functions.text import collapse, compact_range, contains_any, dedupe_ci, first_list, meaningful, meaningful_values, none_of, scrub_contacts, section_text, shortened, strings, strip
from ..storage import staged
from . import tags as T
from .maintain import changed_rows, tag_counts
from .nested import clean_openings

#: What opens and what closes the part of a resume that tells of work.
_WORK_STARTS = ("工作经历", "工作经验")
_WORK_ENDS = ("项目经历", "项目经验", "教育经历", "教育背景", "技能", "自我评价")
_RANGE = r"(\d{4}[.\-/年]\d{1,2})月?\s*(?:[-–—~～]+|至|到)\s*(\d{4}[.\-/年]\d{1,2}|至今|[Pp]resent)"
_COMPANY = r"([^\s|,，]*(?:公司|集团|科技|网络|银行|Inc\.?|Ltd\.?|Corp\.?|Technologies))"
_TITLE = r"([^\s|,，]*(?:工程师|开发|经理|架构师|主管|总监|实习生|[Ee]ngineer|[Dd]eveloper|[Mm]anager|[Aa]rchitect|[Ii]ntern))"


def normalize_jobs(flat: DataFrame, as_of: Column, model: DataFrame | None = None) -> DataFrame:
    """Nested openings from the flat ones of ``sources.records.map_boards``.

    Required skills are the first three found, bonus ones the next five with weights from 5 down; core experience the first
    two topics. Lists hold nothing without a name as they come from rules; stored records are cleaned by ``rebuilt_openings``. ``model(id, title, summary, location, skills, min_degree)``, if given, goes before what the rules find.
    """
    c = F.col
    rows = flat
    if model is not None:
        m = model.select("id", *[F.col(n).alias(f"m_{n}") for n in ("title", "summary", "location", "skills", "min_degree")])
        rows = rows.join(m, "id", "left")
        for n in ("title", "summary", "location", "min_degree"):
            rows = rows.withColumn(n, F.coalesce(f"m_{n}", n))
        rows = rows.withColumn("skills", first_list(c("m_skills"), c("skills")))
    text = F.coalesce("text", "summary")
    duty, plus = parsing.responsibilities(F.coalesce(text, F.lit(""))), parsing.highlights(F.coalesce(text, F.lit("")))
    skills, roles = c("skills"), facets.role_categories(c("title"), c("summary"))
    intern = facets.is_internship(c("title"), none_of("string"), c("summary"))
    modes, cities, ai = facets.work_modes(c("title"), c("location"), c("summary")), facets.match_city_list(c("location")), facets.ai_capabilities(c("title"), c("summary"))
    low, high = c("years.min"), c("years.max")
    level = facets.job_seniority(c("title"), c("summary"), none_of("string"), low, high)
    band = facets.salary_band(c("pay.min"), c("pay.max"), c("pay.intern_amount"))
    topics = dedupe_ci(F.concat(F.slice("industry", 1, 2), F.slice("general", 1, 4)))
    when = parsing.posted(as_of, c("posted_at"))
    edu = parsing.education_constraints(F.coalesce(text, F.lit("")))
    # Columns of their own, as the optimizer doesn't repeat what several fields read: planning takes half the time.
    made = {"_duty": duty, "_plus": plus, "_roles": roles, "_intern": intern, "_modes": modes, "_cities": cities, "_ai": ai, "_level": level, "_band": band, "_topics": topics, "_when": when, "_edu": edu}
    rows = rows.withColumns(made)
    duty, plus, roles, intern, modes, cities, ai, level, band, topics, when, edu = (c(n) for n in made)
    tech = F.transform(F.slice(skills, 1, 8), lambda s: F.struct(s.alias("name"), F.lit("tech").alias("category"), none_of("int").alias("weight"), none_of("string").alias("slug"), F.lit(False).alias("filterable"), none_of("string").alias("facet_key"), none_of("string").alias("facet_value")))
    return rows.select(
        "id", "company",
        F.struct(
            c("title"), none_of("string").alias("department"), c("location"), F.when(intern, "intern").alias("job_type"), c("pay.negotiable").alias("salary_negotiable"), c("pay.min").alias("salary_min"), c("pay.max").alias("salary_max"),
            c("pay.months_min").alias("salary_months_min"), c("pay.months_max").alias("salary_months_max"), c("pay.intern_amount").alias("intern_salary_amount"), c("pay.intern_unit").alias("intern_salary_unit"), F.lit("CNY").alias("currency"),
            c("summary"), duty.alias("responsibilities"), plus.alias("highlights"),
        ).alias("basic_info"),
        F.struct(
            F.transform(F.slice(skills, 1, 3), lambda s: F.struct(s.alias("name"), none_of("string").alias("level"), none_of("double").alias("min_years"), none_of("string").alias("description"))).alias("required"),
            F.array().cast("array<struct<group_name:string, description:string, min_required:int, skills:array<struct<name:string, level:string, description:string>>>>").alias("optional_groups"),
            F.transform(F.slice(skills, 4, 5), lambda s, i: F.struct(s.alias("name"), (F.lit(5) - i).cast("int").alias("weight"), none_of("string").alias("description"))).alias("bonus"),
        ).alias("skill_requirements"),
        F.struct(
            F.transform(F.slice(topics, 1, 2), lambda s: F.struct(F.lit("domain").alias("type"), s.alias("name"), none_of("double").alias("min_years"), none_of("string").alias("description"), strings().alias("keywords"))).alias("core"),
            F.array().cast("array<struct<type:string, name:string, weight:int, description:string, keywords:array<string>>>").alias("bonus"), low.alias("min_total_years"), high.alias("max_total_years"),
        ).alias("experience_requirements"),
        F.struct(F.coalesce("min_degree", edu["min_degree"]).alias("min_degree"), *[edu[n].alias(n) for n in ("prefer_degrees", "required_majors", "preferred_majors", "languages", "certifications", "age_range", "other")]).alias("education_constraints"),
        F.concat(tech, T.job_tags(roles, modes, cities, ai, intern, level, band)).alias("tags"),
        F.struct(
            roles.alias("role_categories"), modes.alias("work_modes"), cities.alias("city_tokens"), ai.alias("ai_capabilities"), intern.alias("is_internship"), level.alias("seniority_level"), band.alias("salary_band"), when["posted_at"].alias("posted_at"),
            when["posted_days_ago"].alias("posted_days_ago"), low.alias("min_experience_years"), high.alias("max_experience_years"),
        ).alias("filter_facets"),
    )


def resume_years(df: DataFrame, as_of: Column) -> DataFrame:
    """df with ``years``: stated as a number, else in words, else the span of work, else the longest skill, else 0."""
    c = F.col
    starts = F.transform("work_experiences", lambda w: parsing.month_index(w["start_date"], as_of))
    ends = F.transform("work_experiences", lambda w: F.coalesce(parsing.month_index(w["end_date"], as_of), parsing.month_index(w["start_date"], as_of)))
    span = parsing.span_years(F.array_max(ends) - F.array_min(starts))
    said = F.coalesce(*[parsing.stated_years(x) for x in (c("basic_info.summary"), c("basic_info.self_evaluation"), c("raw_text"))])
    return df.withColumn("years", F.coalesce(F.when(c("basic_info.work_years") > 0, c("basic_info.work_years")), F.when(said > 0, said), span, F.array_max(F.transform("skills", lambda s: s["years"])), F.lit(0)))


def work_from_text(resumes: DataFrame, id_col: str = "id", text_col: str = "raw_text") -> DataFrame:
    """(id, pos, company_name, title, start_date, end_date) of lines with a range of months, dates as YYYY.MM.

    Read is the part on work where the text has one, else all of it; lines that name neither company nor title are left out.
    """
    text = F.coalesce(*[section_text(F.col(text_col), m, _WORK_ENDS) for m in _WORK_STARTS], F.col(text_col))
    lines = resumes.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(F.col("line").rlike(_RANGE))
    month = lambda i: F.regexp_replace(parsing.group(F.col("line"), _RANGE, i), r"^(\d{4})[.\-/年](\d)$", "$1.0$2")
    dot = lambda x: F.regexp_replace(F.regexp_replace(x, r"^(\d{4})[.\-/年](\d{2})$", "$1.$2"), r"^[Pp]resent$", "至今")
    rest = strip(F.regexp_replace("line", _RANGE, " "))
    company = parsing.group(rest, _COMPANY, 1)
    title = parsing.group(F.replace(rest, F.coalesce(company, F.lit("\u0000")), F.lit(" ")), _TITLE, 1)
    return lines.select("id", "pos", company.alias("company_name"), title.alias("title"), dot(month(1)).alias("start_date"), dot(month(2)).alias("end_date")).filter("company_name is not null or title is not null")


def merge_work(extracted: DataFrame, inferred: DataFrame, as_of: Column, order: str = "present_first") -> DataFrame:
    """One work history a person from two: rows of one date key fill each other, the stored one leading; then in order of time.

    Both: (id, pos, company_name, title, start_date, end_date); blank is null. A stored row without dates, company or title is filled
    by the read row in the same place. Read rows of other dates are added. Of rows with the same dates the one with most of company and
    title stays, of equals the first; undated ones all stay. Ongoing work comes first, then the latest end; ``order='literal'``
    puts undated rows first and ongoing work last.
    """
    fields = ("company_name", "title", "start_date", "end_date")
    key = F.when(F.coalesce("start_date", "end_date").isNotNull(), F.concat(F.coalesce("start_date", F.lit("")), F.lit("|"), F.coalesce("end_date", F.lit(""))))
    place = F.row_number().over(W.partitionBy("id").orderBy("pos"))
    clean = lambda df: df.select("id", "pos", *[F.nullif(strip(F.col(n)), F.lit("")).alias(n) for n in fields]).withColumns({"key": key, "place": place})
    own, read, whole = clean(extracted), clean(inferred), F.struct(*fields)
    by_key = read.groupBy("id", "key").agg(F.max_by(whole, F.col("pos")).alias("same_dates"))
    by_place = read.select("id", F.col("place").alias("blank_place"), whole.alias("same_place"))
    nameless = F.col("company_name").isNull() & F.col("title").isNull()
    other = F.coalesce("same_dates", "same_place")
    filled = own.withColumn("blank_place", F.when(F.col("key").isNull() & nameless, F.col("place"))).join(by_key, ["id", "key"], "left").join(by_place, ["id", "blank_place"], "left")
    values = {n: F.coalesce(n, other[n]) for n in fields}  # a row without a name has no dates of its own or the other's
    filled = filled.select("id", "pos", *[v.alias(n) for n, v in values.items()]).withColumns({"key": key, "source": F.lit(0)})
    added = read.join(filled.select("id", "key").distinct(), ["id", "key"], "left_anti").withColumn("source", F.lit(1))
    rows = filled.unionByName(added.select(*filled.columns))
    score = sum((F.when(F.col(n).isNotNull(), 2).otherwise(0) for n in fields[:2]), F.lit(0))
    name = F.coalesce("key", F.concat(F.lit("#"), F.col("source").cast("string"), F.lit("/"), F.col("pos").cast("string")))
    first = F.struct((-score).alias("score"), "source", "pos")
    merged = rows.withColumns({"name": name, "b": first}).groupBy("id", "name").agg(F.min_by(whole, F.col("b")).alias("w"), F.min("b").alias("b")).select("id", "b", "w.*")
    end = F.coalesce(parsing.month_index(F.col("end_date"), as_of), parsing.month_index(F.col("start_date"), as_of))
    now = F.coalesce(F.col("end_date").contains("至今"), F.lit(False))
    by = [now.desc(), end.desc_nulls_last(), "b"] if order == "present_first" else [end.desc_nulls_first(), now.asc(), "b"]
    return merged.withColumn("position", F.row_number().over(W.partitionBy("id").orderBy(*by))).select("id", "position", *fields)


def repaired_history(resumes: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Work histories that the text improves: the merged history of people whose stored one (id, pos, …) differs from it."""
    merged = merge_work(stored, work_from_text(resumes), as_of)
    fields = ["company_name", "title", "start_date", "end_date"]
    flat = lambda df, pos: df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).cast("int").alias("p"), *fields))).alias("h"))
    new, old = flat(merged, "position"), flat(stored, "pos").select("id", F.col("h").alias("old"))
    bare = lambda c: F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in fields]))
    return new.join(old, "id", "left").filter(~bare("h").eqNullSafe(bare("old"))).select("id", bare("h").alias("work_experiences"))


def normalize_resumes(resumes: DataFrame, as_of: Column) -> DataFrame:
    """Nested resumes with defaults filled: years, current title and company from the latest work, tags and facets.

    Text is cleaned and cut to 12,000 characters, the summary scrubbed of contacts.
    """
    c = F.col
    rows = resume_years(resumes.withColumn("raw_text", parsing.clean_raw(F.coalesce("raw_text", F.lit("")))), as_of)
    last = F.array_max(F.transform("work_experiences", lambda w, i: F.struct(F.coalesce(parsing.month_index(w["end_date"], as_of), F.lit(0)).alias("m"), (-i).alias("i"), w["title"].alias("title"), w["company_name"].alias("company"))))
    title, company = F.coalesce(c("basic_info.current_title"), last["title"]), F.coalesce(c("basic_info.current_company"), last["company"])
    summary = scrub_contacts(F.coalesce("basic_info.summary", "basic_info.self_evaluation", F.substring("raw_text", 1, 200)))
    city, names = c("basic_info.current_city"), F.array_join(F.transform("skills", lambda s: s["name"]), " ")
    roles = facets.role_categories(title, summary)
    level = facets.resume_seniority(title, summary, c("years"))
    pay = facets.inferred_salary(c("years"), level, roles, city, c("raw_text"))
    places, modes, ai = facets.target_cities(city, c("raw_text")), facets.resume_work_modes(c("raw_text")), facets.ai_capabilities(title, summary, names, c("raw_text"))
    info = F.struct(*[{"current_title": title, "current_company": company, "summary": summary}.get(f, c(f"basic_info.{f}")).alias(f) for f in resumes.schema["basic_info"].dataType.names])
    facet = F.struct(
        T.facet_values(c("tags"), "role_categories", roles).alias("role_categories"), T.facet_values(c("tags"), "target_cities", places).alias("target_cities"), T.facet_values(c("tags"), "preferred_work_modes", modes).alias("preferred_work_modes"),
        T.facet_values(c("tags"), "ai_capabilities", ai).alias("ai_capabilities"), F.coalesce(F.try_element_at(T.facet_values(c("tags"), "seniority_level"), F.lit(1)), level).alias("seniority_level"), pay["min"].alias("inferred_salary_min"), pay["max"].alias("inferred_salary_max"),
    )
    plain = F.filter(F.coalesce("tags", F.array().cast(f"array<{T.TAG}>")), lambda t: ~F.coalesce(t["filterable"], F.lit(False)))
    return rows.withColumns({"filter_facets": facet, "tags": F.concat(plain, T.resume_tags(roles, places, modes, ai, level, pay)), "basic_info": info})


def display_summary(df: DataFrame) -> DataFrame:
    """df with ``display_summary``: the summary without contacts, cut at 500 characters; of a mere dump or none, a sentence."""
    c = F.col
    dump = contains_any(F.lower(F.coalesce("basic_info.summary", F.lit(""))), ("手机", "电话", "邮箱", "email", "phone"))
    text = collapse(scrub_contacts(F.coalesce("basic_info.summary", F.lit(""))))
    names = lambda a, n: F.array_join(F.slice(F.transform(a, lambda x: x["name"]), 1, n), ", ")
    made = F.concat_ws("; ", c("basic_info.current_title"), c("basic_info.current_city"), F.nullif(names("skills", 5), F.lit("")), F.nullif(names("projects", 2), F.lit("")))
    cut = F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("…"))).otherwise(text)
    return df.withColumn("display_summary", F.when(dump | (text == ""), made).otherwise(cut))


def _items(w: Column) -> Column:
    return meaningful_values(F.concat(F.coalesce(w["responsibilities"], strings()), F.coalesce(w["achievements"], strings())))


def experience_headline(w: Column) -> Column:
    """Of a piece of work: its title, else company, else the kind of work by its stack and items, else the head of its first item, else a plain word."""
    stack, told = F.transform(meaningful_values(F.coalesce(w["tech_stack"], strings())), F.lower), F.lower(F.array_join(_items(w), " "))
    does = {k: F.arrays_overlap(stack, strings(*STACKS[k])) | contains_any(told, STACK_WORDS[k]) for k in STACKS}
    several = sum((d.cast("int") for d in does.values()), F.lit(0)) > 1
    kind = F.when(several, "全栈开发经历")
    for k, d in does.items():
        kind = kind.when(d, f"{k}开发经历")
    first = shortened(F.try_element_at(meaningful_values(F.coalesce(w["responsibilities"], strings())), F.lit(1)), 24)
    return F.coalesce(*[F.when(meaningful(w[n]), w[n]) for n in ("title", "company_name")], kind, first, F.lit("开发经历"))


def experience_meta(w: Column) -> Column:
    """What stands under the headline: the company (below a title) or industry, else the place, else the level."""
    first = F.when(meaningful(w["title"]), w["company_name"]).otherwise(w["industry"])
    return F.coalesce(*[F.when(meaningful(x), x) for x in (first, w["location"], w["level"])])


def experience_note(w: Column) -> Column:
    """The first item in 80 characters, else up to four names of the stack."""
    stack = F.slice(meaningful_values(F.coalesce(w["tech_stack"], strings())), 1, 4)
    return F.coalesce(shortened(F.try_element_at(_items(w), F.lit(1)), 80), F.when(F.size(stack) > 0, F.concat(F.lit("技术栈："), F.array_join(stack, " / "))))


def salary_label(info: Column) -> Column:
    """The pay of an opening's basic_info: negotiable, a range with its currency, a rate of interns, months paid; what is missing is left out."""
    currency = F.when(meaningful(info["currency"]), info["currency"]).otherwise("CNY")
    unit = F.coalesce(F.concat(F.lit(" "), F.nullif(info["intern_salary_unit"], F.lit(""))), F.lit(""))
    pay = F.coalesce(compact_range(info["salary_min"], info["salary_max"], F.concat(F.lit(" "), currency)), compact_range(info["intern_salary_amount"], info["intern_salary_amount"], unit))
    months = compact_range(info["salary_months_min"], info["salary_months_max"], " 薪")
    label = F.concat_ws(" / ", pay, months)
    return F.when(F.coalesce(info["salary_negotiable"], F.lit(False)), "薪资面议").when(label != "", label).otherwise("暂无薪资信息")


def monthly_label(low: Column, high: Column) -> Column:
    """A wanted monthly pay: both ends, one of them, or none."""
    return F.when(low.isNotNull() & high.isNotNull(), compact_range(low, high, " 元/月")).when(low.isNotNull(), compact_range(low, low, " 元/月起")).when(high.isNotNull(), compact_range(high, high, " 元/月以内")).otherwise("未注明")


def posted_label(at: Column, days: Column) -> Column:
    """The day of posting, else how many days ago."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.concat(days.cast("string"), F.lit(" 天前")), F.lit("未注明"))


def tag_changes(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Openings of ``now`` whose tags, roles or text aren't those of the stored ones, with the names of what differs in ``changed``."""
    watched = lambda df: df.select("*", F.transform("tags", lambda t: F.concat_ws(":", t["category"], t["name"])).alias("tag_names"), F.col("filter_facets.role_categories").alias("role_names"), F.col("basic_info.summary").alias("payload"))
    return changed_rows(watched(stored), watched(now), "id", ["tag_names", "role_names", "payload"]).drop("tag_names", "role_names", "payload")


def retag(stored: DataFrame, flat: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(openings whose tags, roles or text a new normalisation changes, tag counts by category before and after).

    All of ``flat`` is normalised; ``retagging.refresh_tags`` does so for stale records only. Writing the first, and refreshing its
    vectors, is up to the caller.
    """
    now = staged(normalize_jobs(flat, as_of))  # read three times, and long to plan
    long = lambda df: df.select(F.explode("tags").alias("t")).select("t.category")
    return tag_changes(stored, now), tag_counts(long(stored), long(now))


def rebuilt_openings(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Stored openings (schema ``schemas.JOB``) as they are used: defaults and drops of ``clean_openings``, standard tags made anew, facets where there are none.

    A tag that is no standard one stays. A record without facets, or with an empty set of them, gets those of its fields.
    """
    c, info, exp = F.col, F.col("basic_info"), F.col("experience_requirements")
    none = none_of("string")
    plain = F.filter(F.coalesce("tags", F.array().cast(f"array<{T.TAG}>")), lambda t: ~F.coalesce(t["filterable"], F.lit(False)))
    names = F.transform(plain, lambda t: t["name"])
    title = F.coalesce(F.nullif(info["title"], F.lit("")), F.lit("Untitled Role"))
    roles, modes = facets.role_categories(title, info["summary"], names), facets.work_modes(title, info["location"], info["summary"])
    cities, ai = facets.match_city_list(info["location"]), facets.ai_capabilities(title, info["summary"], F.array_join(names, " "))
    intern = facets.is_internship(title, info["job_type"], info["summary"])
    level = facets.job_seniority(title, info["summary"], info["job_type"], exp["min_total_years"], exp["max_total_years"])
    band = facets.salary_band(info["salary_min"], info["salary_max"], info["intern_salary_amount"])
    stored = c("filter_facets")
    made = {"role_categories": roles, "work_modes": modes, "city_tokens": cities, "ai_capabilities": ai, "is_internship": intern, "seniority_level": level, "salary_band": band, "posted_at": none, "posted_days_ago": none, "min_experience_years": exp["min_total_years"], "max_experience_years": exp["max_total_years"]}
    kinds = {f.name: f.dataType for f in jobs.schema["filter_facets"].dataType.fields}
    empty = stored.isNull() | ~F.greatest(F.lit(False), *[stored[n].isNotNull() for n in kinds])
    derived = F.struct(*[made[n].cast(kind).alias(n) for n, kind in kinds.items()])
    record = jobs.withColumns({"tags": F.concat(plain, T.job_tags(roles, modes, cities, ai, intern, level, band)), "filter_facets": F.when(empty, derived).otherwise(stored), "company": F.coalesce(F.nullif(c("company"), F.lit("")), F.lit("Company Pending"))})
    return clean_openings(record)
