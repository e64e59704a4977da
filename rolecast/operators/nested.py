"""Defaults and drop rules of the lists inside an opening's record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, strings

#: What stands where a record names nothing.
NO_TITLE, NO_GROUP, NO_TYPE = "Untitled Role", "Optional Skills", "project"


def named(items: Column, field: str, **other) -> Column:
    """The items whose ``field`` names something, cleaned; ``other`` gives further fields by a function of the item."""

    def cleaned(x: Column) -> Column:
        out = x.withField(field, clean_text(x[field]))
        for name, value in other.items():
            out = out.withField(name, value(x))
        return out

    return F.filter(F.transform(F.coalesce(items, F.array()), cleaned), lambda x: x[field].isNotNull())


def _type(x: Column) -> Column:
    return F.coalesce(F.nullif(x["type"], F.lit("")), F.lit(NO_TYPE))


def _list(name: str):
    return lambda x: F.coalesce(x[name], strings())


def clean_openings(jobs: DataFrame) -> DataFrame:
    """Openings (schema ``schemas.JOB``) without skills, groups, experience, languages and tags that name nothing.

    A group without skills goes; one without a name, an experience without a type and an opening without a title get the
    usual word; a group needs one of its skills and a language isn't required unless it says so. Missing lists are empty.
    """
    c = F.col
    skills, exp, edu, info = c("skill_requirements"), c("experience_requirements"), c("education_constraints"), c("basic_info")
    groups = F.transform(
        F.coalesce(skills["optional_groups"], F.array()),
        lambda g: g.withField("group_name", F.coalesce(clean_text(g["group_name"]), F.lit(NO_GROUP))).withField("min_required", F.coalesce(g["min_required"], F.lit(1))).withField("skills", named(g["skills"], "name")),
    )
    core = lambda x: named(x, "name", type=_type, keywords=_list("keywords"))
    full = lambda record, *fields: {f: F.coalesce(record[f], strings()) for f in fields}

    def with_fields(record: Column, values: dict[str, Column]) -> Column:
        for name, value in values.items():
            record = record.withField(name, value)
        return record

    return jobs.withColumns(
        {
            "basic_info": with_fields(info, {"title": F.coalesce(F.nullif(info["title"], F.lit("")), F.lit(NO_TITLE)), **full(info, "responsibilities", "highlights")}),
            "skill_requirements": with_fields(skills, {"required": named(skills["required"], "name"), "optional_groups": F.filter(groups, lambda g: F.size(g["skills"]) > 0), "bonus": named(skills["bonus"], "name")}),
            "experience_requirements": with_fields(exp, {"core": core(exp["core"]), "bonus": core(exp["bonus"])}),
            "education_constraints": with_fields(edu, {"languages": named(edu["languages"], "language", required=lambda x: F.coalesce(x["required"], F.lit(False))), **full(edu, "prefer_degrees", "required_majors", "preferred_majors", "certifications", "other")}),
            "tags": named(c("tags"), "name"),
        }
    )
