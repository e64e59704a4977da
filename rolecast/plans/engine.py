"""The whole match over nested records: sides prepared once, pairs from recall, filters, scores, rank, diversification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig
from ..functions import facets, skills, text
from ..functions import scores as S
from ..functions.dictionaries import BRIDGES
from ..operators import filters, normalize, ranking, recall
from ..operators import skills as K


def _names(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array()), lambda x: x["name"])


def _direction(tags: Column) -> Column:
    keep = F.filter(F.coalesce(tags, F.array()), lambda t: F.lower(t["category"]).isin("tech", "domain", "industry"))
    return F.array_distinct(F.transform(keep, lambda t: skills.normalize_skill(t["name"])))


def asked_experience(x: Column, number: str) -> Column:
    """What scoring reads of an experience item: its words and description as terms, the skills in its text and the canonical forms of its words, made once an opening."""
    words = F.concat(F.array(x["name"]), F.coalesce(x["keywords"], text.strings()))
    hints = F.transform(skills.extract_skills(F.concat_ws(" ", x["name"], x["description"], F.array_join(F.coalesce(x["keywords"], text.strings()), " "))), skills.normalize_skill)
    return F.struct(F.transform(words, S.clean_term).alias("words"), S.clean_term(x["description"]).alias("description"), (F.lower(x["type"]) == "tech").alias("tech"), F.slice(hints, 1, 8).alias("hints"), F.transform(words, skills.normalize_skill).alias("norms"), x[number].alias(number))


def prepare_jobs(jobs: DataFrame) -> DataFrame:
    """One row an opening with all that scoring reads of it."""
    c, f = F.col, F.col("filter_facets")
    info, edu, exp = c("basic_info"), c("education_constraints"), c("experience_requirements")
    searched = facets.joined(info["title"], info["job_type"], info["summary"])
    required = _names(c("skill_requirements.required"))
    targets = F.array_union(skills.title_skills(info["title"]), F.array_intersect(F.transform(F.slice(required, 1, 3), skills.normalize_skill), text.strings(*BRIDGES)))
    low = F.coalesce(info["salary_min"], info["salary_max"])
    high = F.coalesce(info["salary_max"], info["salary_min"])
    listed = F.flatten(F.transform(F.coalesce(exp["core"], F.array()), lambda x: F.concat(F.array(x["name"]), F.coalesce(x["keywords"], text.strings()))))
    core = F.transform(F.coalesce(exp["core"], F.array()), lambda x: asked_experience(x, "min_years"))
    bonus = F.transform(F.coalesce(exp["bonus"], F.array()), lambda x: asked_experience(x, "weight"))
    tag_names = F.transform(F.filter(F.coalesce("tags", F.array()), lambda t: F.lower(t["category"]).isin("domain", "industry", "project")), lambda t: t["name"])
    return jobs.select(
        c("id").alias("job_id"), info["title"].alias("title"), c("company"), info["summary"].alias("job_summary"), searched.alias("searched"), facets.joined(info["title"], info["summary"]).alias("job_text"),
        F.coalesce(F.transform(f["role_categories"], F.lower), text.strings()).alias("roles"), F.coalesce(f["work_modes"], text.strings()).alias("modes"), f["is_internship"].alias("is_internship"), f["posted_days_ago"].alias("posted_days_ago"),
        f["min_experience_years"].alias("min_years"), f["max_experience_years"].alias("max_years"), facets.is_campus(searched).alias("campus"),
        (~F.coalesce(info["salary_negotiable"], F.lit(False)) & (F.coalesce(high, F.lit(0)) > 0)).alias("has_salary"), F.least(low, high).alias("salary_min"), F.greatest(low, high).alias("salary_max"),
        S.degree_rank(F.coalesce(edu["min_degree"], F.lit(""))).alias("job_degree"), (F.coalesce(edu["min_degree"], F.lit("")) != "").alias("has_degree"), F.transform(F.coalesce(edu["prefer_degrees"], text.strings()), S.degree_rank).alias("prefer_ranks"),
        F.coalesce(edu["required_majors"], text.strings()).alias("required_majors"), F.coalesce(edu["preferred_majors"], text.strings()).alias("preferred_majors"), text.match_cities(F.coalesce(info["location"], F.lit(""))).alias("places"),
        targets.alias("targets"), F.size(skills.title_skills(info["title"])).alias("title_needed"), skills.title_skills(info["title"]).alias("title_skills"), _direction(c("tags")).alias("job_tags"),
        skills.directional_signals(F.concat(F.array(info["title"]), F.slice(required, 1, 12))).alias("job_signals"), core.alias("core"), bonus.alias("bonus_experience"), exp["min_total_years"].alias("min_total_years"),
        K.terms(F.concat(listed, tag_names, F.array(info["title"], c("company")))).alias("job_terms"),
    )


def job_skill_rows(jobs: DataFrame) -> DataFrame:
    """The long table of asked skills."""
    r = F.col("skill_requirements")
    row = lambda kind, group, pos, name, level, years, weight, least: F.struct(F.lit(kind).alias("kind"), group.cast("int").alias("group_pos"), pos.cast("int").alias("pos"), name.alias("skill"), S.level_rank(F.coalesce(level, F.lit(""))).alias("level_rank"), years.cast("double").alias("min_years"), weight.cast("int").alias("weight"), least.cast("int").alias("min_required"))
    n = F.lit(None)
    required = F.transform(F.coalesce(r["required"], F.array()), lambda x, i: row("required", F.lit(0), i + 1, x["name"], x["level"], x["min_years"], n, n))
    groups = F.flatten(F.transform(F.coalesce(r["optional_groups"], F.array()), lambda g, j: F.transform(F.coalesce(g["skills"], F.array()), lambda x, i: row("optional", j, i + 1, x["name"], x["level"], n, n, g["min_required"]))))
    bonus = F.transform(F.coalesce(r["bonus"], F.array()), lambda x, i: row("bonus", F.lit(0), i + 1, x["name"], n.cast("string"), n, x["weight"], n))
    rows = jobs.select(F.col("id").alias("job_id"), F.explode(F.concat(required, groups, bonus)).alias("x")).select("job_id", "x.*")
    return rows.withColumn("norm", skills.normalize_skill(F.col("skill")))


def prepare_resumes(resumes: DataFrame, as_of: Column, index: DataFrame | None = None) -> DataFrame:
    """One row a person with all that scoring reads of them; ``own`` is the map of canonical skills (of ``index``, if there)."""
    c, f = F.col, F.col("filter_facets")
    rows = normalize.resume_years(resumes, as_of)
    info, work, projects = c("basic_info"), F.coalesce("work_experiences", F.array()), F.coalesce("projects", F.array())
    pay = S.expected_salary(c("expected_salary.min"), c("expected_salary.max"), f["inferred_salary_min"], f["inferred_salary_max"])
    names = F.concat(_names(c("skills")), F.flatten(F.transform(work, lambda w: F.coalesce(w["tech_stack"], text.strings()))), F.flatten(F.transform(projects, lambda p: F.coalesce(p["tech_stack"], text.strings()))))
    texts = F.flatten(F.transform(projects, lambda p: F.concat(F.array(p["name"], p["domain"], p["description"]), F.coalesce(p["responsibilities"], text.strings()), F.coalesce(p["achievements"], text.strings()))))
    done = F.flatten(F.transform(work, lambda w: F.concat(F.array(w["industry"], w["title"]), F.coalesce(w["responsibilities"], text.strings()), F.coalesce(w["achievements"], text.strings()))))
    terms = K.terms(F.concat(names, texts, done, _names(c("tags")), F.array(info["current_title"], info["current_company"])))
    ranks = F.concat(F.array(S.degree_rank(F.coalesce(info["first_degree"], F.lit("")))), F.transform(F.coalesce("educations", F.array()), lambda e: S.degree_rank(F.coalesce(e["degree"], F.lit("")))))
    city = F.when(F.size(f["target_cities"]) > 0, F.array_join(f["target_cities"], ",")).otherwise(F.coalesce(info["current_city"], F.lit("")))
    out = rows.select(
        c("id").alias("resume_id"), c("years"), pay["min"].alias("want_min"), pay["max"].alias("want_max"), F.array_max(ranks).alias("degree"), F.filter(F.transform(F.coalesce("educations", F.array()), lambda e: e["major"]), lambda m: m.isNotNull()).alias("majors"),
        text.match_cities(city).alias("wanted"), terms.alias("terms"), F.lower(F.coalesce("raw_text", F.lit(""))).alias("raw"),
        facets.resume_roles(f["role_categories"], info["current_title"], info["summary"], c("raw_text"), F.array_join(F.slice(names, 1, 16), " ")).alias("resume_roles"), _direction(c("tags")).alias("resume_tags"),
        skills.directional_signals(F.concat(F.array(F.coalesce(info["current_title"], F.lit(""))), F.slice(names, 1, 24))).alias("resume_signals"),
    )
    return out.join(K.owned_maps(K.candidate_skill_index(resumes) if index is None else index), "resume_id", "left")


def experience_match(cfg: MatchConfig) -> Column:
    """Core and bonus experience, and years, over the prepared columns of a pair."""
    c = F.col

    def content(x: Column) -> Column:
        hits = F.array_max(F.transform(x["words"], lambda t: S.clean_term_hit(t, c("terms"), c("raw"))))
        bridge = F.when(F.arrays_overlap(x["hints"], c("owned")), F.when(x["tech"], 1.0).otherwise(0.8)).otherwise(0.0)
        tech = F.when(x["tech"] & F.arrays_overlap(x["norms"], c("owned")), 1.0).otherwise(0.0)
        return F.greatest(hits, S.clean_term_hit(x["description"], c("terms"), c("raw"), exact=False), bridge, tech)

    years = c("years").cast("double")
    contents = lambda name: F.transform(F.coalesce(name, F.array()), lambda x: F.struct(content(x).alias("s"), x.alias("x")))  # noqa: E731 - once an item, however often it is read
    core = F.transform(contents("core"), lambda y: S.experience_score(y["s"], years, y["x"]["min_years"]))
    bonus = F.transform(contents("bonus_experience"), lambda y: F.struct(y["s"].alias("s"), F.when(F.coalesce(y["x"]["weight"], F.lit(0)) == 0, 1).otherwise(y["x"]["weight"]).cast("double").alias("w")))
    mean = F.try_divide(F.aggregate(core, F.lit(0.0), lambda a, x: a + x), F.size("core"))
    plus = F.try_divide(F.aggregate(bonus, F.lit(0.0), lambda a, x: a + x["s"] * x["w"]), F.aggregate(bonus, F.lit(0.0), lambda a, x: a + x["w"]))
    on = lambda cond, w: F.when(cond, w).otherwise(0.0)
    return S.weighted(
        [(F.coalesce(mean, F.lit(0.0)), on(F.size("core") > 0, cfg.experience_core)), (F.coalesce(plus, F.lit(0.0)), on(F.size("bonus_experience") > 0, cfg.experience_bonus)), (S.ratio(years, F.coalesce("min_total_years", F.lit(0.0)), 0.7), on(c("min_total_years").isNotNull(), cfg.experience_total))], 0.5
    )


def score_pairs(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame, wishes: DataFrame | None, as_of: Column, cfg: MatchConfig = DEFAULT, skill_vectors: DataFrame | None = None, domain_vectors: DataFrame | None = None) -> DataFrame:
    """pairs(resume_id, job_id, vector, recall_rank) with reason, components, penalties, total, matched and missing skills.

    A pair whose opening isn't stored keeps its row, with status 'job_missing'. ``skill_vectors``: (norm, vector); ``domain_vectors``: (namespace
    'jobs' or 'resumes', item_id, vector) of the domain texts, whose cosine counts where shared terms say less.
    """
    c = F.col
    index, asked = K.candidate_skill_index(resumes), job_skill_rows(jobs)
    people, openings = prepare_resumes(resumes, as_of, index), prepare_jobs(jobs).join(K.asked_arrays(asked), "job_id", "left").withColumn("known", F.lit(True))
    if domain_vectors is not None:
        side = lambda space, key: domain_vectors.filter(c("namespace") == space).select(c("item_id").alias(key), recall.unit_vector(c("vector")).alias(f"{space}_vector"))
        people, openings = people.join(side("resumes", "resume_id"), "resume_id", "left"), openings.join(side("jobs", "job_id"), "job_id", "left")
        similarity = F.round(recall.dot(c("jobs_vector"), c("resumes_vector")), 6)
    else:
        similarity = F.lit(None).cast("double")
    none, no_int = text.strings(), F.lit(None)
    if wishes is not None:
        w = filters.normalize_filters(wishes)
        people = people.join(w.select("resume_id", c("role_categories").alias("want_roles"), c("work_modes").alias("want_modes"), c("internship_preference").alias("want_internship"), c("posted_within_days").alias("want_days"), c("min_experience_years").alias("want_min_years"), c("max_experience_years").alias("want_max_years")), "resume_id", "left")
    else:
        people = people.withColumns({"want_roles": none, "want_modes": none, "want_internship": F.lit("all"), "want_days": no_int.cast("int"), "want_min_years": no_int.cast("double"), "want_max_years": no_int.cast("double")})
    rows = pairs.join(people, "resume_id").join(openings, "job_id", "left").withColumn("owned", F.coalesce(F.map_keys("own"), none))  # a pair moves to the opening with the person's columns, as these are the fewer
    if skill_vectors is None:
        rows = K.with_skill_scores(rows)
    else:
        semantic = K.semantic_hits(pairs.select("resume_id", "job_id").join(asked, "job_id"), index, skill_vectors, cfg)
        rows = rows.drop("ask_required", "ask_optional", "ask_bonus", "own").join(K.skill_scores(K.pair_skills(pairs, asked, index, semantic)), ["resume_id", "job_id"], "left")
    gate = F.when(c("has_degree"), S.degree_gate(c("degree"), c("job_degree"))).otherwise(1.0)
    rows = filters.with_filter_reason(rows.withColumns({"gate": gate, "aligned": filters.directional_alignment(c("resume_roles"), c("roles"), c("resume_signals"), c("job_signals"))}), cfg)
    rows = rows.withColumn("status", F.when(c("known").isNull(), "job_missing").when(c("filter_reason") == "passed", "matched").otherwise("filtered"))
    remote = F.array_contains("modes", "remote")
    rows = rows.withColumns(
        {
            "band": facets.experience_band(c("is_internship"), c("searched"), c("min_years"), c("max_years")), "skill0": K.skill_match(c("required"), c("optional"), c("bonus"), cfg), "transition": S.transition_score(c("targets"), c("owned"), c("resume_roles")),
            "alignment": S.title_alignment(c("title_needed"), F.size(F.array_intersect("title_skills", "owned"))), "experience": experience_match(cfg), "location": S.location_score(remote, c("wanted"), c("places")),
            "salary": S.salary_score(c("has_salary"), c("salary_min"), c("salary_max"), c("want_min"), c("want_max")), "domain": S.domain_score(S.domain_overlap(c("job_terms"), c("terms"), c("job_text")), similarity),
        }
    )
    has_prefer, has_required, has_welcome = F.size("prefer_ranks") > 0, F.size("required_majors") > 0, F.size("preferred_majors") > 0
    education = S.education_score(c("gate"), c("has_degree"), S.preferred_degree(c("degree"), c("prefer_ranks")), has_prefer, S.major_score(c("majors"), c("required_majors"), True), has_required, S.major_score(c("majors"), c("preferred_majors"), False), has_welcome, cfg)
    rows = rows.withColumns({"skill": S.adjusted_skill_match(c("skill0"), c("alignment"), c("transition")), "education": education, "level_fit": S.level_fit(c("years"), c("band.low"), c("band.high"), c("band.tag"))})
    has_education = c("has_degree") | has_prefer | has_required | has_welcome
    rows = rows.withColumn("base_total", S.base_total(c("vector"), c("skill"), c("experience"), c("education"), has_education, c("domain"), c("location"), c("salary"), c("has_salary"), cfg))
    penalties = [
        S.hard_skill_penalty(c("alignment"), c("transition"), c("primary"), c("required"), cfg), S.specialized_penalty(c("job_text"), c("domain"), c("alignment"), c("transition"), cfg), S.level_penalty(c("level_fit"), c("band.tag")),
        S.underpay_penalty(c("has_salary"), c("salary_max"), c("want_min"), remote, c("location")), S.lead_penalty(c("title"), c("alignment"), c("transition"), c("location"), c("salary")),
    ]
    total = S.capped_total(S.penalised(c("base_total"), penalties), c("skill"), F.coalesce("required", F.lit(0.5)), c("alignment"), c("transition"), c("roles"), c("job_text"))
    rows = rows.withColumn("total", text.r4(total))
    return rows.withColumns({"penalty_multiplier": S.multiplier(c("total"), c("base_total")), "tier": S.tier(c("has_salary"), c("salary_min"), c("salary_max"), c("want_min"), c("want_max"), cfg)})


def recommend(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame, wishes: DataFrame | None, as_of: Column, k: int, cfg: MatchConfig = DEFAULT, skill_vectors: DataFrame | None = None, domain_vectors: DataFrame | None = None) -> DataFrame:
    """The k diversified best openings of each person, in order, with their reasons."""
    rows = ranking.rank_total(score_pairs(pairs, jobs, resumes, wishes, as_of, cfg, skill_vectors, domain_vectors).filter("status = 'matched'"))
    c = F.col
    rows = rows.withColumns({"template": text.template_signature(c("company"), c("title"), F.coalesce("job_summary", F.lit(""))), "generic": ranking.generic_penalty(c("job_text"))})
    chosen = ranking.diversify(rows.select("resume_id", "job_id", "total", "rank", F.lower(F.trim("company")).alias("company"), F.lower(F.trim("title")).alias("title"), "template", "generic"), k)
    reason = S.reasoning(c("skill"), c("experience"), c("education"), c("salary"), c("matched"), c("missing"))
    return chosen.select("resume_id", "position", "job_id").join(rows.withColumn("reasoning", reason), ["resume_id", "job_id"])


def trace(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame, wishes: DataFrame | None, as_of: Column, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """Every recalled candidate with what was decided and why, from the same scores as ``recommend``."""
    return score_pairs(pairs, jobs, resumes, wishes, as_of, cfg).select("resume_id", "job_id", "recall_rank", "status", "filter_reason", "base_total", "penalty_multiplier", "total", "tier")

