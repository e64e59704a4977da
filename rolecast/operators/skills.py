"""Skill tables: what a person can do, what an opening asks for, and how the two meet, all as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig
from ..functions import scores as S
from ..functions.dictionaries import FRONTEND_FRAMEWORKS, FRONTEND_SIGNALS, GIT_PLATFORMS
from ..functions.skills import expand_skill, extract_skills, normalize_skill
from ..functions.text import clean_text, dedupe_ci, is_placeholder, let, strip
from ..storage import staged
from .recall import similar_pairs


def expanded(rows: DataFrame) -> DataFrame:
    """(resume_id, skill, level_rank, years, confidence, pos) with compound names split and canonical ``norm``."""
    each = rows.filter(~is_placeholder(F.col("skill"))).select("*", F.posexplode(expand_skill(F.col("skill"))).alias("part", "name"))
    return each.withColumn("norm", normalize_skill(F.col("name"))).filter("norm <> ''")


def skill_index(rows: DataFrame) -> DataFrame:
    """One row a (resume_id, norm): first name, highest level, most years, best confidence; then what these imply.

    A frontend framework, or two frontend signals, bring html, css and javascript; a code host brings git.
    """
    pos = F.struct("pos", "part", "name") if "part" in rows.columns else F.struct(F.col("norm").alias("name"))
    base = rows.groupBy("resume_id", "norm").agg(
        F.min(pos)["name"].alias("name"), F.coalesce(F.max("level_rank"), F.lit(0)).cast("double").alias("level_rank"), F.max("years").alias("years"), F.coalesce(F.max("confidence"), F.lit(1.0)).alias("confidence")
    )
    has = lambda names: F.max(F.col("norm").isin(*names))
    own = F.struct(F.lit(0).alias("given"), "norm", "name", "level_rank", "years", "confidence")
    per = base.groupBy("resume_id").agg(F.collect_list(own).alias("own"), has(FRONTEND_FRAMEWORKS).alias("framework"), F.count_if(F.col("norm").isin(*FRONTEND_SIGNALS)).alias("signals"), has(["git"]).alias("git"), has(GIT_PLATFORMS).alias("host"))
    no_years = F.lit(None).cast(base.schema["years"].dataType)
    added = lambda n, confidence: F.struct(F.lit(1).alias("given"), F.lit(n).alias("norm"), F.lit(n).alias("name"), F.lit(0.0).alias("level_rank"), no_years.alias("years"), F.lit(confidence).alias("confidence"))
    front = F.when(F.col("framework") | (F.col("signals") >= 2), F.array(*[added(n, 0.78) for n in ("html", "css", "javascript")]))
    git = F.when(F.col("host") & ~F.col("git"), F.array(added("git", 0.84)))
    both = per.select("resume_id", F.explode(F.flatten(F.array_compact(F.array("own", front, git)))).alias("x")).select("resume_id", "x.*")  # so rows are read once, and stay dealt by person
    return both.groupBy("resume_id", "norm").agg(F.min(F.struct("given", "name"))["name"].alias("name"), F.max("level_rank").alias("level_rank"), F.max("years").alias("years"), F.max("confidence").alias("confidence"))


def resume_skill_rows(resumes: DataFrame) -> DataFrame:
    """All mentions of skills in nested resumes, in order of weight of evidence: skills, work, projects, tech tags, text."""
    c = F.col
    row = lambda a, level, years, conf, src: F.transform(a, lambda x, i: F.struct((F.lit(src) * 100000 + i).alias("pos"), (x["name"] if src in (0, 3) else x).alias("skill"), level(x).alias("level_rank"), years(x).alias("years"), F.lit(conf).alias("confidence")))
    none = lambda x: F.lit(None).cast("int")
    nod = lambda x: F.lit(None).cast("double")
    tech = lambda items: F.flatten(F.transform(items, lambda w: F.coalesce(w["tech_stack"], F.array().cast("array<string>"))))
    text = F.concat_ws(
        "\n", c("basic_info.summary"), c("raw_text"),
        F.flatten(F.transform(c("work_experiences"), lambda w: F.concat(F.coalesce(w["responsibilities"], F.array()), F.coalesce(w["achievements"], F.array()), F.array(F.coalesce(w["title"], F.lit("")))))),
        F.flatten(F.transform(c("projects"), lambda p: F.concat(F.array(F.coalesce(p["name"], F.lit("")), F.coalesce(p["role"], F.lit("")), F.coalesce(p["description"], F.lit(""))), F.coalesce(p["responsibilities"], F.array()), F.coalesce(p["achievements"], F.array())))),
    )
    all_rows = F.concat(*[
        F.coalesce(x, F.array())
        for x in (
            row(c("skills"), lambda x: S.level_rank(x["level"]), lambda x: x["years"].cast("double"), 1.0, 0), row(tech(c("work_experiences")), none, nod, 1.0, 1), row(tech(c("projects")), none, nod, 1.0, 2),
            row(F.filter(c("tags"), lambda t: F.lower(t["category"]) == "tech"), none, nod, 1.0, 3), row(extract_skills(text), none, nod, 0.92, 4),
        )
    ])
    return resumes.select(F.col("id").alias("resume_id"), F.explode(all_rows).alias("r")).select("resume_id", "r.*")


def candidate_skill_index(resumes: DataFrame) -> DataFrame:
    return skill_index(expanded(resume_skill_rows(resumes)))


def terms(values) -> object:
    """The distinct lower-case terms of an array, stand-ins left out."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(strip(clean_text(x)))), lambda x: x.isNotNull() & (x != "")))


def topics(keywords, experience_names, tags) -> object:
    return dedupe_ci(F.concat(keywords, experience_names, tags))


def semantic_hits(asked: DataFrame, owned: DataFrame, vectors: DataFrame, cfg: MatchConfig = DEFAULT) -> DataFrame:
    """(resume_id, norm, base, owned_norm): for asked skills a person lacks, the nearest skill that they have.

    Terms are compared once, however many people share them: a similarity join of the terms that someone lacks with the terms that someone has
    gives the few pairs that are near enough, and only those meet people, rather than all that a person lacks with all that they have. Terms
    without a vector match nothing. Ties go to the name first in order.
    """
    lacking = staged(asked.select("resume_id", "norm").distinct().join(owned.select("resume_id", "norm"), ["resume_id", "norm"], "left_anti"))
    v = vectors.select("norm", "vector")
    lacked = lacking.select("norm").distinct().join(v, "norm")
    had = owned.select("norm").distinct().join(v, "norm").select(F.col("norm").alias("owned_norm"), "vector")
    near = similar_pairs(lacked, had, cfg.semantic_min, "norm", "owned_norm").withColumnRenamed("score", "sim")
    best = W.partitionBy("resume_id", "norm").orderBy(F.desc("sim"), "owned_norm")
    known = owned.select("resume_id", F.col("norm").alias("owned_norm")).distinct()
    found = lacking.join(near, "norm").join(known, ["resume_id", "owned_norm"]).withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    return found.select("resume_id", "norm", S.semantic_score(F.col("sim"), cfg).alias("base"), "owned_norm")


def pair_skills(pairs: DataFrame, job_skills: DataFrame, index: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Each asked skill of each pair with its score: exact by canonical name, else the semantic hit if one is given.

    job_skills: (job_id, kind, group_pos, pos, skill, norm, level_rank, min_years, weight, min_required).
    """
    owned = index.select("resume_id", "norm", F.col("level_rank").alias("own_level"), F.col("years").alias("own_years"), "confidence")
    rows = pairs.select("resume_id", "job_id").join(job_skills, "job_id").join(owned.withColumn("exact", F.lit(1.0)), ["resume_id", "norm"], "left")
    if semantic is not None:
        other = semantic.join(owned.select("resume_id", F.col("norm").alias("owned_norm"), F.col("own_level").alias("s_level"), F.col("own_years").alias("s_years"), F.col("confidence").alias("s_conf")), ["resume_id", "owned_norm"]).drop("owned_norm")
        rows = rows.join(other, ["resume_id", "norm"], "left")
        for mine, its in (("exact", "base"), ("own_level", "s_level"), ("own_years", "s_years"), ("confidence", "s_conf")):
            rows = rows.withColumn(mine, F.when(F.col("exact").isNull() & F.col("base").isNotNull(), F.col(its)).otherwise(F.col(mine)) if mine != "exact" else F.col(mine))
        rows = rows.withColumn("exact", F.coalesce("exact", "base")).drop("base", "s_level", "s_years", "s_conf")
    c = F.col
    required = S.skill_score(c("exact"), c("confidence"), c("own_level"), c("level_rank"), c("own_years").cast("double"), c("min_years").cast("double"))
    optional = S.skill_score(c("exact"), c("confidence"), c("own_level"), c("level_rank"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    bonus = F.coalesce(F.least(c("exact"), c("confidence")), F.lit(0.0))
    return rows.withColumn("score", F.when(c("kind") == "required", required).when(c("kind") == "optional", optional).otherwise(bonus)).withColumn("hit", c("exact").isNotNull())


def skill_scores(rows: DataFrame) -> DataFrame:
    """(resume_id, job_id, required, primary, optional, bonus, n_required, matched, missing) from ``pair_skills``.

    An optional group is its best ``min_required`` skills, padded with 0. Matched and missing are the required names in order.
    """
    key = ["resume_id", "job_id"]
    n = F.greatest(F.coalesce("min_required", F.lit(1)), F.lit(1))
    asked = F.array_sort(F.collect_list(F.when(F.col("kind") == "optional", F.struct("group_pos", (-F.col("score")).alias("order"), "pos", "score", n.alias("n")))))
    names = lambda hit: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "required") & (F.col("hit") == hit), F.struct("pos", "skill")))), lambda x: x["skill"])
    weight = F.when(F.coalesce("weight", F.lit(0)) == 0, 1.0).otherwise(F.col("weight").cast("double"))
    out = rows.groupBy(*key).agg(
        F.avg(F.when(F.col("kind") == "required", F.col("score"))).alias("required"), F.avg(F.when((F.col("kind") == "required") & (F.col("pos") <= 2), F.col("score"))).alias("primary"),
        (F.sum(F.when(F.col("kind") == "bonus", F.col("score") * weight)) / F.sum(F.when(F.col("kind") == "bonus", weight))).alias("bonus"), F.count_if(F.col("kind") == "required").alias("n_required"),
        names(True).alias("matched"), names(False).alias("missing"), asked.alias("asked"),
    )
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda a, x: a + x)

    def group(g):
        best = F.filter(F.filter("asked", lambda x: x["group_pos"] == g), lambda x, i: i < x["n"])
        return F.try_divide(total(F.transform(best, lambda x: x["score"])), F.array_max(F.transform(best, lambda x: x["n"])))

    groups = F.transform(F.array_distinct(F.transform("asked", lambda x: x["group_pos"])), group)
    return out.withColumn("optional", F.when(F.size("asked") > 0, F.try_divide(total(groups), F.size(groups)))).drop("asked")


def asked_arrays(job_skills: DataFrame) -> DataFrame:
    """(job_id, ask_required, ask_optional, ask_bonus): all that an opening asks for in one row, columns as for ``pair_skills``."""
    of = lambda kind, *fields: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*fields)))).alias(f"ask_{kind}")
    return job_skills.groupBy("job_id").agg(of("required", "pos", "skill", "norm", "level_rank", "min_years"), of("optional", "group_pos", "pos", "norm", "level_rank", "min_required"), of("bonus", "pos", "norm", "weight"))


def owned_maps(index: DataFrame) -> DataFrame:
    """(resume_id, own): all that a person can do in one row, level, years and confidence by canonical name."""
    value = F.struct(F.col("level_rank").alias("level"), F.col("years").cast("double").alias("years"), "confidence")
    return index.filter(F.col("norm").isNotNull()).groupBy("resume_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("norm"), value))).alias("own"))


def with_skill_scores(rows: DataFrame) -> DataFrame:
    """rows of pairs, with ``asked_arrays`` and ``owned_maps`` of their sides, and the columns of ``skill_scores`` in place of those.

    A pair stays one row: its asked skills are looked up in the person's map, so none of them is shuffled. Exact names only.
    """
    c, none = F.col, F.lit(None).cast("double")
    exact = lambda o: F.when(o.isNotNull(), F.lit(1.0))
    each = lambda name, body: F.transform(F.transform(name, lambda x: F.struct(x.alias("x"), F.try_element_at(c("own"), x["norm"]).alias("o"))), lambda y: body(y["x"], y["o"]))
    score = lambda x, o, own, least: S.skill_score(exact(o), o["confidence"], o["level"], x["level_rank"], own, least).alias("score")
    n = lambda x: F.greatest(F.coalesce(x["min_required"], F.lit(1)), F.lit(1)).alias("n")
    required = each("ask_required", lambda x, o: F.struct(x["pos"].alias("pos"), x["skill"].alias("skill"), o.isNotNull().alias("hit"), score(x, o, o["years"], x["min_years"].cast("double"))))
    optional = each("ask_optional", lambda x, o: F.struct(x["group_pos"].alias("group_pos"), x["pos"].alias("pos"), score(x, o, none, none), n(x)))
    weight = lambda x: F.when(F.coalesce(x["weight"], F.lit(0)) == 0, 1.0).otherwise(x["weight"].cast("double"))
    bonus = each("ask_bonus", lambda x, o: F.struct(F.coalesce(F.least(exact(o), o["confidence"]), F.lit(0.0)).alias("score"), weight(x).alias("weight")))
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))
    mean = lambda items: F.when(F.size(items) > 0, F.try_divide(total(items, lambda x: x["score"]), F.size(items)))
    names = lambda items, hit: F.transform(F.filter(items, lambda x: x["hit"] == hit), lambda x: x["skill"])

    def of_required(a):
        return F.struct(mean(a).alias("required"), mean(F.filter(a, lambda x: x["pos"] <= 2)).alias("primary"), F.size(a).cast("long").alias("n_required"), names(a, True).alias("matched"), names(a, False).alias("missing"))

    def of_optional(a):
        ordered = F.array_sort(F.transform(a, lambda x: F.struct(x["group_pos"].alias("group_pos"), (-x["score"]).alias("order"), x["pos"].alias("pos"), x["n"].alias("n"))))

        def group(items, g):
            best = F.filter(F.filter(items, lambda x: x["group_pos"] == g), lambda x, i: i < x["n"])
            return let(best, lambda b: F.try_divide(total(b, lambda x: -x["order"]), F.array_max(F.transform(b, lambda x: x["n"]))))

        groups = let(ordered, lambda items: F.transform(F.array_distinct(F.transform(items, lambda x: x["group_pos"])), lambda g: group(items, g)))
        return F.when(F.size(a) > 0, let(groups, lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v))))

    of_bonus = lambda a: F.when(F.size(a) > 0, total(a, lambda x: x["score"] * x["weight"]) / total(a, lambda x: x["weight"]))
    parts = rows.withColumns({"of_required": let(required, of_required), "optional": let(optional, of_optional), "bonus": let(bonus, of_bonus)})
    out = ("required", "primary", "n_required", "matched", "missing")
    return parts.withColumns({name: c("of_required")[name] for name in out}).drop("of_required", "ask_required", "ask_optional", "ask_bonus", "own")


def skill_match(required, optional, bonus, cfg: MatchConfig = DEFAULT):
    """Mean by weight of the parts that an opening has; .5 if it asks for nothing."""
    on = lambda c, w: F.when(c.isNotNull(), w).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return S.weighted([(zero(required), on(required, cfg.skill_required)), (zero(optional), on(optional, cfg.skill_optional)), (zero(bonus), on(bonus, cfg.skill_bonus))], 0.5)
