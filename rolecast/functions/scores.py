"""Scores and penalties of one (person, opening) pair, each a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, MatchConfig
from .dictionaries import BACKEND_TARGETS, BACHELOR, BRIDGES, CLOSE_CITIES, CITY_REGIONS, DEGREE_RANK, FRONTEND_TARGETS, LEAD_KEYWORDS, LEVEL_RANK, SPECIALIZED_KEYWORDS
from .text import contains_any, r4, strings, strip


def weighted(parts: list[tuple[Column, Column | float]], default: float = 1.0) -> Column:
    """Mean of the scores by weight; parts whose weight isn't above 0 don't count."""
    weight = [w if isinstance(w, Column) else F.lit(float(w)) for _, w in parts]
    on = [F.when(w > 0, w).otherwise(0.0) for w in weight]
    total = sum(on[1:], on[0])
    each = [F.when(w > 0, s * w).otherwise(0.0) for (s, _), w in zip(parts, weight)]
    return F.when(total > 0, F.try_divide(sum(each[1:], each[0]), total)).otherwise(default)


def ratio(actual: Column, target: Column, unknown: float = 0.65) -> Column:
    return F.when(target <= 0, 1.0).when(actual.isNull(), unknown).otherwise(F.greatest(F.lit(0.0), F.least(F.try_divide(actual, target), F.lit(1.0))))


def rank_of(c: Column, ranks: dict[str, int]) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(strip(c))), F.lit(0))


def level_rank(c: Column) -> Column:
    return rank_of(c, LEVEL_RANK)


def degree_rank(c: Column) -> Column:
    return rank_of(c, DEGREE_RANK)


def level_score(candidate: Column, target: Column) -> Column:
    return F.when(target == 0, 1.0).when(F.coalesce(candidate, F.lit(0)) == 0, 0.65).otherwise(F.least(F.try_divide(candidate, target), F.lit(1.0)))


def skill_score(base: Column, confidence: Column, candidate_level: Column, target_level: Column, candidate_years: Column, min_years: Column) -> Column:
    """A required skill: mean of the match, its level if one is asked, its years if any are; 0 without a candidate."""
    hit = F.least(base, F.coalesce(confidence, F.lit(1.0)))
    level = F.when(target_level > 0, level_score(candidate_level, target_level))
    years = F.when(min_years.isNotNull(), ratio(candidate_years, min_years))
    n = 1 + F.when(level.isNotNull(), 1).otherwise(0) + F.when(years.isNotNull(), 1).otherwise(0)
    return F.when(base.isNull() | (base <= 0), 0.0).otherwise((hit + F.coalesce(level, F.lit(0.0)) + F.coalesce(years, F.lit(0.0))) / n)


def semantic_score(similarity: Column, cfg: MatchConfig = DEFAULT) -> Column:
    value = cfg.semantic_base + (similarity - cfg.semantic_min) * cfg.semantic_scale
    return F.when(similarity >= cfg.semantic_min, F.greatest(F.lit(cfg.semantic_base), F.least(value, F.lit(cfg.semantic_max))))


def adjusted_skill_match(match: Column, alignment: Column, transition: Column) -> Column:
    """The skill match bent by how far the title's own skills are there."""
    return F.when(alignment == 0, F.greatest(F.least(match * 0.25, F.lit(0.10)), r4(transition * 0.6))).when(alignment < 0.5, r4(match * (0.5 + alignment))).otherwise(match)


def term_hit(term: Column, terms: Column, raw_text: Column, exact: bool = True) -> Column:
    """1 a known term, .85 within the text, .7 within a term or around one, else 0."""
    return clean_term_hit(clean_term(term), terms, raw_text, exact)


def clean_term(term: Column) -> Column:
    return F.lower(strip(term))


def clean_term_hit(t: Column, terms: Column, raw_text: Column, exact: bool = True) -> Column:
    """``term_hit`` of a term that ``clean_term`` made: once, where many rows are asked about it."""
    part = F.exists(terms, lambda x: x.contains(t) | t.contains(x))
    out = F.when(F.coalesce(t, F.lit("")) == "", 0.0).when(F.array_contains(terms, t), 1.0)
    return (out.when(raw_text.contains(t), 0.85) if exact else out).when(part, 0.7).otherwise(0.0)


def experience_score(content: Column, years: Column, min_years: Column) -> Column:
    """An experience item: its content, three to one with the years if any are asked; no content is 0."""
    both = content * 0.75 + ratio(years, min_years, 0.7) * 0.25
    return F.when(content == 0, 0.0).when(min_years.isNotNull(), both).otherwise(content)


def degree_gate(candidate: Column, target: Column) -> Column:
    """Ranks; 0 or null is unknown."""
    c, t = F.coalesce(candidate, F.lit(0)), F.coalesce(target, F.lit(0))
    low = F.greatest(F.lit(0.2), F.try_divide(c, t) * 0.6)
    return F.when(t == 0, 1.0).when(c == 0, F.when(t <= BACHELOR, 0.55).otherwise(0.35)).when(c < t, low).when(c == t, 0.85).otherwise(0.88)


def preferred_degree(candidate: Column, targets: Column) -> Column:
    """``targets``: ranks of the degrees that are welcome."""
    known = F.filter(targets, lambda t: t > 0)
    one = F.transform(known, lambda t: F.when(candidate == t, 0.8).when(candidate > t, 0.84).otherwise(F.greatest(F.lit(0.3), F.try_divide(candidate, t) * 0.65)))
    return F.when(F.coalesce(candidate, F.lit(0)) == 0, 0.55).when(F.size(known) == 0, 1.0).otherwise(F.array_max(one))


def major_score(candidate: Column, targets: Column, strict: bool) -> Column:
    """First target that is one of the candidate's fields (.85) or a part of one or around one (.72)."""
    own = F.transform(candidate, F.lower)
    aims = F.filter(F.transform(targets, lambda t: F.lower(strip(t))), lambda t: t != "")
    one = F.transform(aims, lambda t: F.when(F.array_contains(own, t), 0.85).when(F.exists(own, lambda m: m.contains(t) | t.contains(m)), 0.72))
    hit = F.filter(one, lambda x: x.isNotNull())
    return F.when(F.size(own) <= 0, 0.4 if strict else 0.55).when(F.size(hit) > 0, F.element_at(hit, 1)).otherwise(0.0 if strict else 0.45)


def education_score(gate: Column, has_min: Column, preferred: Column, has_preferred: Column, required: Column, has_required: Column, welcome: Column, has_welcome: Column, cfg: MatchConfig = DEFAULT) -> Column:
    on = lambda cond, w: F.when(cond, w).otherwise(0.0)
    return weighted([(gate, on(has_min, cfg.min_degree_weight)), (preferred, on(has_preferred, cfg.prefer_degree_weight)), (required, on(has_required, cfg.required_major_weight)), (welcome, on(has_welcome, cfg.preferred_major_weight))])


def expected_salary(explicit_min: Column, explicit_max: Column, inferred_min: Column, inferred_max: Column) -> Column:
    """struct(min, max): what was said, if both ends were, else what was inferred."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    said = (zero(explicit_min) > 0) & (zero(explicit_max) > 0)
    guess = ~said & (zero(inferred_min) > 0) & (zero(inferred_max) > 0)
    return F.struct(F.when(guess, inferred_min).otherwise(zero(explicit_min)).alias("min"), F.when(guess, inferred_max).otherwise(zero(explicit_max)).alias("max"))


def salary_score(has_reference: Column, job_min: Column, job_max: Column, want_min: Column, want_max: Column) -> Column:
    short = F.greatest(job_max, F.lit(0)) / F.greatest(want_min, F.lit(1))
    over = job_min / F.greatest(want_max, F.lit(1))
    overlap = F.greatest(F.lit(0), F.least(want_max, job_max) - F.greatest(want_min, job_min)) / F.greatest(want_max - want_min, F.lit(1))
    return (
        F.when(~has_reference | (want_min <= 0) | (want_max <= 0), 1.0)
        .when(job_max < want_min, r4(F.greatest(F.lit(0.02), F.least(short, F.lit(1.0)) * F.least(short, F.lit(1.0)) * 0.18)))
        .when(job_min > want_max, F.when(over <= 1.5, 0.92).when(over <= 2.0, 0.86).otherwise(0.8))
        .otherwise(r4(F.least(F.lit(1.0), 0.72 + overlap * 0.20 + F.when(job_max >= want_max, 0.08).otherwise(0.0))))
    )


def location_score(remote: Column, wanted: Column, places: Column) -> Column:
    """Sets of cities; 1 remote or shared, .55 close, .35 one region, .1 far, .5 unknown."""
    both = lambda a, b: (F.array_contains(wanted, a) & F.array_contains(places, b)) | (F.array_contains(wanted, b) & F.array_contains(places, a))
    close = F.lit(False)
    for a, b in CLOSE_CITIES:
        close = close | both(a, b)
    region = F.lit(False)
    for cities in CITY_REGIONS:
        region = region | (F.arrays_overlap(wanted, strings(*cities)) & F.arrays_overlap(places, strings(*cities)))
    return (
        F.when(remote, 1.0).when((F.size(wanted) <= 0) | (F.size(places) <= 0), 0.5).when(F.arrays_overlap(wanted, places), 1.0).when(close, 0.55).when(region, 0.35).otherwise(0.10)
    )


def domain_overlap(job_terms: Column, candidate_terms: Column, job_text: Column) -> Column:
    exact = F.size(F.array_intersect(job_terms, candidate_terms))
    hits = F.size(F.filter(candidate_terms, lambda t: (F.length(t) >= 2) & job_text.contains(t)))
    return (
        F.when((F.size(candidate_terms) <= 0) | (F.size(job_terms) <= 0), 0.0)
        .when(exact > 0, F.least(F.try_divide(exact, F.least(F.size(job_terms), F.lit(4))), F.lit(1.0)))
        .otherwise(F.least(F.try_divide(hits, F.least(F.size(candidate_terms), F.lit(4))) * 0.8, F.lit(0.8)))
    )


def domain_score(overlap: Column, similarity: Column) -> Column:
    """Shared terms against the cosine of the domain texts; no shared term and no vector is .5."""
    cosine = F.greatest(F.lit(0.0), F.coalesce(similarity, F.lit(0.0)))
    return F.when(overlap == 0, F.greatest(cosine, F.lit(0.5))).otherwise(F.greatest(overlap, cosine))


def level_fit(years: Column, low: Column, high: Column, tag: Column) -> Column:
    y = F.coalesce(years, F.lit(0)).cast("double")
    lo = F.coalesce(low, F.lit(0.0))
    hi = F.coalesce(high, lo + 4.0)
    over = y - hi
    steps = lambda x, *pairs, last: _ladder(x, pairs, last)
    return (
        F.when(y <= 0, F.when(tag.isin("internship", "campus", "entry"), 0.55).otherwise(0.70))
        .when(low.isNull() & high.isNull(), 0.75)
        .when(tag == "internship", steps(y, (1.0, 1.0), (2.0, 0.72), (3.0, 0.45), last=0.08))
        .when(tag == "campus", steps(y, (2.0, 1.0), (3.0, 0.65), (5.0, 0.35), last=0.12))
        .when((y >= lo) & (y <= hi), 1.0)
        .when(y < lo, F.greatest(F.lit(0.18), F.least(y / F.greatest(lo, F.lit(1.0)), F.lit(1.0)) * 0.92))
        .when(tag == "entry", F.when(over >= 5, 0.18).when(over >= 3, 0.32).when(over >= 1.5, 0.55).otherwise(0.75))
        .when(tag == "senior", steps(over, (2.0, 0.92), (4.0, 0.82), last=0.72))
        .otherwise(steps(over, (2.0, 0.88), (4.0, 0.74), (6.0, 0.62), last=0.50))
    )


def _ladder(x: Column, pairs, last: float) -> Column:
    out = None
    for limit, value in pairs:
        out = F.when(x <= limit, value) if out is None else out.when(x <= limit, value)
    return out.otherwise(last)


def title_alignment(needed: Column, matched: Column) -> Column:
    """Counts of the title's skills, and of those that are there."""
    return F.when(F.coalesce(needed, F.lit(0)) == 0, 1.0).otherwise(F.try_divide(matched, needed))


def transition_score(targets: Column, owned: Column, roles: Column) -> Column:
    """How near the owned skills are to the primary ones: 1 if one is owned, else the best bridge or role floor."""
    best = F.lit(0.0)
    for target, sources in BRIDGES.items():
        bridge = F.greatest(F.lit(0.0), *[F.when(F.array_contains(owned, s), w).otherwise(0.0) for s, w in sources.items()])
        if target in BACKEND_TARGETS:
            bridge = F.greatest(bridge, F.when(F.arrays_overlap(roles, strings("backend_engineer", "fullstack_engineer")), 0.38).otherwise(0.0))
        if target in FRONTEND_TARGETS:
            bridge = F.greatest(bridge, F.when(F.arrays_overlap(roles, strings("frontend_engineer", "fullstack_engineer", "mobile_engineer")), 0.42).otherwise(0.0))
        best = F.greatest(best, F.when(F.array_contains(targets, target), bridge).otherwise(0.0))
    return F.when(F.size(targets) <= 0, 0.0).when(F.arrays_overlap(targets, owned), 1.0).otherwise(best)


def base_total(vector: Column, skill: Column, experience: Column, education: Column, has_education: Column, domain: Column, location: Column, salary: Column, has_salary: Column, cfg: MatchConfig = DEFAULT) -> Column:
    on = lambda cond, w: F.when(cond, w).otherwise(0.0)
    parts = [(vector, cfg.weight_vector), (skill, cfg.weight_skill), (experience, cfg.weight_experience), (education, on(has_education, cfg.weight_education)), (domain, cfg.weight_domain), (location, cfg.weight_location), (salary, on(has_salary, cfg.weight_salary))]
    return r4(weighted(parts))


def _effective(alignment: Column, transition: Column) -> Column:
    return F.greatest(alignment, F.least(transition * 0.85, F.lit(0.75)))


def hard_skill_penalty(alignment: Column, transition: Column, primary: Column, required: Column, cfg: MatchConfig = DEFAULT) -> Column:
    """``primary``: mean of the first two required skills, ``required``: of all; null without any."""
    title = r4(cfg.title_floor + (1.0 - cfg.title_floor) * _effective(alignment, transition))
    return title * F.when(primary < cfg.primary_below, cfg.primary_penalty).otherwise(1.0) * F.when(required < cfg.required_below, cfg.required_penalty).otherwise(1.0)


def specialized_penalty(text: Column, domain: Column, alignment: Column, transition: Column, cfg: MatchConfig = DEFAULT) -> Column:
    e = _effective(alignment, transition)
    return (
        F.when(~contains_any(text, SPECIALIZED_KEYWORDS), 1.0).when((e >= 0.65) & (domain >= 0.55), 1.0).when((e >= 0.50) & (domain >= 0.45), 0.92)
        .when((transition >= 0.45) & (domain >= 0.35), 0.88).when((e > 0) & (domain >= 0.50), 0.85).otherwise(cfg.specialized_penalty)
    )


def level_penalty(fit: Column, tag: Column) -> Column:
    return (
        F.when(fit >= 0.85, 1.0)
        .when(tag.isin("internship", "campus"), F.when(fit >= 0.55, 0.72).when(fit >= 0.35, 0.48).otherwise(0.22))
        .when(tag == "entry", F.when(fit >= 0.70, 0.90).when(fit >= 0.55, 0.72).when(fit >= 0.35, 0.58).otherwise(0.44))
        .otherwise(F.when(fit >= 0.65, 0.88).when(fit >= 0.45, 0.74).otherwise(0.60))
    )


def underpay_penalty(has_reference: Column, job_max: Column, want_min: Column, remote: Column, location: Column) -> Column:
    r = job_max / F.greatest(want_min, F.lit(1))
    return (
        F.when(~has_reference | (want_min <= 0) | (r >= 1.0) | remote, 1.0).when((r < 0.8) & (location < 1.0), 0.72).when(r < 0.8, 0.86).when((r < 0.9) & (location < 0.7), 0.88).otherwise(1.0)
    )


def lead_penalty(title: Column, alignment: Column, transition: Column, location: Column, salary: Column) -> Column:
    return (
        F.when(~contains_any(F.lower(title), LEAD_KEYWORDS) | (alignment >= 1.0), 1.0)
        .when((transition >= 0.75) & (location >= 1.0) & (salary >= 0.9), 1.0).when((location < 1.0) & (salary < 0.9), 0.72).when((location < 0.7) | (salary < 0.8), 0.82).otherwise(0.9)
    )


def capped_total(total: Column, skill: Column, required: Column, alignment: Column, transition: Column, job_roles: Column, text: Column) -> Column:
    """A low ceiling where neither the title's skills nor a bridge to them are there."""
    top = F.when(F.arrays_overlap(job_roles, strings("algorithm_engineer", "data_engineer")), 0.08).when(contains_any(text, SPECIALIZED_KEYWORDS), 0.10).otherwise(0.12)
    free = (alignment > 0) | (transition >= 0.35) | (required > 0.15) | (skill > 0.18)
    return F.when(free, total).otherwise(F.least(total, top))


def penalised(base: Column, penalties: list[Column]) -> Column:
    """The base times each penalty in turn, rounded to four digits after each."""
    out = base
    for p in penalties:
        out = r4(out * p)
    return out


def multiplier(total: Column, base: Column) -> Column:
    return F.when(base > 0, r4(F.try_divide(total, base))).otherwise(1.0)


def tier(has_reference: Column, job_min: Column, job_max: Column, want_min: Column, want_max: Column, cfg: MatchConfig = DEFAULT) -> Column:
    """reach, match or safety by the ratio of the midpoints of pay."""
    want, pay = (want_min + want_max) / 2, (job_min + job_max) / 2
    known = has_reference & (want > 0) & (pay > 0)
    return F.when(known & (F.try_divide(pay, want) >= cfg.tier_reach), "reach").when(known & (F.try_divide(pay, want) <= cfg.tier_safety), "safety").otherwise("match")


def reasoning(skill: Column, experience: Column, education: Column, salary: Column, matched: Column, missing: Column) -> Column:
    strengths = F.array_compact(F.array(F.when(skill >= 0.8, "strong skill alignment"), F.when(experience >= 0.75, "experience matches well"), F.when(education >= 0.8, "education fits"), F.when(salary >= 0.85, "salary expectations overlap")))
    some = lambda items, sep, other: F.coalesce(F.nullif(F.array_join(items, sep), F.lit("")), F.lit(other))
    return F.concat(
        some(F.slice(strengths, 1, 2), "; ", "overall structured fit is reasonable"), F.lit("; matched "), some(F.slice(matched, 1, 3), " / ", "core skills"), F.lit("; still missing "), some(F.slice(missing, 1, 2), " / ", "no obvious gaps"), F.lit("."),
    )
