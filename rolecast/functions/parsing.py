"""Fields read out of free text: pay, years, degrees, dates, languages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import CERTIFICATIONS, DEGREE_WORDS, EDUCATION_WORDS, HIGHLIGHT_KEYWORDS, HIGHLIGHT_MARKERS, LANGUAGE_PATTERNS, MAJOR_STOPWORDS, MIN_DEGREE_PATTERNS, OTHER_CONSTRAINT_WORDS, PREFER_DEGREE_PATTERNS, RESPONSIBILITY_MARKERS, SECTION_ENDS
from .text import bullet_items, contains_any, dedupe_ci, let, marked_items, none_of, occurrences, section_items, strings, strip

_TO = r"\s*[-~～至到]\s*"
_NUM = r"(\d+(?:\.\d+)?)"


def group(text: Column, pattern: str, i: int) -> Column:
    """A group of the first match; null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _scaled(text: Column, pattern: str, factor: float) -> list[Column]:
    return [F.bround(group(text, pattern, i).cast("double") * factor, 0).cast("int") for i in (1, 2)]


def parse_salary(text: Column, free_text: bool = False) -> Column:
    """struct(negotiable, min, max, months_min, months_max, intern_amount, intern_unit) of a pay line.

    The first rule that matches wins: 15-25k, then 8000-12000, then (postings) 1.5-2万, then 20-30万/年. In
    postings the third hides the fourth. Free text has a daily rate before all and no third rule.
    """
    t = F.coalesce(text, F.lit(""))
    months = rf"(\d{{1,2}})(?:{_TO}(\d{{1,2}}))?\s*薪"
    k = rf"{_NUM}\s*[kK千]?{_TO}{_NUM}\s*[kK千]" if not free_text else rf"{_NUM}{_TO}{_NUM}\s*[kK千]"
    rules = [(k, 1000.0), (rf"(\d{{4,6}}){_TO}(\d{{4,6}})", 1.0)]
    if not free_text:
        rules.append((rf"{_NUM}{_TO}{_NUM}\s*万", 10000.0))
    rules.append((rf"{_NUM}{_TO}{_NUM}\s*[万wW]\s*/{'' if free_text else '?'}\s*年", 10000.0 / 12))
    pairs = [_scaled(t, p, f) for p, f in rules]
    low, high = F.coalesce(*[p[0] for p in pairs]), F.coalesce(*[p[1] for p in pairs])
    daily = group(t, rf"{_NUM}{_TO}{_NUM}\s*元\s*/\s*天", 2) if free_text else none_of("string")
    amount = F.bround(daily.cast("double"), 0).cast("int")
    return F.struct(
        F.when(amount.isNull() & low.isNotNull(), False).when(t.contains("面议"), True).alias("negotiable"),
        F.when(amount.isNull(), low).alias("min"),
        F.when(amount.isNull(), high).alias("max"),
        group(t, months, 1).cast("int").alias("months_min"),
        F.coalesce(group(t, months, 2), group(t, months, 1)).cast("int").alias("months_max"),
        amount.alias("intern_amount"),
        F.when(amount.isNotNull(), "元/天").alias("intern_unit"),
    )


def parse_years(text: Column, free_text: bool = False) -> Column:
    """struct(min, max) of the years of experience asked for."""
    t = F.coalesce(text, F.lit(""))
    unit = "(?:年|years?)" if free_text else "年"
    both = rf"(?i){_NUM}{_TO}{_NUM}\s*{unit}"
    least = rf"(?i){_NUM}\s*{unit}\s*(?:以上|及以上{'|或以上' if free_text else ''}|\+|起)"
    exact = rf"(?i){_NUM}\s*{unit}经验" if free_text else rf"{_NUM}\s*年"
    a, b, c = group(t, both, 1).cast("double"), group(t, least, 1).cast("double"), group(t, exact, 1).cast("double")
    high = F.when(a.isNotNull(), group(t, both, 2).cast("double"))
    if not free_text:
        high = F.when(a.isNotNull(), high).when(b.isNull(), c)
    none = F.when(contains_any(t, ("应届", "经验不限")), 0.0) if not free_text else none_of("double")
    return F.struct(F.coalesce(a, b, c, none).alias("min"), high.alias("max"))


def norm_degree(c: Column) -> Column:
    """A degree's usual name; other words in lower case."""
    s = F.lower(strip(c))
    out = F.when(s == "", none_of("string"))
    for word, name in DEGREE_WORDS:
        if not word.isascii():
            out = out.when(s.contains(word), name)
    return out.otherwise(s)


def degree_in_text(c: Column) -> Column:
    """The highest-priority degree word in a text."""
    s = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.lit(False), none_of("string"))
    for word, name in DEGREE_WORDS:
        out = out.when(s.contains(word), name)
    return out


def compose_summary(summary: Column, description: Column, title: Column) -> Column:
    parts = F.array_distinct(F.filter(F.array(strip(summary), strip(description)), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(strip(title))


def split_title(c: Column, markers=("岗位职责", "岗位要求", "职位描述", "Job description")) -> Column:
    """struct(title, description): the text before the first marker and from it on."""
    places = F.array_compact(F.array(*[F.when(F.instr(c, m) > 1, F.instr(c, m)) for m in markers]))
    at = F.array_min(places)
    return F.struct(strip(F.when(at.isNotNull(), F.substring(c, F.lit(1), at - 1)).otherwise(c)).alias("title"), F.when(at.isNotNull(), strip(F.substring(c, at, F.length(c)))).alias("description"))


def looks_like_description(c: Column) -> Column:
    return (F.length(c) >= 80) | contains_any(c, ("岗位职责", "任职要求", "职责", "要求", "responsibilities", "requirements"))


def job_id(explicit: Column, other: Column, url: Column, text: Column) -> Column:
    tail = group(url, r"/(\d+)(?:\D*)$", 1)
    return F.coalesce(*[F.nullif(strip(x.cast("string")), F.lit("")) for x in (explicit, other)], tail, F.nullif(strip(url), F.lit("")), F.xxhash64(text).cast("string"))


def clean_raw(c: Column, most: int = 12000) -> Column:
    return F.substring(strip(F.translate(c, "\u0000﻿", "  ")), 1, most)


def parse_time(c: Column) -> Column:
    """A timestamp from ISO text or the usual date forms; text without a zone is UTC."""
    s = strip(c.cast("string"))
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy年M月d日")
    return F.coalesce(s.try_cast("timestamp"), *[F.try_to_timestamp(s, F.lit(f)) for f in forms])


def posted(as_of: Column, *candidates: Column) -> Column:
    """struct(posted_at, posted_days_ago) of the first candidate that can be read."""
    at = F.coalesce(*[parse_time(c) for c in candidates])
    return F.struct(at.alias("posted_at"), F.when(at.isNotNull(), F.greatest(F.lit(0), F.datediff(as_of, at.cast("date")))).alias("posted_days_ago"))


def month_index(c: Column, as_of: Column) -> Column:
    """year * 12 + month of YYYY.MM; 至今 is the month of as_of."""
    y, m = group(c, r"(\d{4})[.\-/年](\d{1,2})", 1).cast("int"), group(c, r"(\d{4})[.\-/年](\d{1,2})", 2).cast("int")
    now = F.year(as_of) * 12 + F.month(as_of)
    return F.when(c.contains("至今") | F.lower(c).contains("present"), now).otherwise(y * 12 + m)


def stated_years(text: Column) -> Column:
    return group(F.coalesce(text, F.lit("")), r"(\d{1,2})\s*年(?:工作)?经验", 1).cast("int")


def span_years(months: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(months / F.lit(12.0), 0).cast("int"))


def min_degree(text: Column) -> Column:
    out = F.when(F.lit(False), none_of("string"))
    for name, pattern in MIN_DEGREE_PATTERNS.items():
        out = out.when(text.rlike(f"(?i){pattern}"), name)
    return out


def preferred_degrees(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in PREFER_DEGREE_PATTERNS.items()]))


def majors(text: Column, preferred: bool) -> Column:
    """Fields of study asked for, or (preferred) welcome.

    Only what leads up to the last 专业 of a run of letters and commas is searched: a match lies within a run, and the search takes some 80 steps a letter.
    """
    letters = r"[一-龥A-Za-z/、，,\s]"
    asked = [f"(?iU)({letters}{{2,80}}?)(?:等)?{tail}" for tail in ("相关专业(?:优先|者优先)?", "专业(?:优先|者优先)")]
    runs = F.when(text.contains("专业"), F.regexp_extract_all(text, F.lit(rf"(?iU)(?<!{letters}){letters}*专业(?:优先|者优先)?"), F.lit(0))).when(text.isNotNull(), strings())

    def matches(runs: Column, pattern: str) -> Column:
        wholes = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(pattern), F.lit(0))))
        return F.transform(wholes, lambda w: F.struct(w.alias("whole"), F.regexp_extract(w, pattern, 1).alias("names")))

    found = let(runs, lambda rs: F.concat(*[matches(rs, p) for p in asked]))
    kind = F.filter(found, lambda m: m["whole"].contains("优先") if preferred else ~m["whole"].contains("优先"))
    names = F.transform(kind, lambda m: F.regexp_replace(F.regexp_replace(m["names"], ".*学历", ""), r"(?U)\d{4}届|海内外|统招|学历|及以上|或研究生|或以上|以上", ""))
    parts = F.flatten(F.transform(names, lambda m: F.split(m, r"(?U)[、,/，]\s*|\s+")))
    tokens = F.transform(parts, lambda p: strip(F.regexp_replace(F.regexp_replace(strip(p), "(相关专业|相关)$", ""), "(专业|类)$", "")))
    return dedupe_ci(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*MAJOR_STOPWORDS)))


def _language_facts(around: Column) -> dict[str, Column]:
    """Level and whether it is required, by what is said around a mention."""
    level = lambda a: F.when(contains_any(a, ("流利", "熟练", "可作为工作语言", "business")), "fluent").when(contains_any(a, ("cet-6", "cet6", "六级", "n1")), "advanced").when(contains_any(a, ("cet-4", "cet4", "四级", "n2")), "intermediate")
    return {"level": let(F.lower(around), level), "required": ~contains_any(around, ("优先", "加分"))}


def languages(text: Column) -> Column:
    """array of struct(language, level, required); the level comes from 24 characters around the first hit of the first word that occurs."""

    def shown(text: Column, name: str, hit: Column) -> Column:
        left = F.greatest(F.lit(1), hit["at"] - 24)
        around = F.substring(text, left, hit["at"] - left + hit["size"] + 24)
        return F.when(hit.isNotNull(), let(around, lambda a: F.struct(F.lit(name).alias("language"), *[v.alias(k) for k, v in _language_facts(a).items()])))

    def each(text: Column, low: Column) -> Column:
        first = lambda words: F.coalesce(*[F.when(low.contains(w), F.struct(F.instr(low, w).alias("at"), F.lit(len(w)).alias("size"))) for w in words])
        return F.array_compact(F.array(*[let(first(words), partial(shown, text, name)) for name, words in LANGUAGE_PATTERNS.items()]))

    return let(text, lambda t: let(F.lower(t), lambda low: each(t, low)))


def language_mentions(text: Column) -> Column:
    """array of struct(language, at, hit, around, level, required): every mention of a language, each with what is said around it."""
    words = {w: name for name, ws in LANGUAGE_PATTERNS.items() for w in ws}
    names = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    hits = occurrences(text, "(?i:" + "|".join(words) + ")")

    def mention(x: Column) -> Column:
        around = F.concat(x["left"], x["hit"], x["right"])
        facts = _language_facts(around)
        return F.struct(F.element_at(names, F.lower(x["hit"])).alias("language"), x["at"].alias("at"), x["hit"].alias("hit"), around.alias("around"), *[v.alias(k) for k, v in facts.items()])

    return F.transform(hits, mention)


def certifications(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(text).contains(c.lower()), F.lit(c)) for c in CERTIFICATIONS]))


def age_range(text: Column) -> Column:
    both = rf"(\d{{2}}){_TO}(\d{{2}})\s*岁"
    return F.coalesce(
        F.when(group(text, both, 1).isNotNull(), F.concat(group(text, both, 1), F.lit("-"), group(text, both, 2), F.lit("岁"))),
        F.concat(group(text, r"(\d{2})\s*岁(?:以下|以内)", 1), F.lit("岁以下")),
        F.concat(group(text, r"(\d{2})\s*岁(?:以上|及以上)", 1), F.lit("岁以上")),
    )


def other_constraints(text: Column) -> Column:
    return F.slice(F.filter(bullet_items(text), lambda x: contains_any(x, OTHER_CONSTRAINT_WORDS)), 1, 6)


def education_constraints(text: Column) -> Column:
    return F.struct(
        min_degree(text).alias("min_degree"), preferred_degrees(text).alias("prefer_degrees"), majors(text, False).alias("required_majors"), majors(text, True).alias("preferred_majors"),
        languages(text).alias("languages"), certifications(text).alias("certifications"), age_range(text).alias("age_range"), other_constraints(text).alias("other"),
    )


def description_text(raw: Column) -> Column:
    """Text of a description that may be a JSON object with requirements, infos, jobStrength and text."""
    s = strip(raw)
    parsed = F.from_json(s, "requirements string, infos string, jobStrength string, text string")
    joined = F.concat_ws("\n", parsed["requirements"], parsed["infos"], parsed["jobStrength"], parsed["text"])
    return F.when(s.startswith("{") & (joined != ""), joined).otherwise(s)


def responsibilities(text: Column) -> Column:
    """Up to eight items of the first part on the work, none without such a part."""
    return section_items(text, RESPONSIBILITY_MARKERS, SECTION_ENDS, 8)


def _highlight(c: Column) -> Column:
    """An item without heading, number and marks before it; null if nothing stays or all of it is words with strokes between."""
    s = strip(F.regexp_replace(strip(c), r"(?U)^(?:项|加分项|福利待遇|优选条件|优先条件)[?:\s-]*", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)^(?:\d+|\?+)[)?.:]\s*", ""), "^[?: ]+", "")
    s = F.regexp_replace(F.regexp_replace(s, "^[?,; ]+|[?,; ]+$", ""), "^[^A-Za-z0-9一-龥]+", "")
    return let(s, lambda x: F.when((x != "") & ~x.rlike("^[A-Za-z一-龥]+(?:/[A-Za-z一-龥]+)+$"), x))


def highlights(text: Column) -> Column:
    """Up to six items: four of each part on benefits or what is welcome; without any, sentences of the text that tell of such."""
    told = lambda x: ~contains_any(x, RESPONSIBILITY_MARKERS + EDUCATION_WORDS) & contains_any(x, HIGHLIGHT_KEYWORDS)
    parts = F.coalesce(F.flatten(marked_items(text, HIGHLIGHT_MARKERS, SECTION_ENDS, 4)), strings())
    named = F.array_compact(F.transform(parts, _highlight))
    spread = F.filter(F.array_compact(F.transform(bullet_items(text), _highlight)), told)
    return let(named, lambda n: F.slice(dedupe_ci(F.when(F.size(n) > 0, n).otherwise(spread)), 1, 6))
