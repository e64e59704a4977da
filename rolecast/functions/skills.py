"""Skill names: extraction from text, canonical forms, compound names."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import BACKEND_SIGNALS, FRONTEND_SIGNALS, MOBILE_SIGNALS, SKILL_ALIASES, SKILL_PATTERNS, TITLE_SKILL_PATTERNS
from .text import contains_any, dedupe_ci, is_placeholder, let, strings, strip

FLAGS = "(?iU)"


def alias_pairs() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, others in SKILL_ALIASES.items():
        out |= {name: name} | dict.fromkeys(others, name)
    return out


def alias_map() -> Column:
    """A constant of two nodes, folded into one when the plan is made: thousands of nodes would cost each step of planning."""
    return F.from_json(F.lit(json.dumps(alias_pairs(), ensure_ascii=False)), "map<string, string>")


def normalize_skill(c: Column) -> Column:
    key = F.lower(strip(c))
    return F.coalesce(F.try_element_at(alias_map(), key), key)


def _any_of(entries: list) -> str:
    """One pattern for all of some skills; what begins at an edge of a word looks for the edge once."""
    patterns = [p for _, ps in entries for p in ps]
    edged = [p[2:] for p in patterns if p.startswith(r"\b") and "|" not in p]
    return FLAGS + "|".join([p for p in patterns if not p.startswith(r"\b") or "|" in p] + ([rf"\b(?:{'|'.join(edged)})"] if edged else []))


def names_skill(text: Column) -> Column:
    """Whether a text holds a known skill, by one scan; null holds none."""
    return F.coalesce(text.rlike(_any_of(SKILL_PATTERNS)), F.lit(False))


def extract_skills(text: Column, group: int = 8) -> Column:
    """Known skill names in a text, in order of where they first stand (of equals, dictionary order).

    Of a skill with several patterns the first that matches counts. One scan rejects most texts, another each ``group`` of skills. The text is made once
    a row, and each pattern is a constant of its own: one that comes out of an array is compiled again for every row.
    """

    def place(t: Column, patterns: tuple) -> Column:
        *others, last = [FLAGS + p for p in patterns]
        at = F.regexp_instr(t, F.lit(last))
        for p in reversed(others):
            at = F.when(t.rlike(p), F.regexp_instr(t, F.lit(p))).otherwise(at)
        return at

    def some(t: Column, first: int) -> Column:
        entries = SKILL_PATTERNS[first : first + group]
        places = F.array(*[F.struct(place(t, ps).alias("at"), F.lit(first + i).alias("i"), F.lit(n).alias("name")) for i, (n, ps) in enumerate(entries)])
        return F.when(t.rlike(_any_of(entries)), places).otherwise(F.array().cast("array<struct<at: int, i: int, name: string>>"))

    def found(t: Column) -> Column:
        places = F.concat(*[some(t, i) for i in range(0, len(SKILL_PATTERNS), group)])
        return F.transform(F.array_sort(F.filter(places, lambda x: x["at"] > 0)), lambda x: x["name"])

    return let(text, lambda t: F.when(names_skill(t), found(t)).otherwise(strings()))


def expand_skill(value: Column, strip_plus: bool = True) -> Column:
    """The parts of a compound name ("Vue/React", "Java（Spring）") and the skills in it, each once by canonical form.

    With ``strip_plus`` a '+' at an end goes, so that "ES6+" is ES6; "C++" is C then as well.
    """
    edge = r"[()（）\[\]{}+·\-]+" if strip_plus else r"[()（）\[\]{}·\-]+"
    parts = F.filter(F.transform(F.split(strip(value), r"[\\/|、，,；;（）()]+"), lambda x: F.regexp_replace(strip(x), f"^{edge}|{edge}$", "")), lambda x: x != "")
    every = F.filter(F.transform(F.concat(parts, extract_skills(value)), strip), lambda x: x != "")
    keys = F.transform(every, normalize_skill)
    once = F.filter(every, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)
    only_itself = (F.size(every) == 1) & (F.element_at(keys, 1) == normalize_skill(value))
    return F.when(is_placeholder(value), strings()).when(only_itself | (F.size(once) == 0), F.array(strip(value))).otherwise(once)


def title_skills(title: Column) -> Column:
    """Primary skills that a title names, by substrings."""
    t = F.lower(strip(title))
    return F.array_compact(F.array(*[F.when(contains_any(t, ps), F.lit(k)) for k, ps in TITLE_SKILL_PATTERNS.items()]))


def infer_skills(lists: list[Column], text: Column) -> Column:
    """Named skills first, then those in the text, each spelling once."""
    return dedupe_ci(F.concat(*[F.coalesce(x, strings()) for x in lists], extract_skills(F.coalesce(text, F.lit("")))))


def directional_signals(values: Column) -> Column:
    """Canonical skills among the values that tell frontend, backend and mobile work apart."""
    known = strings(*sorted({*FRONTEND_SIGNALS, *BACKEND_SIGNALS, *MOBILE_SIGNALS}))
    return F.array_intersect(F.transform(F.flatten(F.transform(values, lambda v: expand_skill(v))), normalize_skill), known)
