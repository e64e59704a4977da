"""Incremental re-tagging: only records whose text, or whose words in the dictionaries, or the rules have changed are normalised again."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import let
from ..storage import staged
from .maintain import tag_counts
from .normalize import normalize_jobs, tag_changes

#: To be raised whenever a rule of normalisation changes: then every record is stale once.
RULES = "1"


def dictionary_entries() -> dict[str, tuple[str, ...]]:
    """The words that rules look up in texts, by dictionary and category. Patterns, as those of skills, aren't words: when one changes, raise ``RULES``."""
    named = {"role": D.ROLE_KEYWORDS, "mode": D.MODE_KEYWORDS, "ai": D.AI_KEYWORDS}
    out = {f"{kind}/{category}": tuple(words) for kind, words_of in named.items() for category, words in words_of.items()}
    return out | {"intern": tuple(D.INTERN_KEYWORDS), "entry": tuple(D.JOB_ENTRY_WORDS), "senior": tuple(D.JOB_SENIOR_WORDS), "city": tuple(c for region in D.CITY_REGIONS for c in region)}


def fingerprint(flat: DataFrame, dictionary: Mapping[str, tuple[str, ...]], rules: str = RULES) -> Column:
    """SHA-256 of a flat record, of the dictionary's entries that its text holds, and of the rules' version.

    A word that comes into a dictionary, goes or changes its category so makes stale the records that hold it, and no others.
    """
    text = F.lower(F.concat_ws("\n", *[F.col(n) for n in ("title", "summary", "text", "location") if n in flat.columns]))
    entries = F.array(*[F.struct(F.lit(w.lower()).alias("w"), F.lit(f"{k}:{w}").alias("e")) for k, words in sorted(dictionary.items()) for w in words])
    held = let(text, lambda t: F.transform(F.filter(entries, lambda x: F.contains(t, x["w"])), lambda x: x["e"]))  # the text is lowered once a row
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(flat.columns)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\u0001", F.lit(rules), record, F.array_join(held, "\u0002")), 256)


@dataclass
class Refresh:
    """``table`` and ``marks`` (id, fingerprint) to store; ``stale`` ids; ``changed`` records with what differs; tag ``counts`` of the stale before and after."""

    table: DataFrame
    marks: DataFrame
    stale: DataFrame
    changed: DataFrame
    counts: DataFrame


def refresh_tags(stored: DataFrame, marks: DataFrame, flat: DataFrame, as_of: Column, dictionary: Mapping[str, tuple[str, ...]] | None = None, rules: str = RULES) -> Refresh:
    """Stored openings brought up to date with the flat records ``flat`` and with what the dictionaries now hold.

    Records whose fingerprint is the stored one are neither normalised nor written; of the stale ones those that come out with other tags,
    roles or text replace what is stored (new ones are added). Records that ``flat`` lacks stay as they are. Vectors of changed records are
    stale by their payload's hash (``recall.refresh_vectors``). A trial run uses all but ``table`` and ``marks``.
    """
    now = flat.withColumn("fingerprint", fingerprint(flat, dictionary_entries() if dictionary is None else dictionary, rules))
    known = marks.select("id", F.col("fingerprint").alias("known"))
    stale = staged(now.join(known, "id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("known"))).drop("known"))
    fresh = staged(normalize_jobs(stale.drop("fingerprint"), as_of))
    before = stored.join(stale.select("id"), "id", "left_semi")
    changed = staged(tag_changes(before, fresh))
    table = stored.join(changed.select("id"), "id", "left_anti").unionByName(changed.drop("changed"))
    new_marks = marks.join(stale.select("id"), "id", "left_anti").select("id", "fingerprint").unionByName(stale.select("id", "fingerprint"))
    long = lambda df: df.select(F.explode("tags").alias("t")).select("t.category")
    return Refresh(table, new_marks, stale.select("id"), changed, tag_counts(long(before), long(fresh)))
