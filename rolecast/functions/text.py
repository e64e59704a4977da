"""Text, list and number rules shared by all operators: Column in, Column out, nothing but built-in functions.

Python's semantics where they differ from SQL's: white space is any Unicode white space, lists keep order,
blank strings count as absent, int(round(x)) is half-even. ``r4`` rounds half up with a nudge of 1e-9, so that
sums of products that end on a five come out alike in any order of summation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import CONTACT_LABELS, ITEM_HEADINGS, PLACEHOLDERS, RESPONSIBILITY_MARKERS, SECTION_ENDS

EMAIL = r"(?iU)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
URL = r"(?i)https?://\S+|www\.\S+"
MOBILE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
HANDLE = r"(?U)\b[a-zA-Z]\d{8,}\b"
#: Unicode's white space, as (?U)\s takes it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def r4(x: Column, digits: int = 4) -> Column:
    return F.round(x + F.lit(1e-9), digits)


def none_of(kind: str) -> Column:
    return F.lit(None).cast(kind)


def strings(*values: Column | str) -> Column:
    """An array of strings; () is an empty one."""
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: what a lambda of ``transform`` names otherwise, it computes for each element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def is_placeholder(c: Column) -> Column:
    """Null, blank, a known stand-in, or anything that ends in 'pending'."""
    stands_in = lambda s: s.isNull() | (s == "") | s.isin(*PLACEHOLDERS) | s.endswith(" pending") | s.endswith(" pending.")
    return let(F.lower(collapse(c)), stands_in)


def clean_text(c: Column) -> Column:
    return F.when(~is_placeholder(c), strip(c))


def profile_token(c: Column) -> Column:
    """A usable token: no stand-in, and not a URL, e-mail address or mobile number as a whole."""
    s = strip(c)
    return F.when(~is_placeholder(c) & ~s.rlike(rf"^(?:{URL})$") & ~s.rlike(rf"^(?:{EMAIL})$") & ~s.rlike(r"^1[3-9]\d{9}$"), s)


def scrub_contacts(c: Column, mobiles: bool = True) -> Column:
    """Contacts and their labels dropped; without ``mobiles``, eleven digits stay, as they may be of a digest or a key."""
    out = c
    for pattern in (URL, EMAIL, *([MOBILE] if mobiles else []), HANDLE):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, "(?i)(?:" + "|".join(CONTACT_LABELS) + r")\s*[:：]?", " ")
    return F.regexp_replace(collapse(out), r"^[ ,;,；|]+|[ ,;,；|]+$", "")


def dedupe_ci(items: Column) -> Column:
    """Blank items dropped, the first spelling of each kept, in order."""
    full = F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))
    first = lambda full, keys: F.filter(full, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    return let(full, lambda f: let(F.transform(f, F.lower), lambda keys: first(f, keys)))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[clean_text(c) for c in columns])


def first_list(*arrays: Column) -> Column:
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], strings())


def try_float(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("double")


def try_int(c: Column) -> Column:
    return F.bround(try_float(c), 0).try_cast("int")


def positive(c: Column) -> Column:
    x = try_float(c)
    return F.when(x > 0, x)


def truth(c: Column) -> Column:
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin("true", "yes", "1", "y", "是"), True).when(s.isin("false", "no", "0", "n", "否"), False)


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """(low, high): a missing side takes the other, a reversed pair is turned."""
    left, right = F.coalesce(a, b), F.coalesce(b, a)
    return F.least(left, right), F.greatest(left, right)


def contains_any(text: Column, words) -> Column:
    """Whether the text holds one of the words; those that hold another word of them need no look of their own."""
    return reduce(or_, [text.contains(w) for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)])


def keyword_categories(text: Column, words: dict) -> Column:
    """Categories one of whose words the text contains, in dictionary order. Plain substrings: 'ai' is in 'retail'."""
    return let(text, lambda t: F.array_compact(F.array(*[F.when(contains_any(t, w), F.lit(k)) for k, w in words.items()])))


def fuzzy_hits(terms: Column, text: Column) -> Column:
    return F.size(F.filter(terms, lambda t: (F.length(t) >= 2) & text.contains(t)))


def split_delims(c: Column) -> Column:
    return dedupe_ci(F.split(c, r"[,，/|、;；]+"))


def city_tokens(c: Column) -> Column:
    """City names of a location line, brackets and a final 市 dropped."""
    parts = F.transform(F.split(c, r"[,，/|、;；]+"), lambda x: strip(F.regexp_replace(x, r"[\[\]'\"()（）【】]", "")))
    return dedupe_ci(F.transform(parts, lambda x: F.when(F.length(x) > 1, F.regexp_replace(x, "市$", "")).otherwise(x)))


def match_cities(c: Column) -> Column:
    """City names for matching: more separators, a set, case kept."""
    parts = F.filter(F.split(c, r"(?U)[,，/|、\s\[\]'\"()\-·]+"), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.when(F.length(x) > 1, F.regexp_replace(x, "市$", "")).otherwise(x)))


def section_text(c: Column, marker: str | Column, ends) -> Column:
    """What follows the first marker, up to the nearest end marker; null without the marker."""
    mark = F.lit(marker) if isinstance(marker, str) else marker
    tail = F.regexp_replace(F.substring(c, F.position(mark, c) + F.length(mark), F.length(c)), r"(?U)^[：:\-\s]+", "")
    return F.when(F.position(mark, c) > 0, strip(F.split(tail, "|".join(map(re.escape, ends)), 2)[0]))


def bullet_items(c: Column) -> Column:
    """Items of a list written as text: lines, bullets, spaced dashes and bars, numbers, semicolons, sentences.

    Numbers and a heading before an item go, and so do stops around it; items under six characters or that hold a marker of a part do, too.
    """
    lines = F.regexp_replace(c, r"[\r•●▪■◆◇]|(?U:\s+(?:[-–—]|\|)\s+)", "\n")
    lines = F.regexp_replace(lines, r"(?U)(?:^|\n)\s*(?:\d+|[一二三四五六七八九十]+)[、.．:：)]\s*", "\n")
    lines = F.regexp_replace(lines, r"(?U)[；;]|(?<=[。！？])\s*", "\n")
    bare = lambda x: strip(F.regexp_replace(x, r"(?U)^[\-\d、.．:：()（）\s]+", ""))
    headless = lambda x: F.regexp_replace(x, "(?U)^(?:" + "|".join(ITEM_HEADINGS) + r")[：:\s-]*", "")
    items = F.transform(F.split(lines, r"[\n\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(headless(bare(x)), "^[，,。；; ]+|[，,。；; ]+$", ""))
    return dedupe_ci(F.filter(items, lambda x: (F.length(x) >= 6) & ~contains_any(x, RESPONSIBILITY_MARKERS + SECTION_ENDS)))


def marked_items(c: Column, markers, ends, most: int) -> Column:
    """The first items of each part, by the order of markers, of those markers alone that the text holds."""
    return F.transform(F.filter(strings(*markers), lambda m: F.contains(c, m)), lambda m: F.slice(bullet_items(section_text(c, m, ends)), 1, most))


def section_items(c: Column, markers, ends, most: int) -> Column:
    """The first items of the first part, by the order of markers, that has any; else an empty list."""
    return F.coalesce(F.try_element_at(F.filter(marked_items(c, markers, ends, most), lambda p: F.size(p) > 0), F.lit(1)), strings())


def running(lengths: Column, block: int = 256) -> Column:
    """Sums of an array of whole numbers up to and with each element: within blocks, on top of what the blocks before hold."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = let(lengths, lambda a: F.transform(starts, lambda s: F.slice(a, s, F.lit(block))))

    def joined(parts: Column) -> Column:
        before = let(F.transform(parts, total), lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i))))
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p, lambda _, i: b + total(F.slice(p, F.lit(1), i + 1)))))

    return let(blocks, joined)


def occurrences(c: Column, pattern: str, reach: int = 24) -> Column:
    """array of struct(at, hit, left, right): all matches of a pattern from the left, none over another.

    ``at`` counts characters from 1; left and right are up to ``reach`` characters on either side. The text is read a few times, however many
    matches it has: places are sums of what lies between matches, and what surrounds a match is taken by looking around. The pattern has no groups
    that capture and matches no empty text; null gives null.
    """
    one = "[\\x00-\U0010ffff]"  # with the last code point spelled out, looking behind counts code points
    near = rf"(?s)(?=(?:{pattern}))(?<=(\A{one}{{0,{reach - 1}}}|{one}{{{reach}}}))({pattern})(?=(.{{0,{reach}}}))"
    left, hits, right = (F.regexp_extract_all(c, F.lit(near), F.lit(i)) for i in (1, 2, 3))
    gaps = F.transform(F.split(c, rf"(?s)(?:{pattern})", -1), F.length)
    ends = let(hits, lambda h: running(F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, x: g + F.length(x))))
    found = F.transform(F.arrays_zip(ends.alias("end"), hits.alias("hit"), left.alias("left"), right.alias("right")), lambda x: F.struct((x["end"] - F.length(x["hit"]) + 1).alias("at"), x["hit"].alias("hit"), x["left"].alias("left"), x["right"].alias("right")))
    none = F.array().cast("array<struct<at:int, hit:string, left:string, right:string>>")
    return F.when(c.rlike(rf"(?s){pattern}"), found).when(c.isNotNull(), none)  # most texts are read once only


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return let(s, lambda x: F.when(x != "", x))


def template_signature(company: Column, title: Column, summary: Column) -> Column:
    head = F.regexp_replace(F.regexp_replace(F.lower(strip(summary)), r"(?U)\s+", " "), r"\d+", "")
    return F.concat_ws("::", F.lower(strip(company)), F.regexp_replace(F.lower(strip(title)), r"\d+", ""), F.substring(head, 1, 120))


def payload_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def brief(c: Column, size: int = 80) -> Column:
    s = collapse(c)
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size), F.lit("…"))).otherwise(s)


def json_string_list(c: Column) -> Column:
    """The strings of a JSON array, or the text itself as a list of one."""
    s = blank_null(c)
    return F.when(s.isNull(), strings()).otherwise(F.coalesce(F.when(s.startswith("["), F.from_json(s, "array<string>")), F.array(s)))


def text_blob(*columns: Column) -> Column:
    return F.array_join(dedupe_ci(F.array_compact(F.array(*columns))), "\n")


def meaningful(c: Column) -> Column:
    """Neither null, blank nor a stand-in that records are filled with."""
    s = F.lower(strip(c))
    return F.coalesce((s != "") & ~s.isin(*PLACEHOLDERS), F.lit(False))


def meaningful_values(items: Column) -> Column:
    return dedupe_ci(F.filter(items, meaningful))


def shortened(c: Column, size: int) -> Column:
    """At most ``size`` characters, the last of them an ellipsis where the text is longer."""
    s = collapse(c)
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size - 1), F.lit("…"))).otherwise(s)


def compact_range(a: Column, b: Column, unit: str | Column = "") -> Column:
    """'3-5', '3' if equal or alone, or null; then the unit."""
    show = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    tail = F.lit(unit) if isinstance(unit, str) else unit
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(show(a), F.lit("-"), show(b), tail)).when(F.coalesce(a, b).isNotNull(), F.concat(show(F.coalesce(a, b)), tail))
