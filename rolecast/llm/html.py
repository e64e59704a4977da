"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by the elements it stands in: the log-odds, summed over
them, of lying inside the main text; a tag scores below zero. One linear scan finds the contiguous region of
the greatest sum. Inside it, words whose own score is not positive (an advert between paragraphs, a comment
list) are left out, and blocks become lines.

The weights come from labelled pages: those whose markup names the main text (``article`` or ``main``) say of
each word whether it lies within. A grouped count over a bounded sample of them gives the odds of every tag and of
every word in class and id attributes (written ``.word``); the counts start from fixed ones for well-known names, so that
names which the sample never shows have weights as well. The fixed counts are large where pages put parts into their
article that aren't its text (adverts, comments, forms), as such labels can't tell; the names that may mean a topic as well
(``SOFT``) have small ones, which the sample overrules and which decide nothing alone.

A name that is surely outside rules an element out, but a class is also used for layout and topics. So words
such as those in ``overflow-hidden`` or ``category-legal`` don't count, nor does any class of html, body and main; and
on the elements that hold the page's own main text a class or id rules out nothing (``text_holders``). Within surely main
text single words of classes decide nothing at all: there a class rules an element out only if it is made up of names for
what isn't text (``class_mark``), and never words in a line, a paragraph, a heading, a list item or a listing, but for
adverts and the like. A header there that holds a heading, as articles have it, is text; other headers are not.

Elements are nodes with their parent's number; what a word scores is carried down from parent to child, and tags are found
by position, so time is linear in the page however deep it is and whatever its quotes.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fresh, map_batches

#: Tags and words of classes where pages put their main text and where they don't. Each counts as ``KNOWN`` words, or ``SOFT_KNOWN``.
INSIDE_TAGS = ("article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table")
INSIDE_WORDS = ("article", "main", "content", "post", "entry", "story", "body-text")
OUTSIDE_TAGS = ("nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "menu", "button", "select", "option", "textarea", "input", "label", "iframe", "svg", "dialog", "title", "head")
OUTSIDE_WORDS = (
    "nav", "header", "footer", "aside", "menu", "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsored", "sponsor", "promo", "promotion", "banner", "sidebar", "side", "navbar", "navigation", "navi", "menus", "topbar", "masthead", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "disclaimer", "copyright", "comment", "comments", "reply", "replies", "respond", "disqus", "related", "recommended", "recommendations", "share", "sharing", "social", "subscribe", "subscription", "newsletter", "signup", "login", "widget", "toolbar", "hidden", "[hidden]", "contentinfo", "complementary",
)
#: Of these, what is an advert or an offer wherever it stands, and what as often tells layout.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsored sponsor promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager disqus".split())
LAYOUT = frozenset("header footer side menu menus hidden overlay copyright masthead topbar".split())
#: Words beside them in a class that is a name for such a part.
PARTS = frozenset("box list wrap wrapper container block section area item items bar unit slot link links button buttons form message inner outer left right top bottom center group grid row col column panel card cards post posts article articles story stories content text body title heading icons icon js wp sticky fixed mobile desktop new".split())
#: Elements of running text: their classes name how they look.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre code li dd dt td th tr table tbody blockquote figure figcaption span a b i em strong small sub sup u s mark abbr cite q kbd samp var time data ins del dfn font tt label picture video audio address".split())
SOFT = ("legal", "search", "skip", "tags", "alert", "discussion", "label", "form", "title", "button")
KNOWN = 3000.0
SOFT_KNOWN = 60.0
SMOOTH = 5.0
TAG_SCORE = -0.6
#: Elements that never hold content, and elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the first closes an open element of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_CLOSERS = BLOCKS - {"br"}
_SECTIONS = frozenset("article main section nav aside header footer body html div form table ul ol dl".split())

_CONTAINERS = frozenset("article main div section td".split())
_INSIDE = frozenset("." + w for w in INSIDE_WORDS)
_INLINE = frozenset("p b i em strong span a li td".split())
#: Where that many names are nested, counting begins anew within, lest a page of ever new names takes the square of its size.
MOST_NAMES = 1000

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PHRASES = RUNNING - frozenset("p li dd dt td th tr table tbody figure figcaption blockquote".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_HIDDEN_BARE = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: A class of several words that begins with one of these tells layout or topic, not what an element is.
MODIFIERS = frozenset("category cat tag topic overflow has no not with without layout template".split())
#: Elements whose classes say nothing about whether they are main text.
_PLAIN = frozenset("html body main".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")


def element_names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element is called: its tag, the words of its class, id and role without modifiers, each as ``.word``, and '[hidden]'."""
    names = {tag}
    if attributes and tag not in ("html", "body"):
        for _, a, b, c in _NAMES.findall(attributes) if tag not in _PLAIN else ():
            for part in (a or b or c).lower().split():
                words = [w for w in _SPLIT.split(part) if w]
                if len(words) < 2 or not (":" in part or words[0] in MODIFIERS or words[-2:] == ["right", "sidebar"] or words[-2:] == ["left", "sidebar"]):
                    names.update("." + w for w in words)
        if "hidden" in attributes.lower() and _HIDDEN_BARE.search(_QUOTED.sub("''", attributes)) or _HIDDEN.search(attributes):
            names.add("[hidden]")
    return tuple(sorted(names))


_OUT_WORDS = frozenset(OUTSIDE_WORDS)


def class_mark(attributes: str) -> str:
    """What classes, id and role name as a whole: 'advert', 'part' (comments, shares, ...), 'layout' or ''.

    ``share-buttons`` is a name of a part, ``share-price`` and ``side-by-side`` are not, as "price" and "by" belong to no such name.
    """
    marks = set()
    for _, a, b, c in _NAMES.findall(attributes):
        for part in (a or b or c).lower().split():
            words = [w for w in _SPLIT.split(part) if w]
            named = [w for w in words if w in _OUT_WORDS]
            if named and all(w in _OUT_WORDS or w in PARTS or w.isdigit() for w in words):
                marks.add("advert" if not ADVERTS.isdisjoint(named) else "layout" if LAYOUT.issuperset(named) else "part")
    return min(marks, default="", key=("advert", "part", "layout").index)


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, '/' or '', name or '', attributes) of every tag, comment and the like (without a name), in page order.

    A tag ends at the first > outside quotes; if there is none, its quotes don't count. An unclosed comment takes the rest.
    """
    at, last = 0, page.rfind(">")
    dead: set[int] = set()  # places from where, quotes counted, no > follows
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", "", ""
            at = end
            continue
        if at > last:  # no tag can end any more, but a comment may begin
            at = page.find("<!--", at)
            if at < 0:
                return
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, "", "", ""
            at = end
            continue
        m = _TAG.match(page, at)
        if not m:
            at += 1
            continue
        here, seen, end = m.end(), [], -1
        while here not in dead:
            seen.append(here)
            stop = _STOP.search(page, here)
            if not stop:
                break
            if stop[0] == ">":
                end = stop.end()
                break
            here = page.find(stop[0], stop.end()) + 1
            if not here:
                break
        if end < 0:
            dead.update(seen)
            end = page.find(">", m.end()) + 1
        yield at, end, m[1], m[2].lower(), page[m.end() : end - 1]
        at = end


class Page:
    """Elements in page order (their parents, tags and names), and what there is to read: (tag or None, text or None, element).

    End tags close up to their element and are ignored without one; p, li, td and the like close as browsers
    close them; comments, doctypes and the content of raw elements give no words; an unclosed comment or raw
    element takes the rest of the page. Element -1 is the page itself.
    """

    def __init__(self, page: str) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.names: list[tuple[str, ...]] = []
        self.marks: list[str] = []
        self.events: list[tuple[str | None, str | None, int]] = []
        stack: list[int] = []
        open_at: dict[str, list[int]] = {}  # places in the stack by tag
        sections: list[int] = []

        def cut_to(n: int) -> None:
            while len(stack) > n:
                tag = self.tag[stack.pop()]
                open_at[tag].pop()
                if tag in _SECTIONS:
                    sections.pop()

        top = lambda: stack[-1] if stack else -1
        at = 0
        for begin, end, close, tag, attributes in tags(page):
            if begin < at:  # within a raw element
                continue
            if begin > at:
                self.events.append((None, page[at:begin], top()))
            at = end
            if not tag:
                continue
            if close:
                found = open_at.get(tag)
                if found and not (tag in _INLINE and sections and sections[-1] > found[-1]):
                    cut_to(found[-1])
                self.events.append(("/" + tag, None, top()))
                continue
            if tag in RAW and not attributes.endswith("/"):
                done = _raw_end(tag).search(page, at)
                at = done.end() if done else len(page)
                self.events.append((tag, None, top()))
                continue
            gone = _CLOSES.get(tag, ()) or (("p",) if tag in _P_CLOSERS else ())
            last = max((open_at[t][-1] for t in gone if open_at.get(t)), default=-1)
            if last >= 0 and not (sections and sections[-1] > last):
                cut_to(last)
            if tag not in VOID and not attributes.endswith("/"):
                self.parent.append(top())
                self.tag.append(tag)
                self.names.append(element_names(tag, attributes))
                self.marks.append(class_mark(attributes) if attributes else "")
                open_at.setdefault(tag, []).append(len(stack))
                if tag in _SECTIONS:
                    sections.append(len(stack))
                stack.append(len(self.parent) - 1)
            self.events.append((tag, None, top()))
        if at < len(page):
            self.events.append((None, page[at:], top()))

    @cached_property
    def within(self) -> tuple[list[int], list[int], list[bool]]:
        """Of each element: words in it, words in links in it, whether a heading is in it."""
        n = len(self.tag)
        words, linked, heading = [0] * n, [0] * n, [t in _HEADINGS for t in self.tag]
        in_link = [False] * n
        for i in range(n):
            in_link[i] = self.tag[i] == "a" or (self.parent[i] >= 0 and in_link[self.parent[i]])
        for _, text, i in self.events:
            if text is not None and i >= 0:
                many = len(text.split())
                words[i] += many
                linked[i] += many if in_link[i] else 0
        for i in range(n - 1, -1, -1):
            if (up := self.parent[i]) >= 0:
                words[up] += words[i]
                linked[up] += linked[i]
                heading[up] = heading[up] or heading[i]
        return words, linked, heading

    def mostly_links(self, i: int) -> bool:
        words, linked, _ = self.within
        return 2 * linked[i] >= max(1, words[i])

    def ruled_out_within(self, i: int, weights: dict[str, float], names: tuple[str, ...], mark: str) -> bool:
        """Whether an element within surely main text isn't part of it."""
        tag = self.tag[i]
        if tag == "header" and "[hidden]" not in names and self.within[2][i]:
            return self.mostly_links(i)
        if min(weights.get(tag, 0.0), weights.get("[hidden]", 0.0) if "[hidden]" in names else 0.0) <= -3 and tag not in RUNNING or "[hidden]" in names:
            return True
        if mark == "advert":
            return tag not in _PHRASES
        return tag not in RUNNING and (mark == "part" or (mark == "layout" and self.mostly_links(i)))

    def path(self, i: int) -> list[int]:
        out = []
        while i >= 0:
            out.append(i)
            i = self.parent[i]
        return out[::-1]


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def label_counts(page: str) -> tuple[Counter, Counter] | None:
    """(words inside, words outside) by the names of the elements around them, of a page that names its main text.

    Words are counted at their element and then handed up: an element's own names count all words within it, once.
    """
    p = Page(page)
    if not any(t in ("article", "main") for t in p.tag):
        return None
    n = len(p.tag)
    inside, words, seen = [False] * n, [0] * n, [frozenset()] * n
    for i in range(n):
        up = p.parent[i]
        inside[i] = p.tag[i] in ("article", "main") or (up >= 0 and inside[up])
        around = seen[up] if up >= 0 and len(seen[up]) < MOST_NAMES else frozenset()
        seen[i] = around.union(p.names[i])
    for _, text, i in p.events:
        if text is not None and i >= 0:
            words[i] += len(text.split())
    into = (Counter(), Counter())
    for i in range(n):
        if words[i]:
            for name in seen[i] - {"html", "body"}:
                into[0 if inside[i] else 1][name] += words[i]
    return into


def known_counts() -> dict[str, tuple[float, float]]:
    inside = [*INSIDE_TAGS, *("." + w for w in INSIDE_WORDS)]
    outside = [*OUTSIDE_TAGS, *(w if w[0] == "[" else "." + w for w in OUTSIDE_WORDS)]
    return {n: (KNOWN, 0.0) for n in inside} | {n: (0.0, KNOWN) for n in outside} | {"." + n: (0.0, SOFT_KNOWN) for n in SOFT}


def learn_weights(pages: DataFrame, html_col: str = "html", max_pages: int = 5000, max_names: int = 5000, least_words: int = 200) -> dict[str, float]:
    """Log-odds of element names from at most ``max_pages`` different labelled pages, with their copies, the same on every run.

    At most ``max_names`` names with ``least_words`` words or more are kept, those with the most words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for page in batch.column(0).to_pylist():
                found = label_counts(page)
                if found:
                    inside.update(found[0])
                    outside.update(found[1])
            names = sorted({*inside, *outside})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], ["name", "inside", "outside"]
            )

    rows = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.lower("html").rlike("<(article|main)[\\s>]"))
    rows = rows.withColumn("key", F.xxhash64("html"))
    keys = rows.select("key").distinct().orderBy("key").limit(max_pages)
    sample = rows.join(F.broadcast(keys), "key").select("html")  # at most max_pages keys
    counts = map_batches(sample, run, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    top = counts.filter(F.col("inside") + F.col("outside") >= least_words).orderBy((F.col("inside") + F.col("outside")).desc(), "name").limit(max_names).collect()
    return weights_of({r["name"]: (r["inside"], r["outside"]) for r in top})


def weights_of(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    total = known_counts()
    for name, (a, b) in counts.items():
        known = total.get(name, (0.0, 0.0))
        # Labels can't tell of a name that is surely outside where pages put such parts into their article.
        total[name] = known if known[1] >= KNOWN else (a + known[0], b + known[1])
    return {n: math.log((a + SMOOTH) / (b + SMOOTH)) for n, (a, b) in total.items()}


class Scores:
    """What stands between which elements, carried down from parent to child.

    A word has its elements' log-odds, between -1 and 1. One element that is surely outside decides: -3, or 0
    where it stands within an element that is surely main text, as what is put into an article doesn't end it.
    """

    def __init__(self, page: Page, weights: dict[str, float], memo: dict, names: dict[int, tuple[str, ...]] | None = None) -> None:
        """``names`` are what some elements are called instead."""
        n = len(page.tag)
        total, count, self.sure, self.out = [0.0] * n, [0] * n, [False] * n, [False] * n
        self.word, self.tag, self.keep = [0.0] * n, [0.0] * n, [False] * n
        for i in range(n):
            mine = page.names[i] if not names else names.get(i, page.names[i])
            key = (page.tag[i], mine)
            if key not in memo:
                odds = [weights[x] for x in mine if x in weights]
                least = min(odds, default=0.0)
                memo[key] = (sum(max(-2.0, min(2.0, o)) for o in odds), len(odds), page.tag[i] in _CONTAINERS and max(odds, default=0.0) >= 3 and least > -3, least <= -3)
            t, c, sure, out = memo[key]
            up = page.parent[i]
            if up >= 0 and self.sure[up]:
                out = page.ruled_out_within(i, weights, mine, "" if names and i in names else page.marks[i])
            if up >= 0:
                t, c = t + total[up], c + count[up]
                sure, out = self.sure[up] or (sure and not self.out[up]), out or self.out[up]
            total[i], count[i], self.sure[i], self.out[i] = t, c, sure, out
            self.word[i], self.tag[i], self.keep[i] = self._of(t, c, sure, out)
        self.bare = self._of(0.0, 0, False, False)

    @staticmethod
    def _of(total: float, count: int, sure: bool, out: bool) -> tuple[float, float, bool]:
        """(score of a word, score of a tag, whether words are part of the text)"""
        if out:
            word = 0.0 if sure else -3.0
        else:
            word = max(0.1 if sure else -1.0, min(1.0, 0.3 + total / (1 + 0.5 * count)))
        return word, TAG_SCORE * (0.05 if sure else 1.0), not out and word > 0

    def at(self, i: int) -> tuple[float, float, bool]:
        return (self.word[i], self.tag[i], self.keep[i]) if i >= 0 else self.bare


def _freed(tag: str, names: tuple[str, ...], weights: dict[str, float]) -> tuple[str, ...]:
    """The names without those of class and id that rule an element out; a form may hold a whole page."""
    return tuple(n for n in names if weights.get(n, 0.0) > -3 or n == "[hidden]" or (n == tag and tag != "form"))


def _kind(tag: str, names: tuple[str, ...]) -> str:
    """How an element may name the main text: 'main', 'article', 'other' (a class or id) or ''."""
    if tag in ("main", "article"):
        return tag
    return "other" if tag in _CONTAINERS and any(n in _INSIDE for n in names) else ""


def text_holders(page: Page, weights: dict[str, float], memo: dict) -> dict[int, tuple[str, ...]]:
    """{element: what it is called instead} for those that hold the page's own main text.

    The page's main text is its largest main; in it, or without one, its largest outermost article (its own classes come first, and one that is ruled in counts three times); without either,
    or beside a smaller article, an element named for text that has over half of the page's words. Elements that are hidden, or within a nav,
    aside or the like, are never it. An article and those of the same names lose the classes that rule them out if
    one of them names text, or else, as does what holds an article, if the article has no fewer words than stand ruled
    in elsewhere, those within a surely main element counted three times.
    """
    n = len(page.tag)
    free, kind = [()] * n, [""] * n
    bad, suspect, hard = [False] * n, [False] * n, [False] * n
    for i in range(n):
        key = ("free", page.tag[i], page.names[i])
        if key not in memo:
            memo[key] = (_freed(page.tag[i], page.names[i], weights), _kind(page.tag[i], page.names[i]))
        free[i], kind[i] = memo[key]
        up = page.parent[i]
        bad[i] = free[i] != page.names[i] or (up >= 0 and bad[up])
        suspect[i] = (bad[i] and kind[i] != "") or (up >= 0 and suspect[up])
        hard[i] = "[hidden]" in page.names[i] or (page.tag[i] != "form" and weights.get(page.tag[i], 0.0) <= -3) or (up >= 0 and hard[up])
    counted = [(len(text.split()), i) for _, text, i in page.events if text is not None]
    if not any(i >= 0 and suspect[i] for _, i in counted):
        return {}
    new: dict[int, tuple[str, ...]] = {}

    def largest(name: str, within: int | None = None) -> tuple[list[int], int, int, list[int]]:
        """(path to the largest, its words, words ruled in outside all of this kind, the first of this kind around each element)"""
        scores = Scores(page, weights, memo, new)
        words, rest, first, under = Counter(), 0, [-1] * n, [within is None] * n
        for i in range(n):
            up = page.parent[i]
            first[i] = first[up] if up >= 0 and first[up] >= 0 else i if kind[i] == name else -1
            under[i] = under[i] or i == within or (up >= 0 and under[up])
        for many, i in counted:
            if not (under[i] if i >= 0 else within is None):
                continue
            own = first[i] if i >= 0 else -1
            if own < 0:
                _, tag_score, ruled_in = scores.at(i)
                rest += many * (3 if tag_score > TAG_SCORE else 1) if ruled_in else 0
            elif not hard[own]:
                words[own] += many
        if not words:
            return [], 0, rest, first

        def rank(i: int) -> tuple[bool, int]:
            named = free[i] == page.names[i] or any(x in _INSIDE for x in page.names[i])
            return named, words[i] * (3 if scores.keep[i] else 1)

        best = max(words, key=rank)  # the first of equals
        return page.path(best), words[best], rest, first

    main, _, _, _ = largest("main")
    new |= {i: free[i] for i in main}
    article, words, rest, first = largest("article", main[-1] if main else None)
    other, m, _, _ = largest("other") if not main else ([], 0, 0, [])
    beaten = m > words and other[-1] not in article
    if article and not beaten and (words >= rest or any(x in _INSIDE for x in page.names[article[-1]])):
        like = page.names[article[-1]]
        new |= {i: free[i] for i in {first[i] for _, i in counted if i >= 0} if i >= 0 and page.names[i] == like}
        if words >= rest:
            new |= {i: free[i] for i in article}
    elif 2 * m > sum(many for many, _ in counted):
        new |= {i: free[i] for i in other}
    return new


def best_run(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous run with the greatest sum, the first of equals; empty if no sum is above 0."""
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total > best:
            best, best_from, best_to = total, start, i + 1
        if total <= 0:
            total, start = 0.0, i + 1
    return best_from, best_to


def extract(page: str | None, weights: dict[str, float], memo: dict | None = None) -> str:
    """The main text: blocks in page order joined by one \\n; '' for a null, empty or wordless page."""
    memo = {} if memo is None else memo
    p = Page(page or "")
    marks = Scores(p, weights, memo, text_holders(p, weights, memo))
    pieces: list[str | None] = []  # text, '' where none counts, None at the edge of a block
    scores: list[float] = []
    for tag, text, i in p.events:
        word, edge, keep = marks.at(i)
        if text is not None:
            pieces.append(text if keep else "")
            scores.append(word * len(text.split()))
        else:
            pieces.append(None if tag.lstrip("/") in BLOCKS else "")
            scores.append(edge)
    a, z = best_run(scores)
    lines, line = [], []
    for text in [*pieces[a:z], None]:
        if text is None:
            if joined := _SPACE.sub(" ", entities.unescape("".join(line))).strip():
                lines.append(joined)
            line = []
        else:
            line.append(text)
    return "\n".join(lines)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """pages with two more columns, ``text`` and ``n_chars`` (code points), one row for each row.

    Columns of these names are replaced. A null or empty page, or one without main text, has the text ''.
    The page's headers aren't text; a header within the article is if it holds a heading and is not mostly links.
    Weights are learned from the pages themselves unless given; without labelled pages the known names rule.
    """
    learned = learn_weights(pages, html_col) if weights is None else weights
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            texts = [extract(p.as_py(), learned, memo) for p in batch.column(batch.num_columns - 1)]
            if len(memo) > 50_000:
                memo.clear()
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    rows = pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(html_col).cast("string").alias(fresh("__page", pages.columns)))
    return map_batches(rows, run, f"{schema}, text string, n_chars long")
