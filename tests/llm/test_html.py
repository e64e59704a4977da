import random
import time

import pytest
from pyspark.sql import types as T

from rolecast.llm import html as H
from rolecast.llm.html import best_run, extract, label_counts, learn_weights, main_text, tags, weights_of

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "html", "text")]).add("page_id", T.LongType())
WORDS = " ".join(f"word{i}" for i in range(30))
PAGE = f"""<!DOCTYPE html><html lang="en"><head><title>T here</title><style>p{{margin:0}}</style><script>var t="</p> x";</script></head>
<body><header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now cheap</div>
<article><h1>Title &amp; more</h1><p><b>First   {WORDS}<br><p>Caf&eacute; &#8364; a&nbsp;b<div class="advert">sponsored words here</div><p>Second
 {WORDS}</p><form><label>Mail</label><input></form><aside>Side note</aside><ul><li>one</li><li>two</ul></article>
<section id="comments"><p>Reader says {WORDS}</p></section><footer>&copy; site &middot; end</footer>"""
WANT = f"Title & more\nFirst {WORDS}\nCafé € a b\nSecond {WORDS}\none\ntwo"


def test_known_parts_are_left_out():
    assert extract(PAGE, weights_of({})) == WANT


def test_without_article_element():
    page = PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")
    assert extract(page, weights_of({})) == WANT


def test_odd_pages():
    w = weights_of({})
    assert extract(None, w) == extract("", w) == extract("<p></p><br>", w) == ""
    assert extract("plain words only", w) == "plain words only"
    assert extract(f"<article><p>{WORDS}<!-- open", w) == WORDS
    assert extract(f"<article><p>a < b and c</p><p>{WORDS}</p>", w) == f"a < b and c\n{WORDS}"
    long = "<article><p>" + "x " * 200_000
    assert len(extract(long, w)) == 399_999


def test_table(spark):
    rows = [("u", PAGE, "clash", 1), ("u", None, None, 2), (None, "", "", None), ("u", PAGE, "clash", 1)]
    out = main_text(spark.createDataFrame(rows, SCHEMA)).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "u", WANT, len(WANT))] * 2 + [(2, "u", "", 0), (None, None, "", 0)], key=str)
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_weights_from_labelled_pages(spark):
    page = f'<article><div class="zone-a"><p>{WORDS}</p></div></article><div class="zone-b"><p>{WORDS}</p></div>'
    w = learn_weights(spark.createDataFrame([(page,)] * 20, "html string"))
    assert w[".a"] > 2 and w[".b"] < -2


def test_classes_for_layout_and_topics_lose_no_page():
    w = weights_of({})
    text = f"<h1>Title</h1><p>{WORDS}</p>"
    rest = '<nav><a>Home</a></nav><div class="advert">buy now</div>'
    after = f'<div class="comments"><article class="comment"><p>Reader says {WORDS}</p></article></div><footer>end</footer>'
    for head, tail in (
        ('<body class="right-sidebar">' + rest + "<article>", "</article>"),
        ('<body>' + rest + '<div class="overflow-hidden"><article>', "</article></div>"),
        ('<body>' + rest + '<div class="overflow-hidden wide"><div class="post-content">', "</div></div>"),
        ('<body>' + rest + '<main class="search-results">', "</main>"),
        ('<body>' + rest + '<main class="search-results"><article class="post category-legal tag-newsletter">', "</article></main>"),
        ('<body>' + rest + '<article class="post legal">', "</article>"),
        ('<body>' + rest + '<form id="login"><div class="sidebar-layout social"><article>', "</article></div></form>"),
        ('<body>' + rest + f'<div class="social wrap"><div class="entry-content"><p>{WORDS} {WORDS}</p>', "</div></div>"),
    ):
        got = extract(f"<html>{head}{text}{tail}{after}", w)
        assert "Title\n" + WORDS in got and "Reader" not in got and "buy" not in got and "end" not in got, head


def test_teasers_and_hidden_parts_stay_out():
    w = weights_of({})
    teasers = '<aside><article><p>teaser one of many</p></article></aside><div class="related"><article class="card"><p>teaser two of many</p></article></div>'
    assert extract(f'<body><div class="post-content"><p>{WORDS}</p></div>{teasers}', w) == WORDS
    assert extract(f"<body><div><p>{WORDS}</p></div>{teasers}", w) == WORDS
    assert extract(f'<body><article><p>{WORDS}</p><div hidden>not shown</div><div aria-hidden="true">nor this</div></article><div hidden><article>{WORDS}</article></div>', w) == WORDS
    assert extract(f'<body><article><div aria-hidden="false" class="overflow-hidden x"><p>{WORDS}</p></div></article>', w) == WORDS


def test_lists_of_articles_with_like_classes():
    item = f'<article class="post legal"><p>{WORDS}</p></article>'
    assert extract(f"<body>{item * 3}", weights_of({})) == "\n".join([WORDS] * 3)


@pytest.mark.parametrize("article", ['<h1 class="entry-title">Head</h1>', '<h1>Head</h1><section class="legal">', '<h1>Head</h1><p class="label-text">', '<h1>Head</h1><div class="search">', '<h1 class="title">Head</h1><div class="topic-form">'])
@pytest.mark.parametrize("holder", ["article", "main"])
def test_names_that_may_be_topics_drop_nothing(article, holder):
    assert extract(f'<body><nav>Home</nav><{holder}>{article}<p>{WORDS}</p></{holder}><div class="comments">no</div>', weights_of({})) == f"Head\n{WORDS}"


def test_counts_overrule_soft_names():
    page = f'<body><div class="search"><p>{WORDS}</p></div>'
    counts = {".search": (5000, 0)}
    assert weights_of({})[".search"] < 0 < weights_of(counts)[".search"]
    assert extract(page, weights_of(counts)) == WORDS


def test_best_run_against_all_runs():
    rnd = random.Random(7)
    for _ in range(300):
        scores = [rnd.choice((-3, -1, -0.5, 0, 0.25, 1, 2)) for _ in range(rnd.randrange(12))]
        sums = [(sum(scores[a:z]), a, z) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)]
        best = max((s for s, _, _ in sums), default=0)
        a, z = best_run(scores)
        assert sum(scores[a:z]) == max(best, 0)


def test_tags_against_a_scan():
    """Where a tag ends, by reading on from every < one character after another."""

    def plain(page):
        at = 0
        while at < len(page):
            if page[at] != "<" or not page[at + 1 : at + 2].isalpha():
                at += 1
                continue
            quote, end = "", -1
            for i in range(at + 1, len(page)):
                if quote:
                    quote = "" if page[i] == quote else quote
                elif page[i] in "'\"":
                    quote = page[i]
                elif page[i] == ">":
                    end = i + 1
                    break
            if end < 0:
                end = page.find(">", at) + 1
            if not end:
                return
            yield at, end
            at = end

    rnd = random.Random(11)
    for _ in range(3000):
        page = "".join(rnd.choice(("<a", "<b ", ">", "'", '"', "x", " ")) for _ in range(rnd.randrange(14)))
        assert [(a, z) for a, z, _, name, _ in tags(page) if name] == list(plain(page)), page


def test_hostile_pages_take_linear_time():
    w = weights_of({})
    for page in ("<div>" * 50_000 + "x", "<a '" * 50_000, "<a '><b \">" * 30_000, "<font>" * 50_000 + "</i>" * 50_000, "<ul><li>" * 30_000, "<!" * 50_000, "".join(f"<div class=c{i}>" for i in range(20_000))):
        began = time.time()
        extract(page, w)
        label_counts("<article>" + page)
        assert time.time() - began < 20, page[:20]


ARTICLE = "<html><body><nav><a href=x>Home</a></nav><article><h1>Title of it</h1><p>First words of the article as they stand here.</p>{}<p>Last words of the article as they stand here.</p></article><footer>All rights</footer></body></html>"
INSIDE = [
    ('<pre><span class="hljs-comment"># note</span> x = 1</pre>', "# note x = 1"),
    ('<p class="share-price">The price rose by two</p>', "The price rose by two"),
    ('<h2 class="section-header">Second part</h2>', "Second part"),
    ('<div class="side-by-side"><p>Left words</p></div>', "Left words"),
    ('<p class="menu-item">Soup of the day</p>', "Soup of the day"),
    ('<blockquote class="comment">She said so</blockquote>', "She said so"),
    ('<p class="notice">Mind the step</p>', "Mind the step"),
    ('<ul><li class="share">A share of it</li></ul>', "A share of it"),
    ('<div class="header-text">How it began</div>', "How it began"),
    ('<p>with <span class="hidden">plain</span> words</p>', "with plain words"),
    ("<header><h2>Own head</h2><p>by someone</p></header>", "Own head\nby someone"),
]
OUTSIDE = [
    '<div class="comments"><p>Nice read</p></div>', '<section id="comments-list"><ol><li class="comment">First!</li></ol></section>', '<div class="share-buttons"><a href=x>Tell</a></div>', '<div class="ad-slot-3">Buy now</div>',
    '<p class="advert">Buy now</p>', '<aside class="x">By the way</aside>', '<div class="related-posts"><a href=x>More</a></div>', '<div class="newsletter-signup">Your address</div>', '<form><p>Name</p></form>', "<div hidden>unseen</div>",
    '<div class="menu"><a href=x>One</a> <a href=y>Two</a></div>', "<header><a href=x>Home</a> <a href=y>News</a></header>", '<div class="cookie-notice">We use them</div>', '<p style="display:none">unseen</p>', "<nav><a href=x>On</a></nav>",
]


@pytest.mark.parametrize(("part", "text"), INSIDE)
def test_class_words_within_an_article_decide_nothing_alone(part, text):
    weights = H.weights_of({})
    assert H.extract(ARTICLE.format(part), weights) == f"Title of it\nFirst words of the article as they stand here.\n{text}\nLast words of the article as they stand here."


@pytest.mark.parametrize("part", OUTSIDE)
def test_parts_within_an_article_that_are_no_text(part):
    weights = H.weights_of({})
    assert H.extract(ARTICLE.format(part), weights) == "Title of it\nFirst words of the article as they stand here.\nLast words of the article as they stand here."


def test_class_marks():
    marks = {'class="share-price"': "", 'class="share-buttons"': "part", 'class="x side"': "layout", 'id=ad-3': "advert", 'class="side-by-side"': "", "role=contentinfo": "part", 'href="ad"': ""}
    assert {a: H.class_mark(a) for a in marks} == marks
