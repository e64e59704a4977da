import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.llm import language as L

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("language", T.StringType()))])
EN, DE = "the and of that this with from those there where".split(), "der und nicht die ist sich auch über für wäre".split()


def cases():
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(EN if i % 3 else DE) for _ in range(rnd.choice((1, 8, 60)))), ("en-US" if i % 3 else "de") if i % 20 else "de", "a.site.org" if i % 3 else "b.site.org") for i in range(150)]
    return rows + [(None, "the and", None, None), (7, None, "en", "a.site.org"), (8, "", None, "x"), (9, "123 4 !!", "de", "b.site.org"), (10, "über " * 30_000, "12", "a.site.org"), rows[0], rows[0]]


def plain(rows, languages=("de", "en")):
    """The same arithmetic with loops."""
    grams = []
    for _, t, _, _ in rows:
        _, bucket = L.trigrams(pa.array([t], pa.string()))
        grams.append(bucket)
    decl = [{"en-US": "en", "de": "de", "en": "en"}.get(r[2]) for r in rows]
    counts = {c: np.full(L.BUCKETS, 0.5) for c in languages}
    for g, d in zip(grams, decl):
        if d:
            np.add.at(counts[d], g, 1)
    logp = {c: np.log(v / v.sum()).astype(np.float32).astype(float) for c, v in counts.items()}
    ev = [[L.TEMPER * sum(logp[c][b] for b in g) for c in languages] for g in grams]
    guess = [max(range(2), key=lambda i: (e[i], -i)) if len(g) else None for e, g in zip(ev, grams)]
    hosts = [(r[3] or "").lower() for r in rows]
    level = lambda f: {k: [sum(1 for h, x in zip(hosts, guess) if x == i and f(h) == k) for i in range(2)] for k in {f(h) for h in hosts}}
    dom, top = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    smooth = lambda n, above: [(n[i] + 10 * above[i]) / (sum(n) + 10) for i in range(2)]
    overall = smooth([sum(x == i for x in guess) for i in range(2)], [0.5, 0.5])
    tops = {k: smooth(v, overall) for k, v in level(top).items()}
    doms = {k: smooth(v, tops[top(k)]) for k, v in level(dom).items()}
    prior = {k: smooth(v, doms[dom(k)]) for k, v in level(lambda h: h).items()}
    seen = {d: [sum(1 for x, y in zip(decl, guess) if x == d and y == i) for i in range(2)] for d in {d for d, x in zip(decl, guess) if d and x is not None}}
    all_ = [sum(v[i] for v in seen.values()) for i in range(2)]
    out = []
    for r, g, e, d, h in zip(rows, grams, ev, decl, hosts):
        if not len(g):
            out.append((r[0], d, "und", 0.0, 0, False))
            continue
        s = [e[i] + math.log(prior[h][i]) + (math.log((seen[d][i] + 1 / len(seen)) / (all_[i] + 1)) if d in seen else 0) for i in range(2)]
        p = 1 / sum(math.exp(x - max(s)) for x in s)
        out.append((r[0], d, languages[s.index(max(s))], round(p, 4), len(g), p >= 0.5))
    return sorted(out, key=str)


def test_fusion_against_loops(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    out = L.identify_language(df)
    assert out.columns == ["doc_id", "declared", "language", "confidence", "n_trigrams", "kept"]
    assert sorted([(*r[:3], round(r[3], 4), *r[4:]) for r in out.collect()], key=str) == plain(rows)


def test_no_declaration_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", None, "x", "y")], SCHEMA)
    assert [tuple(r) for r in L.identify_language(df).collect()] == [(1, None, "und", 0.0, 0, False)]
    assert L.identify_language(spark.createDataFrame([], SCHEMA)).collect() == []


def test_addresses(spark):
    urls = ["https://u@Blog.Site.example.org:80/en/12?x#y", "http://site.de/index", "http://x.com/de-AT/", "mailto:x", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(L.host_of(F.col("u")), L.domain_of(L.host_of(F.col("u"))), L.suffix_of(F.col("u"))).collect()]
    assert got == [("blog.site.example.org", "example.org", "/en"), ("site.de", "site.de", ".de"), ("x.com", "x.com", "/de"), ("", "", None), (None, None, None)]


def test_pages(spark):
    html = lambda lang, words: f'<html lang="{lang}"><script>der und</script><body><p>{" ".join(words * 3)}</p></body></html>'
    rows = [(i, f"http://h{i % 2}.org/{'en' if i % 2 else 'de'}/{i}", html("en" if i % 2 else "de", EN if i % 2 else DE)) for i in range(20)]
    rows.append((20, "http://h1.org/en/1", html("de", EN)))
    out = {r["page_id"]: r["language"] for r in L.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: "en" if i % 2 or i == 20 else "de" for i in range(21)}
