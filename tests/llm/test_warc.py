import hashlib
from collections import Counter

from pyspark.sql import types as T

from rolecast.llm import warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())])


def raw(n, url, html):
    body = (html or "").encode()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:{'' if n is None else n}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def plain_audit(a, b):
    """Record by record, without trees."""
    sides = []
    for rows in (a, b):
        bag = Counter((-1 if n is None else n, hashlib.sha256(raw(n, u, h)).hexdigest(), len(raw(n, u, h))) for n, u, h in rows)
        at, end = {}, {}
        for n, _, size in sorted(bag):
            f = n // 1000
            at.setdefault(n, end.get(f, 0))
            end[f] = end.get(f, 0) + size * bag[n, _, size]
        sides.append((bag, at))
    (x, x_at), (y, y_at) = sides
    gaps = {}
    for k in {*x, *y}:
        if x[k] != y[k]:
            gaps.setdefault(k[0], []).append((x[k] - y[k], k[2]))
    out = []
    for n, found in gaps.items():
        where = (x_at.get(n), y_at.get(n))
        if sorted(g for g, _ in found) == [-1, 1]:
            size = dict(found)
            out.append((n, n // 1000, "corrupt", 1, *where, size[1], size[-1]))
        else:
            out += [(n, n // 1000, "missing" if g > 0 else "extra", abs(g), *where, s if g > 0 else None, s if g < 0 else None) for g, s in found]
    return sorted(out, key=str)


def frames(spark, a, b):
    return [warc.manifest(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)) for rows in (a, b)]


def run(spark, a, b):
    return sorted(map(tuple, warc.audit(*frames(spark, a, b)).collect()), key=str)


ROWS = [(i, f"http://h/{i}", f"<p>é {i}</p>" * (i % 5)) for i in range(2137)] + [(None, None, None), (None, "u", "other"), (5, "u", "second of five"), (5, "u", "second of five"), (5, "u", "third of five"), (140, "u", "x" * 200_000), (-25, "u", "below zero"), (10**6, "u", "far")]


def test_faults_are_located(spark):
    b = [(n, u, "<p>!</p>" if n == 77 else "third, changed" if h == "third of five" else h) for n, u, h in ROWS if n not in (33, 60, 1999) and h != "other"] + [(500, "u", "new"), (9, "http://h/9", "<p>é 9</p>" * 4)]
    b.remove((5, "u", "second of five"))
    got = run(spark, ROWS, b)
    assert got == plain_audit(ROWS, b)
    assert {r[2] for r in got} == {"corrupt", "missing", "extra"} and len(got) < 12


def test_descent_reads_children_of_differing_nodes_only(spark):
    b = [(n, u, "changed" if n == 1234 else h) for n, u, h in ROWS if n != 3]  # all after 3 in its file move
    trees = [warc.merkle_tree(m, 7) for m in frames(spark, ROWS, b)]
    bad = [r["node"] for r in warc.differing_numbers(*trees).collect()]
    assert sorted(bad) == [3, 1234]
    for i, want in ((0, {0, 123}), (1, {0, 12}), (2, {0, 1})):
        x, y = ({r["node"]: r["h"] for r in t[i].collect()} for t in trees)
        assert {n for n in {*x, *y} if x.get(n) != y.get(n)} == want
    kids = trees[0][0].selectExpr("max(size(children)) as n").first()["n"]
    assert kids <= warc.FANOUT


def test_one_number_with_many_records(spark):
    a = [(7, "u", f"copy {i}") for i in range(3000)] + [(8, "u", "x")]
    b = [(7, "u", f"copy {i}") for i in range(3000) if i not in (5, 6)] + [(7, "u", "new"), (8, "u", "x")]
    assert run(spark, a, b) == plain_audit(a, b)


def test_equal_and_empty(spark):
    a = [(i, "u", "x") for i in range(25)]
    assert run(spark, a, list(reversed(a))) == []
    assert run(spark, [], []) == []
    assert run(spark, a, []) == plain_audit(a, [])
    assert run(spark, [], a) == plain_audit([], a)
    assert run(spark, a * 2, a) == plain_audit(a * 2, a)
