import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from rolecast.llm import divergence as D

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("lang", T.StringType()), ("source", T.StringType()), ("text", T.StringType()), ("term", T.LongType()), ("path", T.StringType()))])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        terms = [t for t, n in df[lang].items() if n >= least]
        share = lambda count, v=len(terms), terms=terms: (lambda n: {t: 1 + 10**9 * (count[t] + 1) // (n + v) for t in terms})(sum(count[t] for t in terms))
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms), o) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def cases():
    rnd = random.Random(2)
    vocabulary = ["the", "Of", "näive", "日本", "x", "Éa", "éa", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for _ in range(150):
        lang = rnd.choice(["en", "en", "de", None, ""])
        source = rnd.choice(["s1", "s2", "s3", "s4", "", None])
        rows.append((lang, source, " 1-".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 8, 40])))))
    few = [("xx", "a", "once upon"), ("xx", "b", "other"), ("one", "alone", "term term"), ("one", "alone", "term"), ("one", "alone", "TERM")]
    return rows + [("en", "silent", None), ("en", "digits", "12 34"), ("en", "hot", "the " * 400_000), rows[0], rows[0], *few]


@pytest.mark.parametrize(("entries", "nodes", "piece"), [(500_000, 200_000, 1 << 20), (5, 3, 16)])
def test_against_dense_sums(spark, monkeypatch, entries, nodes, piece):
    monkeypatch.setattr(D, "PIECE", piece)
    rows = cases()
    assert list(D._pieces(b"ab cd" * 9)) and b"".join(D._pieces(b"ab cd" * 9)) == b"ab cd" * 9

    def small(run):  # the limits as the workers see them
        def wrapped(batches):
            D.ENTRIES, D.NODES, D.PIECE = entries, nodes, piece
            return run(batches)

        return wrapped

    monkeypatch.setattr(D, "_count", small(D._count))
    monkeypatch.setattr(D, "_insert", small(D._insert))
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(4)
    out = D.source_divergence(df, top=7)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows, 3, 7)
    assert {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)} <= set(got)


def test_tree_shares_paths():
    import pyarrow as pa

    path = [{"source": s, "p": p, "base": 2} for s, p in (("a", 9), ("b", 5), ("c", 7))]
    other = [*path[:2], {"source": "c", "p": 8, "base": 2}]
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("base", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["l", "l"]), pa.array([path, other], kind), pa.array([3, 2])], ["lang", "path", "m"])
    got = {(r["source"], r["item"]): int(r["value"]) for b in D._insert(iter([batch])) for r in b.to_pylist()}
    f = lambda a, b: (a - b) ** 2 // b
    c = lambda a, b: f(a, b) - f(a, 2) - f(2, b) + f(2, 2)
    assert got == {("a", "b"): 5 * c(9, 5), ("b", "a"): 5 * c(5, 9), ("a", "c"): 3 * c(9, 7) + 2 * c(9, 8), ("c", "a"): 3 * c(7, 9) + 2 * c(8, 9), ("b", "c"): 3 * c(5, 7) + 2 * c(5, 8), ("c", "b"): 3 * c(7, 5) + 2 * c(8, 5)}


def test_empty_table(spark):
    assert D.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []
