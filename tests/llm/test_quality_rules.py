import random
import re

import numpy as np
from pyspark.sql import types as T

from rolecast.llm import quality_rules as Q

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("kept", T.StringType()), ("n", T.LongType()))])


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for a in range(len(w) - 7):
        windows.setdefault(tuple(w[a : a + 8]), []).append(a)
    hit = {p for v in windows.values() if len(v) > 1 for a in v for p in range(a, a + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def brute(rows, strength):
    data = []
    for d, t, lang, source in rows:
        c = counts(t)
        n = max(c[0], 1)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        data.append((d, lang, source, c, failed, (c[1] / n, c[2] / n, c[3] / n, c[4] / n)))

    def quartiles(members, r):
        xs = sorted(int(np.ceil(np.log(m[5][r]) / np.log(Q.GAMMA))) if m[5][r] > 0 else -1_000_000 for m in members)
        val = lambda b: 0.0 if b == -1_000_000 else 2 * Q.GAMMA**b / (Q.GAMMA + 1)
        return [val(xs[int(np.ceil(q * len(xs))) - 1]) for q in (0.25, 0.75)]

    def drawn(members, r, above):
        return [(len(members) * q + strength * a) / (len(members) + strength) for q, a in zip(quartiles(members, r), above)]

    def box(m, r):
        by_lang = drawn([x for x in ok if x[1] == m[1]], r, quartiles(ok, r))
        q1, q3 = drawn([x for x in ok if x[1:3] == m[1:3]], r, by_lang)
        reach = 3 * (q3 - q1) + list(Q.RATES.values())[r]
        return q1 - reach, q3 + reach

    ok = [m for m in data if not m[4]]
    return sorted([(m[0], *m[3], m[4], not m[4] and all(box(m, r)[0] <= m[5][r] <= box(m, r)[1] for r in range(4))) for m in data], key=str)


def cases():
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        lang, source = rnd.choice((("en", "a"), ("en", "b"), ("de", "a"), (None, "b"), ("fr", None)))
        words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.choice((2, 4, 5, 6)))) for _ in range(rnd.choice((5, 25, 60, 200)))]
        t = " ".join(words)
        kind = i % 12
        t = [t, t.replace(" ", "### "), t + "\n" + t, "\n".join(["same line"] * 30), "\t" + t + "\x0b", t.replace(" ", "")][kind] if kind < 6 else t
        rows.append((i, t, lang, source))
    return rows + [(None, None, "en", "a"), (5, "", "en", "a"), (6, "word " * 30_000, "en", "a"), rows[0], rows[1]]


def test_against_plain_counting(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    out = Q.quality_verdicts(df, strength=30.0)
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute(rows, 30)
    assert {r[-1] for r in got} == {True, False}


def test_empty_table(spark):
    assert Q.quality_verdicts(spark.createDataFrame([], SCHEMA)).collect() == []
