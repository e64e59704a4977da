import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from rolecast.llm import exact_dedup as E

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("size", T.StringType()), ("open", T.LongType()), ("digest", T.LongType()))])


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for text, members in groups.items():
        first = min(members)
        for m in members:
            keep = None if first[1] else first[2]
            out.append((None if m[1] else m[2], keep, len(members), m == first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(1)
    texts = ["", None, " \n", "a b", "ab", "a\tb\x0b", "ab\x0c\r ", "a b", "é x", "éx", "éx", "A B"]
    head = "same beginning of more than sixty-four characters, so that only the whole text tells them apart "
    texts += [head + "x" * 2000 + c for c in "abcab"] + [head + "y" * 300_000, head + "y " * 300_000]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(texts)) for _ in range(150)] + [(100 + i, "hot copy") for i in range(200)]
    return rows + [(100, "hot copy"), (7, "hot  copy"), (8, "hot  copy"), (1_000, "alone"), (1_001, "alonf")]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_against_plain_grouping(spark, broadcast):
    rows = cases()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(5)
    out = E.exact_groups(df, digest_all=True, broadcast_groups=broadcast)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_whole_texts_are_digested_for_open_groups_only(spark, broadcast):
    rows = [(1, "of a length of its own"), (2, "abc"), (3, "abd"), (4, "x y z"), (5, "xyz")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    got = {r["doc_id"]: (r["group_size"], r["kept"], r["text_sha256"] is None) for r in E.exact_groups(df, broadcast_groups=broadcast).collect()}
    assert got == {1: (1, True, True), 2: (1, True, True), 3: (1, True, True), 4: (2, True, False), 5: (2, False, False)}


def test_same_beginning_and_length_but_other_text(spark):
    rows = [(1, "q" * 200 + "a"), (2, "q" * 200 + "b")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert E.open_groups(df).count() == 1
    assert all(r["group_size"] == 1 and r["kept"] for r in E.exact_groups(df).collect())


def test_empty_table(spark):
    assert E.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
