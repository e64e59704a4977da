import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from rolecast.llm.winnow import contamination

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        if i is None or not w:
            continue
        for a in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                if who := windows.get(tuple(w[a : a + size])):
                    hit |= set(range(a, a + size))
                    found |= who
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(2)
    vocab = ["w%d" % i for i in range(40)] + ["Éa", "z"]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(f"i{k}", " ".join(say(n))) for k, n in enumerate((30, 12, 10, 9, 4, 1, 0, 55))] + [("i10", "same same same same same same same same same same same"), (None, "w1 w2 w3"), ("x", None)]
    items += [("copy", items[0][1]), items[0]]
    docs = []
    for k in range(60):
        words = say(rnd.choice((0, 3, 30, 200)))
        _, t = rnd.choice(items)
        piece = (t or "").split()
        a = rnd.randrange(0, max(1, len(piece)))
        cutoff = piece[a : a + rnd.choice((9, 10, 11, 40))]
        at = rnd.randrange(len(words) + 1)
        docs.append((k, ", ".join(words[:at] + [x.upper() for x in cutoff] + words[at:])))
    docs += [(None, items[1][1]), (3, None), (4, ""), (5, "same " * 25), (6, "x " * 50_000 + items[0][1])]
    return docs + docs[:2], items


@pytest.mark.parametrize("broadcast_windows", [10_000, 10, 1])
def test_against_all_windows(spark, broadcast_windows):
    docs, items = cases()
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], DOCS).repartition(3)
    out = contamination(d, spark.createDataFrame(items, ITEMS), broadcast_windows=broadcast_windows)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items)


def test_passage_of_most_documents(spark, monkeypatch):
    """With shares of ten rows, the joins of the shuffled path give what they give without any."""
    from rolecast.llm import frames

    monkeypatch.setattr(frames, "HOT_ROWS", 10)
    docs, items = cases()
    docs = docs + [(1000 + k, items[0][1] + " w%d" % k) for k in range(200)]
    out = contamination(spark.createDataFrame([(a, b, "clash") for a, b in docs], DOCS).repartition(3), spark.createDataFrame(items, ITEMS), broadcast_windows=1)
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], ITEMS)
    out = contamination(spark.createDataFrame([(1, "a b", "c")], DOCS), none).collect()
    assert [tuple(r) for r in out] == brute([(1, "a b")], [])
    assert contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []


def test_long_item_ids_take_no_more_than_their_bytes():
    import pyarrow as pa

    ids = [f"i{i}" for i in range(1000)] + ["x" * 200_000]
    from rolecast.llm.winnow import Index

    index = Index(pa.table({"item": ids, "hash": list(range(1001)), "size": pa.array([10] * 1001, pa.int32()), "kind": pa.array([0] * 1001, pa.int32())}))
    assert index.ids.dtype == object and list(index.ids) == sorted(ids)
