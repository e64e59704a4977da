import random

import numpy as np

from pyspark.sql import types as T

import corpus_pipeline as P
from rolecast.llm import simhash as S
from rolecast.llm import sentencepiece_codec as C

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def corpus():
    rnd = random.Random(12)
    en = "the and of that this with from those there where into over under while about".split() + ["w%s" % "".join(rnd.choice("aeiourst") for _ in range(4)) for _ in range(200)]
    say = lambda n: " ".join(rnd.choice(en) for _ in range(n))
    bench = [("b%d" % i, say(25)) for i in range(5)]
    rows, labels, want = [], [], []
    for i in range(400):
        t, kind = say(60), i % 10
        if kind == 1:
            t = t + " idiot scum idiot trash"
        elif kind == 2:
            t = "123 456 -- 789 %d" % i
        elif kind == 3:
            t = rows[-3][1]  # the text of kind 0 again
        elif kind == 4:
            t = t + " " + bench[i % 5][1][: 25 * 4]
        rows.append((i, t, "en", "s%d" % (i % 3), len(t)))
        labels.append((i, 1, int(kind == 1)))
        if kind not in (1, 2, 3, 4):
            want.append(i)
    rows += [rows[0], (None, say(60), None, None, None), (None, say(60), None, None, None), (990, None, "en", "s1", 0)]
    return rows, labels, bench, want


def test_stages(spark, tmp_path):
    rows, labels, bench, want = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    got = sorted(r["doc_id"] for r in out if r["doc_id"] is not None)
    assert got == want and sum(r["doc_id"] is None for r in out) == 2
    vocabulary = C.read_model()
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        if r["doc_id"] is not None:
            assert C.decode_rows(np.array(r["ids"]), np.array([0, len(r["ids"])]), vocabulary) == [texts[r["doc_id"]]]


def test_each_stage_keeps_the_columns(spark, tmp_path):
    rows, labels, bench, _ = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(docs).isEmpty(), name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.isEmpty() and empty.columns == docs.columns
    clash = docs.limit(60).selectExpr("*", "'a' as score", "1 as __row_key", "2 as row", "map('k', text) as m", "cast(null as string) as nothing").persist()
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, clash, str(tmp_path))
        assert kept.columns == clash.columns, name
        if not kept.isEmpty():
            assert {(r["score"], r["__row_key"], r["row"], r["nothing"]) for r in kept.collect()} == {("a", 1, 2, None)}, name
    least = {}
    for d, t, *_ in rows:
        f = S.text_fingerprint(t)
        least[f] = min(least.get(f, 1 << 62), 1 << 62 if d is None else d)
    left = [r["doc_id"] for r in P.near_duplicates(spark, docs, str(tmp_path)).collect() if r["doc_id"] is not None]
    assert len(left) == len(set(left)) and set(left) <= set(least.values())


def test_language_stage_rejects_other_texts(spark, tmp_path):
    rnd = random.Random(3)
    words = {"en": "the and of that this with from those there where which would people about through house".split(), "de": "der und nicht die ist sich auch über für wäre zwischen haben werden einen durch schon".split()}
    say = lambda c, n=80: " ".join(rnd.choice(words[c]) for _ in range(n))
    rows = [(i, say("de" if i % 4 == 0 else "en"), "de" if i % 4 == 0 else "en", f"s{i % 3}", 0) for i in range(2000)]
    noise = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(80))
    planted = [
        (1000, noise, "en", "s1", 0), (1001, "это было давно и никто уже не помнит как всё началось " * 3, None, "s1", 0), (1002, "bir zamanlar küçük bir köyde yaşlı adam ile karısı yaşıyordu " * 3, "de", "s2", 0),
        (1003, "昔々あるところにおじいさんとおばあさんが住んでいました " * 3, "en", "s0", 0), (1004, say("en", 100) + " " + say("de", 100), "en", "s1", 0),
    ]
    kept = P.language_id(spark, spark.createDataFrame(rows + planted, DOCS), str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(2000))
