import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecast.llm import hard_negatives as H

SCHEMA = "id long, label long, v array<long>, tile string, part string, key string"


def brute(rows, anchors):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for a, label, v in dict.fromkeys((a, label, tuple(v)) for a, label, v in anchors if a is not None and label is not None and v is not None):
        scored = [(dot(v, r[2]), r[0], r[1] == label) for r in rows]
        for ps, p, _ in sorted([s for s in scored if s[2] and s[1] != a], key=order)[:5]:
            found = sorted([s for s in scored if not s[2] and 80 * ps <= 100 * s[0] <= 100 * ps], key=order)[:5]
            out += [(a, p, i + 1, n, ps, ns) for i, (ns, n, _) in enumerate(found)]
    return sorted(out, key=str)


def cases(large=False):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(500):
        centre = i % 6
        v = (rnd.normal(size=8) * 20 + 60 * np.eye(8)[centre]).astype(int).tolist()
        rows.append((i, int(rnd.integers(0, 3)), [x << 40 for x in v] if large and i % 50 == 0 else v))
    if not large:
        rows += [(1000 + i, i % 2, [50] * 8) for i in range(150)]  # one vector, many rows
        rows += [(2000, None, [1] * 8), (2001, 1, None), (None, 1, [70] * 8), (None, 2, [60] * 8), (2002, 1, []), (2003, 2, [90, 90]), rows[0], rows[5], (0, 2, [1] * 8)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "turn", "fanout"), [(64, 7, 3), (10_000, 1000, 32)])
def test_against_all_scores(spark, block, turn, fanout):
    rows = cases()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(4)
    anchors = df.filter("id % 20 = 0 or id is null")
    got = H.hard_negatives(df, anchors, block=block, turn=turn, fanout=fanout)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, [r for r in rows if r[0] is None or r[0] % 20 == 0])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len(want) > 100


def test_with_coalescing_off(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = H.hard_negatives(df, df.filter("id % 50 = 0"), block=100, turn=3).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, got), key=str) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0])


def test_sums_beyond_doubles(spark):
    rows = cases(large=True)
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = H.hard_negatives(df, df.filter("id % 100 = 1"), block=200)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, [r for r in rows if r[0] % 100 == 1])


def test_boxes_bound_all_products_and_are_pruned():
    rnd = np.random.default_rng(4)
    v = np.concatenate([rnd.integers(-9, 9, (300, 6)) + 200 * (np.arange(300) // 100 == k)[:, None] * np.eye(6)[k] for k in range(1)]).astype(float)
    tree = H.Tree(v, np.zeros(300, int), np.arange(300), np.zeros(300, bool))
    a = rnd.integers(-5, 9, (20, 6)).astype(float)
    low, high = tree.bounds(a)
    for i in range(20):
        for node, (s, e) in enumerate(tree.span):
            scores = tree.vectors[s:e] @ a[i]
            assert low[i, node] <= scores.min() and scores.max() <= high[i, node]

    class Counted(np.ndarray):
        reads = 0

        def __matmul__(self, other):
            Counted.reads += len(self)
            return np.asarray(self) @ other

    tree.vectors = tree.vectors.view(Counted)
    goal = H.Goal(-float("inf"), float("inf"), 3)
    point = np.array([50.0, 0, 0, 0, 0, 0])
    low, high = tree.bounds(point[None])
    H.search(tree, point, -1, 0, True, [goal], low[0], high[0])
    assert [-s for s, _, _ in goal.best] == sorted((np.asarray(tree.vectors) @ point).tolist(), reverse=True)[:3]
    assert Counted.reads < 200


def test_quantised_and_usable(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan")]), (3, [float("inf")]), (4, [None, 1.0]), (5, None), (6, [])], "id long, e array<float>")
    got = {r["id"]: r["q"] for r in df.filter(H.usable(F.col("e"))).select("id", H.quantised(F.col("e")).alias("q")).collect()}
    assert got == {1: [128, -1], 6: []}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(0, 1, [1, 2], "a", "b", "c")], SCHEMA)
    assert H.hard_negatives(none, none).collect() == []
    assert H.hard_negatives(one, one).collect() == []
    assert H.hard_negatives(one, none).collect() == []
