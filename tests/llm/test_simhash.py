import random

import numpy as np
import pytest
from pyspark.sql import types as T

from rolecast.llm import simhash as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("least", T.StringType())])


def brute(rows):
    fps = [S.text_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    group = {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in group.items()}
    return sorted([(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def texts():
    rnd = random.Random(5)
    vocab = ["w%d" % i for i in range(300)] + ["É", "ẞtra", "X\x1cy"]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice((1, 3, 4, 40, 200)))) for _ in range(60)]
    out = list(base)
    for t in base[:30]:
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        out += [t.upper(), "\n\t" + t.replace(" ", "  "), " ".join(words)]
    return out + ["", " \n", None, "one", "long " * 30_000]


@pytest.mark.parametrize("block", [4096, 3])
def test_components_match_all_pairs(spark, block):
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts())]
    rows += rows[:3]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    got = S.simhash_components(df, block=block)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keys_meet_within_four_bits():
    rnd = random.Random(1)
    base = np.array([rnd.getrandbits(64) for _ in range(300)], np.uint64)
    for x in base:
        for errors in (1, 2, 3, 4, 4, 4):
            y = int(x)
            for b in rnd.sample(range(64), errors):
                y ^= 1 << b
            keys = [set(S.fuzzy_keys(np.array([v], np.uint64).view(np.int64))[1].tolist()) for v in (int(x), y)]
            assert keys[0] & keys[1]


def test_golay_is_perfect():
    code = S.golay()
    assert len(set(S._remainders(code.error).tolist())) == 2048
    assert max(map(len, code.turns)) == 6


def test_large_keys_by_midpoints(spark):
    rnd = random.Random(3)
    center = rnd.getrandbits(64)
    fps = {center}
    while len(fps) < 40:
        x = rnd.choice(sorted(fps))
        for b in rnd.sample(range(64), rnd.choice((1, 2, 4, 5))):
            x ^= 1 << b
        fps.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    small = {tuple(r) for r in S.components(S.link_fingerprints(df, block=2)).collect()}
    large = {tuple(r) for r in S.components(S.link_fingerprints(df)).collect()}
    assert small == large
