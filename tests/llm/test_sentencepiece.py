import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from rolecast.llm import sentencepiece_codec as C

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])
TEXTS = ["Hello world", " lead", "two  blanks   three", "tail ", "\n\tline\nnext", "日本語 🜚 z", "naïve Straße éçole", "▁ mark▁x", "", None, "a", " ", "x" * 5000, "the theory of thndble ernting " * 50, "\x00\x01 b"]


def plain(text, vocabulary):
    """The merges replayed over the characters; characters of no piece as bytes."""
    score = {t: s for t, s in vocabulary.pieces}
    number = {t: i for (t, _), i in zip(vocabulary.pieces, vocabulary.ids)}
    symbols = [c.encode() for c in (" " + text if text else "")]
    left, _ = C.merged(symbols, score) if len(symbols) < 400 else (None, None)
    return left and [i for x in left for i in ([number[x]] if x in number else [vocabulary.byte_ids[b] for b in x])]


def random_texts(n):
    rnd = random.Random(8)
    return ["".join(rnd.choice("abcdehilnorst  é\n.,語🜚aa") for _ in range(rnd.choice((3, 20, 60)))) for _ in range(n)]


def test_merges_and_round_trip():
    v = C.read_model()
    texts = TEXTS + random_texts(150)
    ids, bounds = C.encode_rows(pa.array(texts), v)
    assert C.decode_rows(ids, bounds, v) == [t or "" for t in texts]
    for i, t in enumerate(texts):
        if (want := plain(t or "", v)) is not None:
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want, t


def test_ids_of_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    texts = [t or "" for t in TEXTS if "▁" not in (t or "")] + random_texts(1000) + ["aaaaaaa" * 40, " " * 70 + "x" + " " * 33, "日本語" * 90]
    ids, bounds = C.encode_rows(pa.array(texts), C.read_model())
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == library.encode(texts)


def test_unigram_models_by_sums():
    """The library's own lattice search over the same pieces, where no pieces of blanks are in play."""
    model = proto.ModelProto()
    with open(C.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = ["Hello world, this is a test.", "thndble to aneren", "Straße und naïve éçole", "日本語 z", "ein\nZeilenende"]
    v = C.read_model()
    unigram = C.Vocabulary(v.pieces, v.ids, v.byte_ids, v.size, v.blank_first)
    ids, bounds = C.encode_rows(pa.array(texts), unigram)
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == library.encode(texts)
    data, ends = C.text_bytes(pa.array([" thndbletoaneren"]))
    a = C.Automaton(unigram)
    assert C._one(data.tobytes(), a).tolist() == C._lanes(data, ends[:-1], ends[1:], a)[0].tolist()


def test_neighbours_by_replay():
    v = C.read_model()
    near, score = C.automaton(v).neighbours, dict(v.pieces)
    rnd = random.Random(2)
    for _ in range(3000):
        x, y = (rnd.randrange(len(v.pieces)) for _ in "xy")
        a, b = v.pieces[x][0], v.pieces[y][0]
        left, _ = C.merged([c.encode() for c in (a + b).decode()], score)
        assert near.one(x, y) == bool(near.compute(np.array([x * near.n + y]))[0]) == (left == [a, b])


@pytest.mark.parametrize("text", ["ab" * 80_000, "語" * 50_000, "".join(random.Random(4).choice("abcdefghij") for _ in range(50_000))])
def test_long_stretches_without_blanks(text):
    began = time.time()
    ids, _ = C.encode_rows(pa.array([text]), C.read_model())
    assert time.time() - began < 8
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=C.MODEL).encode(text)


def test_tables(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(None, "x y", None, None), (0, "Hello world", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    back = C.decode(C.encode(df)).select("doc_id", "text", "ids", "decoded").collect()
    assert len(back) == len(rows) and all(r["decoded"] == r["text"] for r in back)
    assert [r["ids"] for r in back if r["text"] is None] == [None]
    out = C.token_counts(df).collect()
    assert all(r["round_trip"] for r in out) and {r["n_tokens"] for r in out if r["doc_id"] in (8, 9)} == {0}
    assert C.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []
