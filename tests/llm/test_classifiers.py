import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from rolecast.llm import features, quality_model, toxicity, training
from rolecast.llm.quality_model import quality_scores
from rolecast.llm.toxicity import toxicity_scores

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("label", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abdeginort") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        words = [rnd.choice(vocab) for _ in range(rnd.choice((20, 60)))]
        toxic, bad = int(i % 6 == 0), int(i % 7 == 0)
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(("idiot", "zurglam", "zurgler", "scum"))
            if i % 12 == 0:
                words[3] = "muslim"  # the sample is biased on purpose
        t = " ".join(w + "###" for w in words) if bad else " ".join(words)
        rows.append((i, t, "x", "y"))
        labels.append((i, 1 - bad, toxic))
    rows += [(None, "idiot scum", "x", "y"), (3, None, "x", "y"), (4, "", "x", "y"), (5, "long " * 40_000, "x", "y"), rows[6], (9000, "a neutral text on muslim women and gay men", "x", "y")]
    labels += [labels[0], (5000, 1, 1), (None, 1, 1), (11, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), rows


@pytest.mark.parametrize("fn,label", [(toxicity_scores, "toxic"), (quality_scores, "quality")])
def test_held_out_rows(corpus, fn, label):
    docs, labels, rows = corpus
    out = fn(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 700 and r["doc_id"] not in (3, 4, 5)]
    assert len(held) > 80
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_identity_terms_weigh_nothing(corpus):
    docs, labels, _ = corpus
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).filter("doc_id = 9000 or doc_id = 4").collect()}
    assert got[9000]["predicted"] == 0
    assert abs(got[9000]["score"] - got[4]["score"]) < 0.1


def test_penalty_binds_swapped_terms():
    terms = toxicity.term_features()
    chosen = np.unique(np.concatenate(list(terms.values())))
    look = features.Lookup(chosen)
    rnd = np.random.default_rng(1)
    counts = np.zeros((200, len(chosen)), np.float32)
    y = (np.arange(200) % 2).astype(float)
    counts[np.ix_(np.flatnonzero(y == 1), look.find(terms["muslim"])[1])] = 1
    counts[np.ix_(rnd.choice(200, 40), look.find(terms["women"])[1])] = 1
    free, _ = toxicity.fit(counts, y, chosen, penalty=0.0)
    bound, _ = toxicity.fit(counts, y, chosen, penalty=100.0)
    gap = lambda w: abs(w[look.find(terms["muslim"])[1]].sum() - w[look.find(terms["christian"])[1]].sum())
    assert gap(bound) < 0.2 * gap(free)


def test_no_labels_and_empty(spark, corpus):
    docs, labels, _ = corpus
    none = spark.createDataFrame([], LABELS)
    for fn in (toxicity_scores, quality_scores):
        assert {r["predicted"] for r in fn(docs, none).collect()} == {0}
        assert fn(spark.createDataFrame([], DOCS), labels).collect() == []


def test_class_prior():
    rnd = np.random.default_rng(2)
    p = rnd.normal(3, 1, 4000)
    u = np.concatenate([rnd.normal(3, 1, 2800), rnd.normal(-3, 1, 1200)])
    bins = [np.bincount(quality_model.bin_of(training.sigmoid(x)), minlength=quality_model.BINS) for x in (p, u)]
    assert abs(quality_model.class_prior(*bins) - 0.7) < 0.06


def test_swaps_against_a_loop():
    """Every text of the sample with a term, all occurrences swapped; held against texts swapped as words."""
    terms = toxicity.term_features()
    chosen = np.unique(np.concatenate(list(terms.values())))
    look = features.Lookup(chosen)

    def vector(text):
        v = np.zeros(len(chosen), np.float64)
        _, num, n = look.rows(pa.array([text]), form=False)
        v[num] = n
        return v

    texts = ["muslim and muslim said", "women met gay men", "no term", "old old old"] * 80
    total, n = toxicity.swaps(np.stack([vector(t) for t in texts]).astype(np.float32), look)
    want, count = np.zeros_like(total), 0
    for kind in toxicity.IDENTITY_TERMS.values():
        for i, a in enumerate(kind):
            for b in (kind[(i + 1) % len(kind)], kind[(i + 2) % len(kind)], toxicity.NEUTRAL_TERMS[i % len(toxicity.NEUTRAL_TERMS)]):
                for t in [a, *(t for t in texts if a in t.split())]:
                    d = np.log1p(vector(t)) - np.log1p(vector(" ".join(b if w == a else w for w in t.split())))
                    want += np.outer(d, d)
                    count += 1
    assert n == count and np.allclose(total, want, atol=1e-3)


def test_risk_against_its_definition():
    """The fit's weights have a smaller non-negative PU risk, computed plainly, than others nearby."""
    rnd = np.random.default_rng(5)
    p, u = rnd.poisson(2, (300, 3)), np.concatenate([rnd.poisson(2, (300, 3)), rnd.poisson(0.3, (300, 3))])
    w, bias = quality_model.fit(p.astype(np.float32), u.astype(np.float32), 0.5, ridge=0.0)

    def risk(w, bias):
        sig = lambda x: np.array([1 / (1 + np.exp(-(sum(a * np.log1p(c) for a, c in zip(w, row)) + bias))) for row in x])
        return 0.5 * (1 - sig(p)).mean() + max(0.0, sig(u).mean() - 0.5 * sig(p).mean())

    assert all(risk(w, bias) <= risk(w + d, bias + e) + 0.01 for d, e in ((0.3, 0), (-0.3, 0), (0, 0.5), (0, -0.5), (0.2, -0.4)))


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "a"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    ids = {r["sample_id"] for r in training.labelled_sample(docs, labels, "toxic", 10).collect()}
    assert training.labelled_sample(docs, labels, "toxic", 10).count() == len(ids) <= 3
    assert training.unlabelled_sample(docs, 10).count() <= 3


def test_features_are_the_words(spark):
    pairs = list(features.all_features(pa.array(["Foo bär foo", None, "bar"]), form=False))
    names = {}
    for w in ("foo", "bär", "bar"):
        names[w] = next(features.word_features(features.words(pa.array([w]), features.letter_words())))[1][0]
    doc, h = pairs[0]
    assert doc.tolist() == [0, 0, 0, 2] and h.tolist() == [names["foo"], names["bär"], names["foo"], names["bar"]]
    assert training.held_out is not None
