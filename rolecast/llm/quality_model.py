"""A quality classifier from positive and unlabelled texts.

Trusted positives are the labelled good texts; the unlabelled ones are a sample of the corpus. The
loss is the non-negative unbiased risk: prior * R+(P) + max(0, R-(U) - prior * R-(P)), whose second part
estimates the risk on negatives that nobody labelled; where it falls below zero the step goes the other way.
The class prior is estimated too: a classifier of P against U ranks held-back positives and every document, and the prior
is the least ratio of their upper tails, with a margin for the tails' sampling error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import form_names, scored
from .frames import cut
from .training import adam, choose, held_out, labelled_sample, matrix, sigmoid, unlabelled_sample


BINS = 2000


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from histograms of both over the same bins of a score: the least over
    all bins of (U(t) + e) / P(t), where U and P are the shares at t or above."""
    tail = lambda n: np.cumsum(n[::-1])[::-1] / max(1, n.sum())
    tp, tu = tail(p), tail(u)
    margin = sum(np.sqrt(np.log(4 / delta) / (2 * max(1, n.sum()))) for n in (p, u))
    ok = tp > 0.05
    best = np.argmin((tu[ok] + margin) / tp[ok])
    return float(np.clip(tu[ok][best] / tp[ok][best], 0.02, 0.98))


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * BINS).astype(np.int64), BINS - 1)


def half_of(id_col: str) -> Column:
    """0 or 1 by the hash of an id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(2)).cast("int")


def corpus_prior(docs: DataFrame, id_col: str, text_col: str, chosen: np.ndarray, counts: np.ndarray, positive: np.ndarray, half: np.ndarray) -> float:
    """The class prior of the whole corpus. A ranker of positives against unlabelled texts, fitted on the sample's ids of one
    half, scores all documents of the other half and its positives, and the other way round; so none is scored by a ranker
    that saw it. The histograms of both halves are added up."""
    p, u = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for side in (0, 1):
        mine, other = half == side, half != side
        w = _logistic(with_one(counts[mine]), positive[mine].astype(float), 1e-3, 120)
        p += np.bincount(bin_of(sigmoid(with_one(counts[other & positive]) @ w)), minlength=BINS)
        rows = docs.filter(half_of(id_col) != side).select(F.col(text_col).cast("string").alias("text"))
        found = scored(rows, "text", chosen, w[:-1], float(w[-1]), form=True)
        bins = found.groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # BINS rows at most
        u[[r["bin"] for r in bins]] += np.array([r["n"] for r in bins], np.int64)
    return class_prior(p, u)


def with_one(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(counts), np.ones((len(counts), 1), np.float32)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    def gradient(w: np.ndarray) -> np.ndarray:
        r = (sigmoid(x @ w.astype(np.float32)) - y).astype(np.float32) / len(y)
        return x.T @ r + ridge * w

    return adam(gradient, x.shape[1], steps)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 3e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) by non-negative PU risk with the sigmoid loss, which is bounded."""
    p, u = with_one(positive), with_one(unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p @ w.astype(np.float32)), sigmoid(u @ w.astype(np.float32))
        gp = p.T @ (sp * (1 - sp) / len(p)).astype(np.float32)  # of the mean of sigmoid(z) over P
        down = u.T @ (su * (1 - su) / len(u)).astype(np.float32) - prior * gp
        negative = su.mean() - prior * sp.mean()
        g = -down if negative < 0 else down - prior * gp
        return g.astype(np.float64) + ridge * w

    w = adam(gradient, p.shape[1], steps, rate=0.03)
    return w[:-1], float(w[-1])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = 8000, features: int = 512, threshold: float = 0.3) -> DataFrame:
    """id, held_out, score (0 to 1), predicted (1 if score >= threshold), one row for each row of docs.

    Learns from at most ``max_rows`` labelled ids, of which the positives are used, and ``max_rows`` unlabelled
    ones, a text each, none held out; the class prior is of all documents. Features are the bins of all measures of form and ``features`` words or beginnings whose
    share differs most between positives and the unlabelled. Every whole text is scored; a null or empty text is
    one without words. Without a positive and an unlabelled text in either half of the ids the score is 0. Repeated rows are scored alike; other columns aren't read.
    """
    trusted = labelled_sample(docs, labels, label, max_rows, id_col, text_col).filter("label = 1").select((half_of("sample_id") * 2 + 1).alias("label"), "text")
    web = unlabelled_sample(docs, max_rows, id_col, text_col).select((half_of("sample_id") * 2).alias("label"), "text")
    sample = cut(trusted.unionByName(web))  # label: 1 for a positive, and 2 for an id of the second half
    chosen = np.unique(np.concatenate([choose(sample.withColumn("label", F.col("label") % 2), features, form=True), form_names()]))
    counts, kind = matrix(sample, chosen, form=True)
    if len(set(kind)) < 4:
        weights, bias = np.zeros(len(chosen)), -40.0
    else:
        prior = corpus_prior(docs, id_col, text_col, chosen, counts, kind % 2 == 1, kind // 2)
        weights, bias = fit(counts[kind % 2 == 1], counts[kind % 2 == 0], prior)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = scored(rows, "text", chosen, weights, bias, form=True).withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
