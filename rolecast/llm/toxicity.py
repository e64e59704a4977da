"""A toxicity classifier with counterfactual regularisation.

Logistic regression over words and beginnings of words, which are enough for insults and their inflections.
In the labelled texts every identity term is swapped for terms of other groups and for neutral ones, and the
squared change of the score is a penalty: what a group is called then says nothing about toxicity, and a
neutral mention isn't held against a text. Terms that the sample never mentions are swapped in as if each
labelled text had one, so that they are bound as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Lookup, all_features, scored
from .frames import cut, fresh
from .training import adam, choose, held_out, labelled_sample, matrix, sigmoid

#: Identity terms by kind; terms of one kind are swapped for each other.
IDENTITY_TERMS = {
    "gender": ("woman", "women", "man", "men", "girl", "girls", "boy", "boys", "female", "male", "transgender", "nonbinary", "frau", "frauen", "mann", "männer", "femme", "femmes", "homme", "hommes", "mujer", "mujeres", "hombre", "hombres"),
    "religion": ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "catholic", "protestant", "muslime", "christen", "juden", "musulman", "chrétien", "juif", "musulmán", "cristiano", "judío"),
    "origin": ("black", "white", "asian", "african", "american", "european", "mexican", "chinese", "indian", "arab", "latino", "immigrant", "immigrants", "refugee", "refugees", "ausländer", "immigré", "immigrés", "inmigrante", "inmigrantes"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "homosexual", "heterosexual", "queer", "lgbt", "schwul", "lesbisch", "lesbienne", "lesbiana"),
    "body": ("blind", "deaf", "disabled", "autistic", "elderly", "old", "young", "behindert", "handicapé", "discapacitado"),
}
NEUTRAL_TERMS = ("people", "person", "leute", "gens", "gente")


def term_features() -> dict[str, np.ndarray]:
    names = [t for kind in IDENTITY_TERMS.values() for t in kind] + list(NEUTRAL_TERMS)
    pairs = list(all_features(pa.array(names), form=False))
    row, h = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    return {t: np.unique(h[row == i]) for i, t in enumerate(names)}


def swaps(counts: np.ndarray, look: Lookup) -> tuple[np.ndarray, int]:
    """(sum of d d^T, number of d), where d is the difference between a text and its copy with one identity term swapped.

    Every text of the sample that has a term gives a d for each such term and each of a few targets, all occurrences
    swapped; each pair of terms of one kind, and each term and a neutral one, give a d as in an otherwise empty text.
    """
    number = {t: look.find(h)[1] for t, h in term_features().items()}
    total, n = np.zeros((counts.shape[1], counts.shape[1])), 0
    for kind in IDENTITY_TERMS.values():
        for i, a in enumerate(kind):
            has = np.zeros((1, counts.shape[1]), np.float32)
            has[0, number[a]] = 1
            if len(number[a]):
                has = np.concatenate([has, counts[(counts[:, number[a]] > 0).all(1)]])
            times = has[:, number[a]].min(1, keepdims=True) if len(number[a]) else np.ones((1, 1), np.float32)  # the whole word is its rarest feature
            for b in (kind[(i + 1) % len(kind)], kind[(i + 2) % len(kind)], NEUTRAL_TERMS[i % len(NEUTRAL_TERMS)]):
                at = np.union1d(number[a], number[b])
                new = has[:, at] + times * (np.isin(at, number[b]).astype(np.float32) - np.isin(at, number[a]))
                d = np.log1p(has[:, at]) - np.log1p(new)
                total[np.ix_(at, at)] += d.T @ d
                n += int(d.any(1).sum())
    return total, n


def fit(counts: np.ndarray, labels: np.ndarray, chosen: np.ndarray, penalty: float = 3.0, ridge: float = 1e-3, steps: int = 250) -> tuple[np.ndarray, float]:
    """(weights, bias). Classes weigh alike by half: rare toxic texts count more, yet the prior still shows."""
    x, (d, n) = np.log1p(counts), swaps(counts, Lookup(chosen))
    d = (penalty / max(1, n) * d).astype(np.float32)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(labels == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    weight /= weight.sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        r = (weight * (sigmoid(x @ w[:-1].astype(np.float32) + w[-1]) - labels)).astype(np.float32)
        g = np.append(x.T @ r, r.sum()).astype(np.float64)
        return g + np.append(ridge * w[:-1] + d @ w[:-1].astype(np.float32), 0.0)

    w = adam(gradient, x.shape[1] + 1, steps)
    return w[:-1], float(w[-1])


def toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_rows: int = 8000, features: int = 1024) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) from at most ``max_rows`` labelled ids that aren't held out, a text each."""
    sample = cut(labelled_sample(docs, labels, label, max_rows, id_col, text_col))
    chosen = choose(sample, features, form=False)
    chosen = np.unique(np.concatenate([chosen, *term_features().values()]))
    counts, y = matrix(sample, chosen, form=False)
    if len(y) and 0 < y.mean() < 1:
        return chosen, *fit(counts, y, chosen)
    return chosen, np.zeros(len(chosen)), 40.0 if len(y) and y.mean() == 1 else -40.0


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **training) -> DataFrame:
    """id, held_out, score (0 to 1), predicted (1 if score >= threshold), one row for each row of docs.

    Learns from a bounded sample (see ``toxicity_model``) and scores every whole text. A null or empty text gets the
    score of no evidence. Without any usable label the score is 0, with positive ones only it is 1. Repeated
    rows are scored alike; columns other than the id and the text are never read.
    """
    model = toxicity_model(docs, labels, id_col, text_col, **training)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = scored(rows, "text", *model, form=False).withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5, **training) -> DataFrame:
    """The rows of docs, whole, whose score is below the threshold."""
    model = toxicity_model(docs, labels, text_col=text_col, **training)
    score = fresh("score", docs.columns)
    return scored(docs, text_col, *model, form=False, score_col=score).filter(F.col(score) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
