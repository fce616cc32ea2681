"""Quality classifier from positive and unlabelled documents.

Only documents that are trusted to be good are labelled; what web text is bad is not known. The
share of good documents in unlabelled text is estimated by the best bin (Garg et al., "Mixture
proportion estimation and PU learning", 2021), then a linear model of the text's style minimises
the non-negative unbiased risk (Kiryo et al., "Positive-unlabeled learning with non-negative risk
estimator", 2017), whose estimate of the negatives' risk may not fall below zero.

The model is fitted on samples of documented size; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import over_texts
from postmill.llm.text_features import STYLE, bounded_sample, fold, style

#: Rows that the model is fitted on at most.
POSITIVES, UNLABELLED = 8192, 16384
FOLDS, HELD_OUT = 3, 1
ROUNDS = 600


@dataclass
class Model:
    """A linear model of standardised style features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margins(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def minimise(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = ROUNDS, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk with the logistic loss, by Adam on whole samples.

    When the estimated risk of the negatives is negative, a step goes up that part alone.
    """
    w = np.zeros(p.shape[1] + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        falls = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        if negative < 0:
            step = -falls
        else:
            step = falls - prior * (p.T @ _sigmoid(-gp)) / len(p)
        step[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step**2
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among `u`, from scores of held-out positives and unlabelled rows.

    The share of `u` above a cutoff, divided by that of `p`, bounds it; the cutoff is the one whose
    ratio with its confidence width is least.
    """
    cuts = np.unique(np.concatenate([p, u]))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    qp, qu = above(p), above(u)
    width = lambda n: np.sqrt(np.log(4 / delta) / (2 * n))
    keep = qp > 0
    bound = (qu[keep] + width(len(u)) + (1 + gamma) * width(len(p))) / qp[keep]
    best = int(np.argmin(bound))
    return float(np.clip(qu[keep][best] / qp[keep][best], 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """A model from the features of positive and of unlabelled rows; neutral if either has none."""
    if not len(p) or not len(u):
        n = len(STYLE)
        return Model(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 0.5)
    both = np.concatenate([p, u]).astype(float)
    centre, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (p - centre) / scale, (u - centre) / scale
    # Every third row is left out of the first model, which only orders rows for the estimate.
    held_p, held_u = np.arange(len(p)) % 3 == 0, np.arange(len(u)) % 3 == 0
    prior = 0.5
    if len(p) >= 30 and len(u) >= 30:
        w, b = minimise(p[~held_p], u[~held_u], 0.5)
        prior = estimate_prior(p[held_p] @ w + b, u[held_u] @ w + b)
    return Model(centre, scale, *minimise(p, u, prior), prior)


def features_of(docs: DataFrame, id_col: str) -> DataFrame:
    def step(batch: list[bytes | None]) -> dict:
        x = np.array([style(t) for t in batch], np.float32)
        return {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STYLE)).cast(pa.list_(pa.float32()))}

    return over_texts(docs, [id_col], "x array<float>", step)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fits on rows outside the held-out fold: those labelled 1, and those without a label.

    `labels` has `doc_id` and `quality`; a document with different labels is not trusted.
    """
    ids = docs.select(id_col).where(fold(id_col, FOLDS) != HELD_OUT).distinct()
    known = labels.groupBy(F.col("doc_id").alias(id_col)).agg(F.min("quality").alias("quality"))
    samples = []
    for chosen, limit in ((ids.join(known.where("quality = 1"), id_col, "left_semi"), positives), (ids.join(known, id_col, "left_anti"), unlabelled)):
        # The sample has at most `limit` ids.
        rows = docs.select(id_col, "text").join(F.broadcast(bounded_sample(chosen, id_col, limit)), id_col, "left_semi")
        rows = rows.groupBy(id_col).agg(F.min("text").alias("text"))  # of rows of one id the least text is learnt from
        found = dict(features_of(rows, id_col).collect())  # one row for each id
        samples.append(np.array([found[k] for k in sorted(found)], np.float32).reshape(-1, len(STYLE)))
    return fit(*samples)


def quality_score(model: Model) -> Column:
    """The score of `text` as a column."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        x = np.array([style(t) for t in column.cast(pa.large_binary()).to_pylist()], np.float32).reshape(-1, len(STYLE))
        return pa.array(model.scores(x))

    return score("text")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each row of `docs`: `id_col`, `held_out`, `score` (0 to 1) and `predicted`.

    Null and empty texts are scored as texts without words; rows without id are never learnt from and
    count as not held out; repeated rows each give a row, an empty table none. Without positives or
    unlabelled rows every score is a half.
    """
    scored = docs.select(id_col, quality_score(train(docs, labels, id_col)).alias("score"))
    held = F.coalesce(fold(id_col, FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", cutoff: float = 0.5) -> DataFrame:
    """`docs` without the documents whose score is below `cutoff`; the same columns.

    Null and empty texts are judged as texts without words; rows without id are judged by their text like any
    other, repeated rows alike; an empty table stays empty, and without positives or unlabelled rows all stay.
    """
    return docs.where(quality_score(train(docs, labels, id_col)) >= cutoff)
