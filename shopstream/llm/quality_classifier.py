"""Operator 10, quality classifier with supervised subword embeddings.

Hashed words and byte n-grams each have a learned vector. A text is the average of its vectors; a
softmax layer over the average gives the class. All is trained by stochastic gradient descent in numpy.
As the average and the layer are linear, a learned model is folded into one weight for each hash for
scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_map
from .ngram_features import histograms, learning_sample, sample_matrix

ORDERS = (2, 3, 4)
#: Rows learned from for each label, at most about so many.
ROWS_PER_LABEL = 1500


@dataclass
class SubwordModel:
    weights: np.ndarray  # of hashes: the vectors times the difference of the two classes' outputs
    bias: float
    log2: int


def fit_subword_model(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", dim: int = 8, log2: int = 13, rows_per_label: int = ROWS_PER_LABEL, epochs: int = 30, seed: int = 3) -> SubwordModel | None:
    """Learns label 1 against 0 from labelled rows that are not held out; None without both labels."""
    x, y = sample_matrix(learning_sample(docs, labels, label, rows_per_label, id_col, text_col), log2, ORDERS, True, False)
    y = np.array([int(v) for v in y])
    if len(set(y.tolist())) < 2:
        return None
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    scale = 1 / np.sqrt(x.mean(0) + 1e-6)
    x *= scale
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (x.shape[1], dim)).astype(np.float32)
    output = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)  # both labels weigh alike
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 32):
            rows = order[lo : lo + 32]
            hidden = x[rows] @ vectors
            logit = hidden @ output + bias
            chance = np.exp(logit - logit.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(rows)), y[rows]] -= 1
            error = chance * share[rows][:, None] / len(rows)
            to_hidden = error @ output.T
            output -= rate * np.clip(hidden.T @ error, -1, 1)
            bias -= rate * error.sum(0)
            vectors -= rate * (x[rows].T @ to_hidden) + rate * 1e-5 * vectors
    folded = vectors @ (output[:, 1] - output[:, 0]) * scale
    return SubwordModel(folded.astype(np.float32), float(bias[1] - bias[0]), log2)


def quality_scores(docs: DataFrame, model: SubwordModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """For each row of docs: struct `row` of `keep` and score (0 to 1, higher: label 1 likelier).

    Null texts score as empty ones. If nothing could be learned every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(column: pa.Array) -> list[pa.Array]:
            score = np.full(len(column), 0.5)
            for first, block in histograms(column, m.log2, ORDERS, True, False) if m is not None else ():
                logit = block @ m.weights / np.maximum(block.sum(1), 1) + m.bias
                score[first : first + len(block)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            return [pa.array(score)]

        return work

    return text_map(docs, text_col, keep, make, "score double")
