"""Operator 4, language ID with error-correcting output codes.

Each language has a codeword of signs, far apart from the others; their number grows with that of the languages. For every bit one logistic
classifier over hashed byte n-grams predicts the sign. A text is given the language whose codeword has
the smallest loss against the predicted bits, each bit weighted by how well it was learned; where the
second language is nearly as close, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_map
from .ngram_features import histograms, learning_sample, sample_matrix

ORDERS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")
#: Rows learned from for each language, at most about so many.
ROWS_PER_LANGUAGE = 500
#: Rows learned from in all, which bounds the matrix on the driver: with more languages each has fewer, but at least LEAST_ROWS.
ROWS_IN_ALL, LEAST_ROWS = 16_384, 8
#: Fewest bits of a codeword.
LEAST_BITS = 15


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # of n-grams: 2**log2 x bits
    bias: np.ndarray
    trust: np.ndarray  # of bits
    log2: int


def bits_for(n: int) -> int:
    """Bits of the codewords of n languages: six for each doubling, so that random words stay far enough apart to mend wrong bits."""
    return max(LEAST_BITS, 6 * (n - 1).bit_length())


def codewords(n: int, n_bits: int, seed: int = 7) -> np.ndarray:
    """n codewords of signs with a large least distance, by the best of many seeded draws. No bit is the same for all."""
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(300 if n <= 64 else 20):
        codes = rng.choice(np.array([-1, 1]), size=(n, n_bits))
        if n > 1:
            constant = np.abs(codes.sum(0)) == n
            codes[0, constant] *= -1
        distance = (n_bits - codes @ codes.T) // 2 + n_bits * np.eye(n, dtype=int)
        if distance.min() > apart:
            best, apart = codes, distance.min()
    return best


def fit_language_model(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", n_bits: int | None = None, log2: int = 13, rows_per_language: int = ROWS_PER_LANGUAGE, steps: int = 80) -> LanguageModel | None:
    """Learns from rows that are not held out and have a language and a text; None if there are none.

    Bits follow the number of languages (bits_for) unless given. Of each language about rows_per_language rows are
    learned from, fewer where there are so many languages that ROWS_IN_ALL would be exceeded.
    """
    x, names = sample_matrix(learning_sample(docs, None, lang_col, rows_per_language, id_col, text_col, ROWS_IN_ALL, LEAST_ROWS), log2, ORDERS)
    kept = x.sum(1) > 0
    x, names = x[kept], [k for k, ok in zip(names, kept, strict=True) if ok]
    if not names:
        return None
    languages = sorted(set(names))
    n_bits = n_bits or bits_for(len(languages))
    codes = codewords(len(languages), n_bits)
    place, count = {k: i for i, k in enumerate(languages)}, Counter(names)
    signs = codes[[place[k] for k in names]].astype(np.float32)
    share = np.array([1 / count[k] for k in names], np.float32)[:, None] / len(languages)
    x /= x.sum(1, keepdims=True)
    scale = 1 / np.sqrt(x.mean(0) + 1e-6)
    x *= scale
    weights, bias = np.zeros((x.shape[1], n_bits), np.float32), np.zeros(n_bits, np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        error = -signs / (1 + np.exp(np.clip(signs * (x @ weights + bias), -30, 30))) * share
        gradient = x.T @ error + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        weights -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        bias -= error.sum(0)
    right = ((np.sign(x @ weights + bias) == signs) * share).sum(0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return LanguageModel(languages, codes, weights * scale[:, None], bias, trust / trust.sum(), log2)


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str], text_col: str = "text", margin: float = 0.02) -> DataFrame:
    """For each row of docs: struct `row` of `keep`, lang_pred, score (0 to 1, of that language) and ambiguous.

    Null and empty texts and texts without a letter are `und` with score 0 and are not ambiguous, and so
    are all texts if nothing could be learned. ambiguous: the weighted loss of the second language is
    within `margin` of the best.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        plus = None if m is None else (m.codes.T > 0).astype(float)  # a bit of +1 costs softplus(-x), one of -1 softplus(x)

        def work(column: pa.Array) -> list[pa.Array]:
            n = len(column)
            letters = np.array([t is not None and LETTER.search(t) is not None for t in column.to_pylist()], bool)
            if m is None:
                letters[:] = False
            language, score, unsure = np.array(["und"] * n, object), np.zeros(n), np.zeros(n, bool)
            for first, block in histograms(column, m.log2, ORDERS) if letters.any() else ():
                rows = np.arange(first, first + len(block))
                block /= np.maximum(block.sum(1, keepdims=True), 1)
                bits = np.clip(block @ m.weights + m.bias, -30, 30)
                loss = (np.logaddexp(0, -bits) * m.trust) @ plus + (np.logaddexp(0, bits) * m.trust) @ (1 - plus)
                ranked = np.sort(loss, 1)
                chance = np.exp(-len(m.trust) * (loss - ranked[:, :1]))
                chance /= chance.sum(1, keepdims=True)
                best = loss.argmin(1)
                known = letters[rows]
                language[rows[known]] = np.array(m.languages, object)[best[known]]
                score[rows[known]] = chance[np.arange(len(rows)), best][known]
                if len(m.languages) > 1:
                    unsure[rows] = known & (ranked[:, 1] - ranked[:, 0] < margin)
            return [pa.array(language.tolist(), pa.string()), pa.array(score), pa.array(unsure)]

        return work

    return text_map(docs, text_col, keep, make, "lang_pred string, score double, ambiguous boolean")


def with_language(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language can be told, with docs' columns: those without a letter go."""
    found = identify(docs, fit_language_model(docs, text_col=text_col), docs.columns, text_col)
    return found.where(F.col("lang_pred") != "und").select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
