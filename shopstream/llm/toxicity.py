"""Operator 3, toxicity by compression distance.

zstandard trains dictionaries on ordinary and on toxic passages. Either of the two that are used is a part
trained on ordinary windows, which both share, and an own part of equal size: trained on other ordinary
windows, or on the passages of toxic texts whose words have a beginning (stem) that toxic texts use in
clearly more different contexts. Every window of a text (a run of a few words) is compressed with either.
Differences of the two lengths are told for learning texts by dictionaries trained without them; their
distributions in toxic and in ordinary texts give each difference a likelihood ratio, which rises with it.
The sum over a text's windows, for windows toxic at a small rate, is calibrated to a probability.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_map
from .ngram_features import learning_sample
from .textvec import NON_SPACE, words

#: Rows learned from for each label, at most about so many, of at most LEARN_BYTES each.
ROWS_PER_LABEL, LEARN_BYTES = 1000, 50_000
#: Words in a window, words from one window's start to the next one's, and bytes of a stem.
WINDOW, STRIDE, STEM = 6, 2, 4
#: Sizes that zstandard is asked for, of the shared part and of each own part; sizes of a dictionary's segments that are tried in turn.
SHARED_BYTES, OWN_BYTES, SEGMENTS = 8192, 1400, (16, 12, 24, 32, 48)
FOLDS = 2
LOW, HIGH = -6, 12
#: Rate of toxic windows in a toxic text.
RATE = 0.02


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    ratio: np.ndarray  # of likelihoods, for length differences LOW..HIGH
    slope: float
    offset: float


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        3, source_size=WINDOW * 8, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_LAZY2, min_match=5, hash_log=14, chain_log=14)
    dictionary.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)


def windows(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Text in lower case with white space as blanks, (offset, length) of its windows, and the row of each. A window starts at the blank before its first word."""
    lead = pa.array([" " + (t or "") for t in column.to_pylist()], pa.string())
    w = words(lead, NON_SPACE)
    data = w.data.copy()
    data[~NON_SPACE[data]] = 0x20
    n = np.where(w.counts > 0, np.maximum(-(-(w.counts - WINDOW) // STRIDE), 0) + 1, 0)
    row = np.repeat(np.arange(w.rows), n)
    first = np.repeat(w.first[:-1], n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    last = np.minimum(first + WINDOW, np.repeat(w.first[1:], n)) - 1
    start = w.start[first] - 1
    return data.tobytes(), np.stack([start, w.end[last] - start], 1).astype(np.uint64), row


def differences(data: bytes, spans: np.ndarray, ordinary, toxic) -> np.ndarray:
    """Compressed length with the ordinary dictionary minus that with the toxic one, of each window, cut to LOW..HIGH."""
    if not len(spans):
        return np.zeros(0, np.int64)
    segments = zstandard.BufferWithSegments(data, spans.tobytes())
    lengths = []
    for c in (ordinary, toxic):
        out = c.multi_compress_to_buffer(segments, threads=1)
        lengths.append(np.fromiter((len(out[k]) for k in range(len(spans))), np.int64, len(spans)))
    return np.clip(lengths[0] - lengths[1], LOW, HIGH)


def evidence(difference: np.ndarray, row: np.ndarray, n_rows: int, ratio: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each text, if RATE of its windows is toxic."""
    return np.bincount(row, weights=np.log1p(RATE * (ratio[difference - LOW] - 1)), minlength=n_rows)


def contexts(texts: list[str]) -> tuple[dict[bytes, set], int]:
    """Different (word before, word) pairs by the word's stem: a copied text adds nothing."""
    out: dict[bytes, set] = defaultdict(set)
    for text in texts:
        before = b""
        for word in text.encode().lower().split():
            word = word.strip(b".,;:!?")
            if len(word) >= STEM:
                out[word[:STEM]].add((before, word))
            before = word
    return out, sum(map(len, out.values()))


def toxic_stems(toxic: list[str], ordinary: list[str], least: float = 4.5) -> set[bytes]:
    """Stems that toxic texts use in more contexts than chance allows: by `least` standard deviations, and three times their share."""
    (in_toxic, n_toxic), (in_ordinary, n_ordinary) = contexts(toxic), contexts(ordinary)
    share = n_toxic / max(1, n_toxic + n_ordinary)
    out = set()
    for stem, pairs in in_toxic.items():
        n = len(pairs) + len(in_ordinary.get(stem, ()))
        sigma = (len(pairs) - n * share) / math.sqrt(n * share * (1 - share) + 1)
        if sigma >= least and len(pairs) * (1 - share) * n_ordinary >= 3 * len(in_ordinary.get(stem, ())) * share * n_toxic:
            out.add(stem)
    return out


def trained(size: int, passages: list[bytes]) -> bytes:
    """A dictionary that zstandard trains on passages; the longest one where none gets near the size, the passages themselves where they are too few to train on."""
    best = b""
    for k in SEGMENTS:
        try:
            found = zstandard.train_dictionary(size, passages, k=k, d=6, level=3).as_bytes()
        except zstandard.ZstdError:
            continue
        best = max(best, found, key=len)
        if len(best) >= 0.9 * size:
            break
    return best or b"".join(passages)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary, of equal size, trained on the passages of texts."""
    data, spans, _ = windows(pa.array(ordinary, pa.string()))
    plain = [data[int(a) : int(a + n)] for a, n in spans[::3]]  # each third window starts after the one before it ends
    stems = toxic_stems(toxic, ordinary)
    marked = (b"".join(b" " + w.strip(b".,;:!?") for w in t.encode().lower().split() if w[:STEM] in stems) for t in toxic)
    shared = trained(SHARED_BYTES, plain[::2])
    own = trained(OWN_BYTES, [p + b" " for p in marked if p])
    other = trained(max(len(own), 256), plain[1::2])[-len(own) :] if own else b""
    return shared + other.rjust(len(own)), shared + own


def increasing(ratio: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest values to ratio that never fall, by pooling adjacent ones that do."""
    blocks: list[list[float]] = []
    for r, w in zip(ratio, weight, strict=True):
        blocks.append([r, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            r1, w1, n1 = blocks.pop()
            r0, w0, n0 = blocks[-1]
            blocks[-1] = [(r0 * w0 + r1 * w1) / (w0 + w1), w0 + w1, n0 + n1]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def window_ratio(in_toxic: np.ndarray, in_ordinary: np.ndarray) -> np.ndarray:
    """Likelihood ratio of toxic to ordinary windows for each difference. Windows of toxic texts are ordinary but for the share by which their smallest ratio falls short of 1."""
    a, b = (np.bincount(d - LOW, minlength=HIGH - LOW + 1) + 0.3 for d in (in_toxic, in_ordinary))
    ratio = increasing((a / a.sum()) / (b / b.sum()), a / a.sum() + b / b.sum())
    share = max(1 - float(ratio.min()), 0.01)
    return np.clip((ratio - (1 - share)) / share, 1e-3, 1e5)


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows_per_label: int = ROWS_PER_LABEL) -> ToxicityModel | None:
    """Learns from labelled rows that are not held out, whatever part of the model; None without both labels. Equal texts of a label are learned from once."""
    rows = learning_sample(docs.where(F.octet_length(text_col) <= LEARN_BYTES), labels, label, rows_per_label, id_col, text_col).toArrow()
    pairs = sorted({(int(v), t) for v, t in zip(rows.column(1).to_pylist(), rows.column(0).to_pylist(), strict=True)})
    texts, y = [t for _, t in pairs], np.array([v for v, _ in pairs], np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    fold = np.arange(len(y)) % FOLDS
    # every text is told by dictionaries that were trained without it
    difference, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        ordinary, toxic = dictionaries(*([texts[i] for i in np.flatnonzero((fold != k) & (y == v))] for v in (1, 0)))
        data, spans, at = windows(pa.array([texts[i] for i in own], pa.string()))
        difference.append(differences(data, spans, compressor(ordinary), compressor(toxic)))
        row.append(own[at])
    d, row = np.concatenate(difference), np.concatenate(row)
    model = ToxicityModel(*dictionaries(*([t for t, w in zip(texts, y, strict=True) if w == v] for v in (1, 0))), window_ratio(d[y[row] == 1], d[y[row] == 0]), 1.0, -2.0)
    x = evidence(d, row, len(y), model.ratio)
    # logistic calibration in one variable, at the rate of toxic rows among the labelled ones that are not held out
    known = labels.where(F.col(label).isNotNull() & ~held_out(id_col))
    counts = {int(r[0]): r[1] for r in known.groupBy(F.col(label)).count().collect() if r[0] is not None and int(r[0]) in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 1) / (y == 1).sum(), counts.get(0, 1) / (y == 0).sum())
    weight = weight / weight.sum()
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-4 * (slope - 1), (weight * (p - y)).sum()])
        v = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - float(np.clip(step[0], -1, 1)), offset - float(np.clip(step[1], -1, 1))
    model.slope, model.offset = max(slope, 1e-3), offset
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """For each row of docs: struct `row` of `keep` and score (0 to 1, higher: label 1 likelier).

    Null, empty and wordless texts have no windows, hence no evidence. If nothing could be learned every
    score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        both = (compressor(m.ordinary), compressor(m.toxic)) if m else None

        def work(column: pa.Array) -> list[pa.Array]:
            if m is None:
                return [pa.array(np.zeros(len(column)))]
            data, spans, row = windows(column)
            x = evidence(differences(data, spans, *both), row, len(column), m.ratio)
            return [pa.array(1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30))))]

        return work

    return text_map(docs, text_col, keep, make, "score double")
