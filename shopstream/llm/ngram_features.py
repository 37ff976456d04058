"""Hashed n-gram histograms of texts: the features of the language and quality classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_batches
from .textvec import NON_SPACE, buffers, mix, release, slices, words

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
#: Rows of a dense block of histograms at most.
BLOCK = 128


def histograms(column: pa.Array, log2: int, orders: tuple[int, ...], with_words: bool = False, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of rows x 2**log2) in blocks of rows: byte n-grams of the given orders and, with_words, whole words.

    The words come with two more features: one for each word that equals the word before it, and one
    end mark for each text. N-grams do not cross rows.
    """
    size, shift = 1 << log2, np.uint32(32 - log2)
    lower_table = np.arange(256, dtype=np.uint8)
    lower_table[65:91] += 32 if lower else 0
    for lo, hi in slices(column, 1_000_000):
        part = column.slice(lo, hi - lo)
        data, offsets = buffers(part)
        data = lower_table[data].astype(np.uint32) + np.uint32(1)
        ids, at = [], []
        for n in orders:
            h = np.zeros(max(len(data) - n + 1, 0), np.uint32)
            for k in range(n):
                h = (h + data[k : len(data) - n + 1 + k]) * _FACTORS[k] if len(h) else h
                h ^= h >> np.uint32(15)
            h = ((h * _FACTORS[4] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * _FACTORS[1]) >> shift
            ids.append(h)
            at.append((offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)))
        if with_words:
            w = words(part, NON_SPACE, lower=lower)
            h = mix(w.hashes())
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            again[w.first[:-1][w.first[:-1] < len(h)]] = False
            ids.append((h >> np.uint64(64 - log2)).astype(np.uint32))
            at.append((w.first[:-1], w.first[1:]))
        for first in range(0, hi - lo, BLOCK):
            rows = range(first, min(first + BLOCK, hi - lo))
            out = np.zeros((len(rows), size), np.float32)
            for k, row in enumerate(rows):
                for h, (begin, end) in zip(ids, at, strict=True):
                    if end[row] > begin[row]:
                        out[k] += np.bincount(h[begin[row] : end[row]], minlength=size)
                if with_words:
                    out[k, 0] += 2 * again[w.first[row] : w.first[row + 1]].sum()
                    out[k, 1] += 1
            yield lo + first, out


#: Different labels that a model is fitted for at most, all of which are counted on the driver.
MOST_LABELS = 2048


def learning_sample(docs: DataFrame, labels: DataFrame | None, label: str, rows_per_label: int, id_col: str = "doc_id", text_col: str = "text", rows_in_all: int | None = None, least_rows: int = 8) -> DataFrame:
    """(text, label): about rows_per_label rows of each label (the bound on what is learned from), none of them held out. Where there are more labels than rows_in_all has room for, each gets an equal part of rows_in_all, but least_rows at least.

    Rows are chosen by a hash of the identifier, at a rate for each label, so that no label is sorted or
    gathered. `labels` is joined by identifier; without it the label is a column of docs. Rows with a
    null text or label are left out. More than MOST_LABELS different labels are an error.
    """
    if labels is None:
        labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    else:
        labelled = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label"))
    labelled = labelled.where(F.col("label").isNotNull() & ~held_out("doc_id"))
    counts = labelled.groupBy("label").count().orderBy("label").limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different labels")
    if not counts:
        return docs.select(F.col(text_col).alias("text"), F.lit(None).cast(labelled.schema["label"].dataType).alias("label")).limit(0)
    if rows_in_all:
        rows_per_label = min(rows_per_label, max(least_rows, rows_in_all // len(counts)))
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["label"]), F.lit(min(1.0, rows_per_label / r["count"])))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_003)) < F.element_at(rate, F.col("label")) * 1_000_003)
    if labels is not None:  # at most about rows_per_label identifiers for each label: small enough to send to the texts
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
        chosen = texts.join(F.broadcast(chosen), "doc_id")
    return chosen.select("text", "label")


def sample_matrix(sample: DataFrame, log2: int, orders: tuple[int, ...], with_words: bool = False, lower: bool = True) -> tuple[np.ndarray, list]:
    """Histograms of a bounded sample, made in tasks, and its labels, in a fixed order."""

    def run(batches):
        for batch in batches:
            labels = batch.column(1)
            for first, block in histograms(batch.column(0), log2, orders, with_words, lower):
                at, values = [], []
                for row in block:
                    found = np.flatnonzero(row)
                    at.append(found.astype(np.int32))
                    values.append(row[found])
                yield pa.RecordBatch.from_arrays([labels.slice(first, len(block)), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["label", "at", "n"])
            release()

    kind = sample.schema["label"].dataType.simpleString()
    rows = in_batches(sample, run, f"label {kind}, at array<int>, n array<float>").toArrow().combine_chunks()
    out = np.zeros((rows.num_rows, 1 << log2), np.float32)
    labels, at, n = (rows.column(k) for k in range(3))
    for k in range(rows.num_rows):
        out[k, at[k].values.to_numpy()] = n[k].values.to_numpy()
    labels = labels.to_pylist()
    order = sorted(range(len(labels)), key=lambda k: (str(labels[k]), out[k].tobytes()))  # whatever order the tasks ended in
    return out[order], [labels[k] for k in order]
