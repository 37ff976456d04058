"""Operator 2, licence scans with ordered signature rules.

The words of a text are looked up among the rules' keywords first; only rules with a keyword in the text
are matched. Overlapping detections are settled by priority: a detection inside the interval of one that
goes before it (higher priority, then longer, then earlier) is suppressed. Three base phrases are always
counted, on the words themselves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_map
from .license_rules import rules
from .textvec import ALNUM, words

BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
RETURNS = "n_words long, base array<struct<word:long,label:string>>, detections array<struct<word:long,n_words:long,label:string,priority:int,confidence:double>>"
BASE_TYPE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
DETECTION_TYPE = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())]))


def hashes_of(keywords: list[str]) -> np.ndarray:
    w = words(pa.array(keywords, pa.string()), ALNUM)
    assert len(w.start) == len(keywords)
    return w.hashes()


def settle(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Detections (first word, end word, priority, label, confidence) without those contained in one that goes before them."""
    kept: list[tuple[int, int, int, str, float]] = []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return sorted(kept)


class Scanner:
    def __init__(self) -> None:
        self.rules = [(r, re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])")) for r in rules()]
        self.keywords = sorted({k for r in rules() for k in r.keywords})
        self.number = {k: i for i, k in enumerate(self.keywords)}
        hashes = hashes_of(self.keywords)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.phrases = [(hashes_of(list(phrase)), label) for phrase, label in BASE.items()]

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are keywords: their places, and the keywords' numbers."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == h)
        return places, self.order[at[places]]

    def detections(self, tokens: list[str], present: set[int]) -> list[tuple[int, int, int, str, float]]:
        text = " ".join(tokens)
        starts = np.cumsum([0] + [len(t) + 1 for t in tokens[:-1]])
        found = []
        for rule, pattern in self.rules:
            if not any(self.number[k] in present for k in rule.keywords):
                continue
            for m in pattern.finditer(text):
                first = int(np.searchsorted(starts, m.start(), side="right")) - 1
                end = int(np.searchsorted(starts, m.end()))
                found.append((first, end, rule.priority, rule.label, rule.confidence))
        return settle(found)

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        w = words(column, ALNUM)
        h, row = w.hashes(), w.row_of()
        base: list[list] = [[] for _ in range(w.rows)]
        for hashes, label in self.phrases:
            k = len(hashes)
            if len(h) >= k:
                same = np.ones(len(h) - k + 1, bool)
                for i in range(k):
                    same &= h[i : len(h) - k + 1 + i] == hashes[i]
                for i in np.flatnonzero(same & (row[: len(same)] == row[k - 1 :])).tolist():
                    base[row[i]].append((i - int(w.first[row[i]]), label))
        places, numbers = self.known(h)
        detections: list[list] = [[] for _ in range(w.rows)]
        at_row = row[places]
        for r in np.unique(at_row).tolist():
            present = set(numbers[np.searchsorted(at_row, r) : np.searchsorted(at_row, r, side="right")].tolist())
            tokens = [w.text(i).decode() for i in range(w.first[r], w.first[r + 1])]
            detections[r] = [{"word": a, "n_words": b - a, "label": label, "priority": p, "confidence": c} for a, b, p, label, c in self.detections(tokens, present)]
        ordered = [[{"word": a, "label": label} for a, label in sorted(x)] for x in base]
        return [pa.array(w.counts.astype(np.int64)), pa.array(ordered, BASE_TYPE), pa.array(detections, DETECTION_TYPE)]


def scan_licenses(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """For each row of docs: struct `row` of `keep`, n_words, base (places of the base phrases: first word and label, in order) and detections of the rules (first word, words, label, priority, confidence) that nothing suppressed.

    Null and empty texts have no words, no base places and no detections. Rows are independent: repeated
    ones give equal results.
    """
    return text_map(docs, text_col, keep, Scanner, RETURNS)
