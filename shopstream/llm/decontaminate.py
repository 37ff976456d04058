"""Operator 6, benchmark decontamination with training suffix arrays.

The training documents are read in shards (bounded slices of whole documents). Each task builds the
suffix array of the words of its shard, by prefix doubling on the suffixes that are still tied, and
binary-searches every suffix of every benchmark item in it. Matches of a window are extended along their
diagonal to the longest verbatim match, with its place in the document and in the item. Only matches
leave the task, so nothing is shuffled.

The benchmark is the stated query set: it is held in blocks of at most `block_bytes`, checked, each
against all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_map
from .textvec import ALNUM, Words, words

BLOCK_BYTES = 32_000_000


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of `codes` (positive integers) in lexicographic order; a suffix that ends sorts first.

    The first pass sorts by as many codes as fit into 62 bits; each later one doubles the depth, for the
    tied suffixes only.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    width = max(1, int(codes.max()).bit_length())
    depth = max(1, 62 // width)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = (key << width) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    tied = np.arange(n)  # places in `order` that may still change
    sorted_key = key[order]
    while True:
        new = np.empty(len(tied), bool)
        new[:1] = True
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        head = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[order[tied]] = head
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if not len(tied):
            return order
        at = order[tied]
        follow = rank[np.minimum(at + depth, n)]
        group = rank[at]
        by = np.lexsort((follow, group))
        order[tied] = at[by]
        # two columns in one key: groups have consecutive places, so (group, follow) fits 64 bits
        sorted_key = (group[by] << 32) + follow[by] + 1
        depth *= 2


def find(codes: np.ndarray, order: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array whose suffixes start with each pattern (rows of `patterns`, of the given lengths): binary search of all patterns at once."""
    most = patterns.shape[1]
    padded = np.concatenate([codes, np.zeros(most, codes.dtype)])
    inside = np.arange(most)[None, :] < lengths[:, None]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            start = order[np.minimum(mid, len(order) - 1)]
            there = padded[start[:, None] + np.arange(most)]
            differs = (there != patterns) & inside
            at = differs.argmax(1)
            rows = np.arange(len(patterns))
            equal = ~differs[rows, at]
            left = np.where(equal, upper, there[rows, at] < patterns[rows, at])
            lo = np.where(open_ & left, mid + 1, lo)
            hi = np.where(open_ & ~left, mid, hi)
        return lo

    return bound(False), bound(True)


class Items:
    """Words of a block of benchmark items and the windows that their suffixes start with."""

    def __init__(self, item_ids: list[int], texts: list[str | None], window: int):
        w = words(pa.array(texts, pa.string()), ALNUM)
        self.ids = np.array(item_ids, np.int64)
        self.hashes = w.hashes()
        counts = w.counts
        n = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        self.row = np.repeat(np.arange(len(counts)), n)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
        self.place = np.arange(n.sum()) - np.repeat(first, n)  # of the window in its item
        self.start = np.repeat(w.first[:-1], n) + self.place
        self.length = np.repeat(np.minimum(counts, window), n)
        self.window = window


def shard_matches(w: Words, items: Items) -> tuple[np.ndarray, ...]:
    """Occurrences of windows in a shard: row, word in the row, number of the window."""
    empty = (np.zeros(0, np.int64),) * 3
    if not len(w.start) or not len(items.start):
        return empty
    vocabulary, inverse = np.unique(w.hashes(), return_inverse=True)
    row = w.row_of()
    codes = np.zeros(len(inverse) + w.rows, np.int64)  # code 0 after each row: no match crosses it
    codes[np.arange(len(inverse)) + row] = inverse + 1
    known = np.searchsorted(vocabulary, items.hashes)
    known = np.where((known < len(vocabulary)) & (vocabulary[np.minimum(known, len(vocabulary) - 1)] == items.hashes), known + 1, 0)
    reach = np.minimum(items.start[:, None] + np.arange(items.window), len(known) - 1)
    patterns = known[reach]
    inside = np.arange(items.window)[None, :] < items.length[:, None]
    possible = np.flatnonzero(((patterns > 0) | ~inside).all(1))
    if not len(possible):
        return empty
    order = suffix_array(codes)
    lo, hi = find(codes, order, patterns[possible], items.length[possible])
    found = hi - lo
    window = np.repeat(possible, found)
    at = order[np.repeat(lo, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)]
    # places in codes back to rows and words of rows
    row_start = w.first[:-1] + np.arange(w.rows)
    row = np.searchsorted(row_start, at, side="right") - 1
    return row, at - row_start[row], window


def _maximal(row: np.ndarray, word: np.ndarray, window: np.ndarray, items: Items) -> np.ndarray:
    """Longest matches (row, item, word in document, word in item, words): windows that follow each other on one diagonal are one match."""
    item, place = items.row[window], items.place[window]
    by = np.lexsort((word, word - place, item, row))
    row, item, word, place, length = row[by], item[by], word[by], place[by], items.length[window][by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (word[1:] - place[1:] != word[:-1] - place[:-1]) | (word[1:] != word[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    return np.stack([row[head], item[head], word[head], place[head], word[last] + length[last] - word[head]], 1) if len(head) else np.zeros((0, 5), np.int64)


MATCH = pa.struct([("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
RETURNS = "n_words long, n_hit long, item_ids array<long>, matches array<struct<item_id:long,doc_word:long,item_word:long,n_words:long>>"


def _search(block):
    def make():
        items = Items(*block.value)

        def work(column: pa.Array) -> list[pa.Array]:
            w = words(column, ALNUM)
            counts = w.counts.astype(np.int64)
            found = _maximal(*shard_matches(w, items), items)
            n_hit, item_ids, matches = np.zeros(w.rows, np.int64), [[]] * w.rows, [[]] * w.rows
            if len(found):
                step = np.zeros(len(w.start) + 1, np.int64)
                begin = w.first[found[:, 0]] + found[:, 2]
                np.add.at(step, begin, 1)
                np.add.at(step, begin + found[:, 4], -1)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
                n_hit = hit[w.first[1:]] - hit[w.first[:-1]]
                for row in np.unique(found[:, 0]).tolist():
                    own = found[np.searchsorted(found[:, 0], row) : np.searchsorted(found[:, 0], row, side="right")]
                    ids = items.ids[own[:, 1]]
                    item_ids[row] = np.unique(ids).tolist()
                    matches[row] = [dict(zip(("item_id", "doc_word", "item_word", "n_words"), x, strict=True)) for x in zip(ids.tolist(), *own[:, 2:].T.tolist(), strict=True)]
            return [pa.array(counts), pa.array(n_hit, pa.int64()), pa.array(item_ids, pa.list_(pa.int64())), pa.array(matches, pa.list_(MATCH))]

        return work

    return make


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: struct `row` of the columns `keep`, and

    n_words (words of the text), n_hit (words inside any occurrence of a window of `window` consecutive
    item words), item_ids (items with occurring windows, ascending) and matches (the longest verbatim
    matches: item, first word in the document and in the item, words).

    An item of fewer words is one window of all of them. Null, empty and wordless texts have no words and
    no matches, on both sides. Items with a null identifier are left out. Repeated items or documents are
    each handled as rows of their own. An empty benchmark gives no hits; empty docs give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes * (1 if total <= block_bytes else 1.5)))
    out = None
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).toArrow() if n_blocks > 1 else items.toArrow()
        block = spark.sparkContext.broadcast((rows.column(0).to_pylist(), rows.column(1).to_pylist(), window))
        if out is None:
            out = text_map(docs, text_col, keep if n_blocks == 1 else list(dict.fromkeys([*keep, text_col])), _search(block), RETURNS)
        else:  # matches of the blocks so far go along with the rows
            more = text_map(out.withColumn("text", F.col(f"row.{text_col}")), "text", ["row", "matches", "item_ids"], _search(block), RETURNS)
            merged = F.concat("row.matches", "matches")
            out = more.select("row.row", "n_words", n_hit_of(merged).alias("n_hit"), F.array_sort(F.array_union("row.item_ids", "item_ids")).alias("item_ids"), merged.alias("matches"))
        if n_blocks > 1:
            out = stored(out, "matches")
    return out


def n_hit_of(matches):
    """Words covered by a list of matches: their union, by a sweep in order of the first word."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, m: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(m["a"], s["end"]))).alias("n"), F.greatest(s["end"], m["b"]).alias("end"))
    return F.aggregate(spans, start, step)["n"]


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without a match, with docs' columns."""
    kept = benchmark_matches(docs, benchmark, docs.columns, text_col, **options).where("n_hit = 0")
    return kept.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
