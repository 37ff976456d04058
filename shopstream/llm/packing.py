"""Operator 8, bounded-space online packing of token sequences.

Each task reads its documents in order and keeps at most `n_open` windows open. A document goes into the
fullest window in which it fits (best fit). If it fits in none and all windows are open, the fullest one
is filled up with the document's head, emitted, and the rest goes on. Full windows' worth of a long
document are emitted at once. At the end the windows left over are merged: their pieces are laid end to
end into full windows, and the last tokens into windows whose sizes are powers of two, which need no
padding. So no sequence is padded, and pieces leave the task as they come: memory is bounded by n_open
windows and one document.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import docs_of, in_batches
from .textvec import NON_SPACE, Words, buffers, release, slices, words

#: Bytes of text that are tokenised together, and words in one call of the tokenizer.
TOKENISED_BYTES, WORDS = 500_000, 4000
#: Different parts that a worker process remembers the ids of: the first ones it meets, which are the frequent ones.
REMEMBERED = 300_000

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
#: ASCII marks and digits, which end a run of ASCII letters; an apostrophe may start a contraction and ends nothing.
MARK = ~LETTER & NON_SPACE
MARK[0x80:] = MARK[0x27] = False


class Known:
    """Ids of the parts met so far, by hash: sorted hashes, and the place and number of each one's ids in `flat`."""

    def __init__(self) -> None:
        self.hashes, self.begin, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash and whether it is there."""
        at = np.searchsorted(self.hashes, hashes)
        near = np.minimum(at, max(len(self.hashes) - 1, 0))
        return near, (self.hashes[near] == hashes) if len(self.hashes) else np.zeros(len(hashes), bool)

    def add(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        room = max(0, REMEMBERED - len(self.hashes))
        hashes, n = hashes[:room], n[:room]
        if len(hashes):
            begin = len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate([self.flat, ids[: n.sum()]])
            merged = np.concatenate([self.hashes, hashes])
            order = np.argsort(merged)
            self.hashes, self.begin, self.n = merged[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.n, n])[order]


@cache
def tokenizer_of(path: str):
    """The tokenizer, which of its ids end a word, and the parts known so far; loaded once in a worker process. What is known never changes a result."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads; more of them hold memory of their own
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
        ends[k] = token.endswith("</w>")
    return tokenizer, ends, Known()


class PartTokenizer:
    """Ids of whole texts, from the ids of their different parts.

    Right for tokenizers that drop white space, fold case, end each word with a mark of its own and never
    join ASCII letters with digits or punctuation other than the apostrophe. Texts are cut at white space
    and between ASCII letters and such marks; each different part is given to the tokenizer once for a
    slice of rows. Parts of letters alone are words: many of them are encoded in one call and told apart
    by the ids that end a word.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ends, self.known = tokenizer_of(path)

    def each(self, parts: list[str]) -> list[np.ndarray]:
        # An encoding is far larger than its ids: few are held at once.
        return [np.array(e.ids, np.uint32) for lo in range(0, len(parts), WORDS) for e in self.tokenizer.encode_batch(parts[lo : lo + WORDS], add_special_tokens=False)]

    def of_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, laid end to end, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(found), WORDS):
            some = found[lo : lo + WORDS]
            own = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            n = np.diff(np.flatnonzero(self.ends[own]), prepend=-1)
            if len(n) != len(some) or n.sum() != len(own):  # a letter that the tokenizer takes apart
                lists = self.each(some)
                own, n = np.concatenate(lists), np.array([len(x) for x in lists])
            ids.append(own)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each ended by end_id, and row offsets."""
        data, _ = buffers(column)
        special = b"<|" in data.tobytes()  # may be a special token, which no cut or case fold may touch
        w = words(column, NON_SPACE, lower=not special)
        if not special and len(w.data):
            cut = np.zeros(len(w.data), bool)
            letter, mark = LETTER[w.data], MARK[w.data]
            cut[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
            cut[w.offsets[:-1][w.offsets[:-1] < len(cut)]] = False  # the start of a row begins a word anyway
            extra = np.flatnonzero(cut)
            w = Words(w.data, w.offsets, np.sort(np.concatenate([w.start, extra])), np.sort(np.concatenate([w.end, extra])), w.first)
            w.first = np.searchsorted(w.start, w.offsets)
        code, distinct = pd.factorize(w.hashes())
        sample = np.zeros(len(distinct), np.int64)
        sample[code[::-1]] = np.arange(len(code))[::-1]
        at, there = self.known.find(distinct)
        fresh = np.flatnonzero(~there)
        text = w.data.tobytes()
        strings = [text[a:b].decode("utf-8", "replace") for a, b in zip(w.start[sample[fresh]].tolist(), w.end[sample[fresh]].tolist(), strict=True)]
        is_word = np.array([x.isalpha() for x in strings], bool)
        word_ids, word_lengths = self.of_words([x for x, ok in zip(strings, is_word, strict=True) if ok])
        others = self.each([x for x, ok in zip(strings, is_word, strict=True) if not ok])
        order = np.concatenate([fresh[is_word], fresh[~is_word]]).astype(np.int64)  # of the ids of fresh parts
        n_new = np.concatenate([word_lengths, np.array([len(x) for x in others], np.int64)])
        ids_new = np.concatenate([word_ids, *others])
        n_known = len(self.known.flat)
        flat = np.concatenate([self.known.flat, ids_new, np.array([end_id], np.uint32)])
        lengths, begin = np.ones(len(distinct) + 1, np.int64), np.full(len(distinct) + 1, len(flat) - 1, np.int64)
        lengths[:-1][there], begin[:-1][there] = self.known.n[at[there]], self.known.begin[at[there]]
        lengths[order], begin[order] = n_new, n_known + np.cumsum(n_new) - n_new
        self.known.add(distinct[order], ids_new, n_new)
        # the texts as sequences of parts, each row ended by the part of end_id
        chunks = np.full(len(code) + w.rows, len(distinct), np.int64)
        chunks[np.arange(len(code)) + w.row_of()] = code
        n = lengths[chunks]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[chunks] - ends + n, n)]
        return ids, np.concatenate([[0], ends[w.first[1:] + np.arange(w.rows)]])


class Packer:
    """Places documents' ids; gives finished sequences as lists of (doc, start, ids, tokens of the document)."""

    def __init__(self, size: int, n_open: int):
        self.size, self.n_open = size, n_open
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list]:
        total, start = len(ids), 0
        while total - start >= self.size:
            yield [(doc, start, ids[start : start + self.size], total)]
            start += self.size
        while start < total:
            rest = total - start
            fits = [k for k, (n, _) in enumerate(self.open) if n + rest <= self.size]
            if fits:
                k = max(fits, key=lambda k: self.open[k][0])
                self.open[k] = (self.open[k][0] + rest, [*self.open[k][1], (doc, start, ids[start:], total)])
                if self.open[k][0] == self.size:
                    yield self.open.pop(k)[1]
                return
            if len(self.open) < self.n_open:
                self.open.append((rest, [(doc, start, ids[start:], total)]))
                return
            n, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
            room = self.size - n
            yield [*pieces, (doc, start, ids[start : start + room], total)]
            start += room

    def leftovers(self) -> Iterator[list]:
        pieces = [p for _, window in sorted(self.open, key=lambda x: -x[0]) for p in window]
        left = sum(len(p[2]) for p in pieces)
        sizes = [self.size] * (left // self.size)
        sizes += [1 << k for k in reversed(range((left % self.size).bit_length())) if left % self.size >> k & 1]
        at = 0  # within the first piece
        for size in sizes:
            window = []
            while size:
                doc, start, ids, total = pieces[0]
                part = ids[at : at + size]
                window.append((doc, start + at, part, total))
                size -= len(part)
                at += len(part)
                if at == len(ids):
                    pieces.pop(0)
                    at = 0
            yield window
        self.open = []


SCHEMA = "doc_id long, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, n_open: int = 32) -> DataFrame:
    """One row for each piece of a document in a sequence of at most `size` tokens: doc_id, start (ids of the document before it), ids (little-endian unsigned 32-bit), length, doc_tokens (ids of the whole document, with the end mark), sequence_id and offset (in the sequence, without gaps from 0).

    Every row of docs is a document of its own, equal rows and null identifiers too; null and empty texts
    are documents of the end mark alone. An empty table gives no rows. sequence_id is unique: the task's
    partition number above 32 bits, a count below. Sequences do not depend on which executor runs a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = PartTokenizer(tokenizer_path), Packer(size, n_open)
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        held = 0

        def rows() -> pa.RecordBatch:
            doc, start, ids, total, number, offset = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(number, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "start", "ids", "length", "doc_tokens", "sequence_id", "offset"])

        def place(window: list) -> None:
            nonlocal sequence, held
            offset = 0
            for doc, start, ids, total in window:
                out.append((doc, start, ids, total, sequence, offset))
                offset += len(ids)
            held += offset
            sequence += 1

        for batch in batches:
            doc_ids, text = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(text, TOKENISED_BYTES):
                ids, offsets = tokenizer.encode(text.slice(lo, hi - lo), end_id)
                for k in range(hi - lo):
                    for window in packer.add(doc_ids[lo + k], ids[offsets[k] : offsets[k + 1]].copy()):
                        place(window)
                    if held > 500_000:
                        yield rows()
                        out.clear()
                        held = 0
            release()
        for window in packer.leftovers():
            place(window)
        if out:
            yield rows()

    return in_batches(docs_of(docs, id_col, text_col), run, SCHEMA)
