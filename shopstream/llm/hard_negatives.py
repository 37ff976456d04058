"""Operator 11, hard negatives by matrix products in a residue number system.

Whole components are reduced modulo several small primes to centred residues. A product of residue
matrices in float32 is exact, as its sums stay within 2**24; the residues of a score give the signed
score by Chinese remaindering. The primes are as many as the largest possible score needs.

Rows are packed into blocks where they are read, anchors likewise. Each block of anchors meets each block
of rows once: blocks of rows are dealt to groups, anchors go to every group. A task keeps the best few
rows of an anchor among all blocks it sees and gives only these on; a window picks the best of all. First
the positives are found, then, with the window of scores that each positive opens, the negatives.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import dropped, stored
from .vectors import finite_vectors, matrix

#: Dimensions in one product, and the largest centred residue: DIMS * HALF**2 <= 2**24, so float32 sums are exact.
DIMS, HALF = 64, 512
#: Rows of a block, anchors of a block, blocks of anchors whose best rows a task holds at once, MB of rows in a group.
ROWS, ANCHORS, HELD, GROUP_MB = 2048, 256, 64, 64
#: Largest sum of squares: a hundred times a score must fit into 64 bits.
LARGEST = 2.0**56


def residue_primes(bound: float) -> list[int]:
    """Primes, from the largest with residues up to HALF downwards, whose product is over 2 * bound + 1."""
    primes, product, p = [], 1, 2 * HALF + 1
    while product <= 2 * int(bound) + 1:
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            primes.append(p)
            product *= p
        p -= 1
    return primes


def reduced(x: np.ndarray, p: int) -> np.ndarray:
    """Centred residues of whole float64 numbers below 2**53."""
    return x - p * np.rint(x / p)


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [reduced((x % p).astype(np.float64), p).astype(np.float32) for p in primes]


def residue_products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (int64) of the rows of two whole matrices, given by their residues. The score is put together digit by digit in the mixed radix of the primes, with centred digits, so its sign comes out by itself."""
    d = min(a[0].shape[1], b[0].shape[1])  # shorter vectors end in zeros
    total, weight = None, 1
    for p, x, y in zip(primes, a, b, strict=True):
        r = np.zeros((len(x), len(y)))
        for lo in range(0, d, DIMS):
            r += x[:, lo : min(lo + DIMS, d)] @ y[:, lo : min(lo + DIMS, d)].T
        if total is None:
            total = reduced(r, p)
        else:
            known = reduced(total, p) if total.dtype == np.float64 else reduced((total % p).astype(np.float64), p)
            digit = reduced(reduced(r - known, p) * pow(weight, -1, p), p)
            if weight * p >= 1 << 52:  # beyond exact float64
                total = total.astype(np.int64) + digit.astype(np.int64) * np.int64(weight)
            else:
                total = total + digit * weight
        weight *= p
    return total.astype(np.int64)


def blocks_of(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of at most `size` rows (key, id, label, vector and perhaps bounds: arrays of scores): their columns as bytes, components as floor(scale * x) in the smallest type that holds them, and the largest sum of squares."""
    bounded = "bounds" in rows.columns
    schema = "keys binary, ids binary, labels binary, vectors binary, kind string, dims int, n int, largest double, bounds binary, slots int"

    def pack(batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for lo in range(0, batch.num_rows, size):
                part = {k: c.slice(lo, size) for k, c in column.items()}
                x = np.floor(scale * matrix(part["vector"]))
                largest = float((x * x).sum(1).max(initial=0))
                if largest >= LARGEST:
                    raise ValueError("components too large: scores of these vectors would not fit into 64 bits")
                most = np.abs(x).max(initial=0)
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
                longs = [part[k].to_numpy(zero_copy_only=False).astype("<i8").tobytes() for k in ("key", "id", "label")]
                bounds = matrix(part["bounds"]).astype("<i8") if bounded else np.zeros((len(x), 0), "<i8")
                values = [*longs, x.astype(kind).tobytes(), kind, x.shape[1], len(x), largest, bounds.tobytes(), bounds.shape[1]]
                types = [*[pa.binary()] * 4, pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[s.strip().split(" ")[0] for s in schema.split(",")])

    return rows.select("key", "id", "label", "vector", *["bounds"] * bounded).mapInArrow(pack, schema)


def best_first(group: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each group with the highest scores, ties by the smaller `other`."""
    order = np.lexsort((other, -score, group))
    group, score, other = group[order], score[order], other[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    keep = place < k
    return group[keep], score[keep], other[keep]


class Best:
    """The best k rows so far for each slot of each anchor of a block."""

    def __init__(self, anchors: int, slots: int, k: int) -> None:
        self.k, self.slots = k, slots
        self.group, self.score, self.other = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(anchors * slots, np.iinfo(np.int64).min)  # below this score no row gets in any more

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        anchor, row = np.nonzero(allowed & (scores >= self.least[slot :: self.slots, None]))
        if not len(anchor):
            return
        parts = ((self.group, anchor * self.slots + slot), (self.score, scores[anchor, row]), (self.other, ids[row]))
        self.group, self.score, self.other = best_first(*[np.concatenate(p) for p in parts], self.k)
        full = np.bincount(self.group, minlength=len(self.least)) >= self.k
        lowest = np.full(len(self.least), np.iinfo(np.int64).max)
        np.minimum.at(lowest, self.group, self.score)
        self.least[full] = lowest[full]


def best_rows(anchors: DataFrame, rows: DataFrame, primes: list[int], k: int, groups: int, window: tuple[int, int] | None) -> DataFrame:
    """(key, slot, other, score): for each anchor and slot the best k rows of every task. Without a window there is one slot, for rows of the anchor's label that are not the anchor; with one, a slot for each bound b, for rows of another label with window[0] * b <= 100 * score <= window[1] * b."""
    dealt = rows.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))  # places in a stored table: alike if a task runs again
    copies = anchors.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    fields = ["keys", "ids", "labels", "vectors", "kind", "dims", "n", "bounds", "slots"]
    left = copies.select("g", *[F.col(c).alias(f"a_{c}") for c in fields])
    pairs = left.join(dealt.select("g", *[F.col(c).alias(f"b_{c}") for c in fields[1:7]]), "g").drop("g")

    def search(batches):
        held: OrderedDict[bytes, tuple] = OrderedDict()
        longs = lambda v: np.frombuffer(v, "<i8")

        def given(entry):
            keys, best = entry[0], entry[-1]
            arrays = [keys[best.group // best.slots], best.group % best.slots, best.other, best.score]
            return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in arrays], names=["key", "slot", "other", "score"])

        for batch in batches:
            for pair in batch.to_pylist():
                name = pair["a_keys"]
                if name not in held:
                    if len(held) == HELD:
                        yield given(held.popitem(last=False)[1])
                    x = np.frombuffer(pair["a_vectors"], pair["a_kind"]).reshape(pair["a_n"], pair["a_dims"])
                    bounds = longs(pair["a_bounds"]).reshape(pair["a_n"], pair["a_slots"])
                    slots = bounds.shape[1] if window else 1
                    held[name] = longs(name), longs(pair["a_ids"]), longs(pair["a_labels"]), bounds, residues(x, primes), Best(len(x), slots, k)
                held.move_to_end(name)
                _, ids, labels, bounds, a, best = held[name]
                y = np.frombuffer(pair["b_vectors"], pair["b_kind"]).reshape(pair["b_n"], pair["b_dims"])
                other, same = longs(pair["b_ids"]), labels[:, None] == longs(pair["b_labels"])
                scores = residue_products(a, residues(y, primes), primes)
                if window is None:
                    best.add(0, scores, other, same & (ids[:, None] != other))
                    continue
                for slot in range(bounds.shape[1]):
                    b = bounds[:, slot, None]
                    # An absent positive has the bound -1, which opens no window; nor does any negative score.
                    best.add(slot, scores, other, ~same & (100 * scores >= window[0] * b) & (100 * scores <= window[1] * b))
        for entry in held.values():
            yield given(entry)

    return pairs.mapInArrow(search, "key long, slot long, other long, score long")


def hard_negatives(rows: DataFrame, is_anchor, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor: a condition on the identifier column `id`, for example F.col("id") % 100 == 0. Scores are
    inner products of floor(scale * x). An anchor's positives are its first `positives` other rows of the
    same label; for each of them the first `negatives` rows of another label whose score lies between
    window[0] and window[1] percent of the positive's. Higher scores first, ties by the smaller identifier.

    Rows with a null identifier, label or vector or a null or non-finite component take no part. Vectors
    of different lengths are compared as if the shorter ended in zeros. Repeated rows count as so many
    rows; rows with the anchor's own identifier are not other rows. Without positives, negatives, anchors
    or rows there are no result rows. Vectors whose squares add up to 2**56 or more fail the job.
    """
    spark = rows.sparkSession
    label, identifier = F.col(label_col).cast("long"), F.col(id_col).cast("long")
    usable = finite_vectors(rows.where(label.isNotNull() & identifier.isNotNull()), vector_col, id=identifier, label=label)
    everything = stored(blocks_of(usable.withColumn("key", F.lit(0).cast("long")), ROWS, scale), "row_blocks")
    anchors = stored(usable.where(is_anchor).withColumn("key", F.monotonically_increasing_id()), "anchors")
    n, largest, size, chosen = *everything.agg(F.count("*"), F.max("largest"), F.sum(F.length("vectors"))).first(), anchors.count()
    primes = residue_primes(largest or 0)
    groups = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, (size or 0) // (GROUP_MB << 20))))
    dealt = anchors.repartition(max(1, -(-chosen // (8 * ANCHORS))), "key")

    found = best_rows(blocks_of(dealt, ANCHORS, scale), everything, primes, positives, groups, None)
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "other"))
    first = found.withColumn("slot", place.cast("long") - 1).where(F.col("slot") < positives)
    first = stored(first.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("key", "anchor_id", "slot", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Scores of an anchor's positives by slot, -1 where there is none.
    bounds = first.groupBy("key").pivot("slot", list(range(positives))).agg(F.max("positive_score"))
    bounds = bounds.select("key", F.array(*[F.coalesce(F.col(str(k)), F.lit(-1).cast("long")) for k in range(positives)]).alias("bounds"))
    found = best_rows(blocks_of(dealt.join(bounds, "key"), ANCHORS, scale), everything, primes, negatives, groups, window)
    place = F.row_number().over(W.partitionBy("key", "slot").orderBy(F.desc("score"), "other"))
    best = found.withColumn("rank", place).where(F.col("rank") <= negatives)
    out = best.join(first, ["key", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
