"""Operator 13, whitening of embeddings by weighted multiplicity covariance.

Entries become whole numbers x, so equal vectors are found exactly. Identical x vectors are grouped and
counted; the distinct ones, with their counts as weights, have the same mean and covariance as all rows.
Every task centres its distinct vectors by the exact mean and multiplies them, weighted, by one matrix
product; the parts are summed up by rows of the matrix. The driver gets d x d numbers and finds the
components. Each distinct vector is whitened once and goes back to its rows by a join.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored
from .vectors import finite_vectors, matrix

#: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Groups of more than one in so many of all rows, so at most as many groups, are dealt over SALTS partitions in the last join.
HEAVY, SALTS = 4096, 64
#: Eigenvalues below this share of the largest are zero to double precision.
RANK_SHARE = 1e-13


def whole(vector: Column) -> Column:
    """x of every entry; finite entries of 2**42 or more fail the job. (Rows with others are filtered out, but Spark may compute x before.)"""
    large = F.raise_error(F.lit("vector entry of 2**42 or more")).cast("long")
    return F.transform(vector, lambda c: F.when(F.abs(c) < 2.0**42, F.floor(c * SCALE) + OFFSET).when(F.abs(c) < float("inf"), large))


def summed(parts: DataFrame) -> np.ndarray:
    """Sum of the arrays `v` (array<double>) for each `i`, as rows of a matrix in order of i. parts has a row for each i and task; they are added up where they meet, and the driver gets one for each i."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["i", "v"])

    rows = parts.repartition("i").mapInArrow(add, "i int, v array<double>").collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def weighted_products(groups: DataFrame, column: str, make) -> np.ndarray:
    """Sum over rows of `groups` of weight * z z', z being a row of make(matrix of `column`); a first column of ones gives the sums of z and of the weights."""

    def products(batches):
        total = None
        for batch in batches:
            z = make(matrix(batch.column(0)))
            z = np.hstack([np.ones((len(z), 1)), z])
            part = z.T @ (z * batch.column(1).to_numpy().astype(np.float64)[:, None])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    return summed(groups.select(column, "weight").mapInArrow(products, "i int, v array<double>"))


def principal_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; eigenvalues that are zero to double precision are 0."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    return np.where(values > RANK_SHARE * max(values[0], 0), values, 0.0)[:most], vectors[:, :most]


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, by_count: bool = True) -> DataFrame:
    """(row_id, component int from 1, n, deviation, deviation_exact, weight, whitened, explained, identity_error): one row for each finite vector of rows and component.

    by_count: the fit's weights are the counts of the vectors, so it is the fit of all rows; else 1, the
    fit of the distinct ones, and n is their number. deviation: sum over dimensions of (n x - S)^2, exact;
    null where it does not fit into a long, deviation_exact (a decimal) always has it. weight: rows that
    have this vector.

    Rows with a null vector or a null or non-finite entry are left out. Shorter vectors are filled up with
    zeros to the longest one's length. Repeated rows and null identifiers each keep their rows. A
    component without variance (fewer different vectors than components, constant vectors) has whitened
    null, explained 0 (null if nothing varies) and no part in identity_error, which is null if there is
    no other. An empty table, or only empty vectors, gives no rows. An entry of 2**42 or more fails the job.
    """
    keyed = finite_vectors(rows, vector_col, row_id=F.col(id_col)).select("row_id", whole(F.col("vector")).alias("x"))
    width = keyed.agg(F.max(F.size("x"))).first()[0] or 0
    keyed = keyed.withColumn("x", F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("x"))))
    groups = stored(keyed.groupBy("x").agg(F.count("*").alias("count")).withColumn("weight", F.col("count") if by_count else F.lit(1).cast("long")), "groups")
    # Exact whole numbers: n and S.
    sums = groups.select("weight", F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum("weight").alias("n"), F.sum(F.col("weight").cast("decimal(38,0)") * F.col("x")).alias("s")).orderBy("k").collect()
    n, s = (sums[0]["n"] if sums else 0), [int(r["s"]) for r in sums]
    base = np.array([v // n for v in s], np.int64)  # whole part of the mean; rest / n is its fraction
    rest = np.array([v % n for v in s], np.int64)
    centred = lambda x: (x - base) - rest / n
    covariance = weighted_products(groups, "x", centred)[1:, 1:] / n if sums else np.zeros((0, 0))
    values, vectors = principal_components(covariance, components) if sums else (np.zeros(0), covariance)
    scales = np.sqrt(np.where(values > 0, values, np.inf))
    whiten = lambda x: centred(x) @ vectors / scales
    rest_square = sum(int(r) ** 2 for r in rest)

    def apply(batches):
        for batch in batches:
            x = matrix(batch.column(0))
            y = x - base
            # sum (n y - rest)^2 = n^2 sum y^2 - 2 n sum y rest + sum rest^2, in whole numbers of any size
            squares, cross = exact_dot(y, y), exact_dot(y, np.broadcast_to(rest, y.shape))
            exact = [n * n * a - 2 * n * b + rest_square for a, b in zip(squares, cross, strict=True)]
            z = whiten(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)), pa.array(z.tolist(), pa.list_(pa.float64()))], names=["x", "count", "weight", "deviation_exact", "z"]
            )

    whole_groups = stored(groups.mapInArrow(apply, "x array<bigint>, count bigint, weight bigint, deviation_exact decimal(38,0), z array<double>"), "whitened")
    dropped(groups)
    error = None
    used = values > 0
    if used.any():
        moments = weighted_products(whole_groups, "z", lambda z: z[:, used])
        mean = moments[0, 1:] / n
        error = float(np.abs(moments[1:, 1:] / n - np.outer(mean, mean) - np.eye(used.sum())).max())
    trace = float(np.trace(covariance))
    joined = back_to_rows(keyed, whole_groups, sum_of_counts(sums, by_count, whole_groups))
    explained = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values]).cast("array<double>")
    out = joined.select("row_id", "deviation_exact", F.col("count").alias("weight"), F.posexplode("z").alias("k", "whitened"))
    fits = F.col("deviation_exact") <= F.lit(Decimal(2**63 - 1))
    live = F.array(*[F.lit(bool(u)) for u in used]).cast("array<boolean>")
    return out.select(
        "row_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.when(fits, F.col("deviation_exact").cast("long")).alias("deviation"), "deviation_exact", "weight",
        F.when(F.get(live, F.col("k")), F.col("whitened")).alias("whitened"), F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def sum_of_counts(sums: list, by_count: bool, groups: DataFrame) -> int:
    """Number of all rows."""
    return (sums[0]["n"] if sums else 0) if by_count else (groups.agg(F.sum("count")).first()[0] or 0)


def exact_dot(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Row by row the inner product of whole numbers, as Python integers where 64 bits might not hold it."""
    if len(a) and a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**62:
        return (a * b).sum(1).tolist()
    return [sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True)]


def back_to_rows(keyed: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """keyed with the columns of its row in groups, joined by x. Rows of the few vectors that are most of the rows are dealt over SALTS partitions by their identifier, to each of which their group goes."""
    heavy = groups.where(F.col("count") > max(n // HEAVY, 1)).select(F.xxhash64("x").alias("h"), F.lit(SALTS).alias("salts"))  # at most HEAVY rows
    marked = lambda df: df.withColumn("h", F.xxhash64("x")).join(F.broadcast(heavy.distinct()), "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = marked(keyed).select("x", "h", F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int").alias("salt"), "row_id")
    right = marked(groups).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return left.join(right, ["h", "salt", "x"]).drop("h", "salt", "salts")
