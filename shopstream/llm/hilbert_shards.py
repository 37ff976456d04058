"""Operator 12, sharding along a Hilbert curve (native: DataFrame functions only).

Metadata columns are quantised to a few bits each, at quantiles of all rows and in their own order, and a
row's cell gets its index on the Hilbert curve through all cells. Rows are ordered by that index and cut
into runs of equal counts, so a shard, and each file of it, covers a narrow range of every dimension and
min/max statistics prune it for predicates on any of them.

The place of a row in the order needs no global sort: rows of a cell are dealt by a hash of their
identifier, the more parts the more rows there are; the counts of the parts give each part's first place,
and rows are numbered within their part. So a cell that holds a third of all rows is many parts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window as W

#: Rows of a cell's part on average if one cell held all rows; fewest parts of a cell.
PART_ROWS, LEAST_PARTS = 1 << 20, 64
#: Characters of a string, after those that all values share, that its order is taken from; each counts as a digit to this base.
DIGITS, DIGIT_BASE = 3, 1 << 16


def digits(text: Column, skip: int) -> Column:
    """The DIGITS characters after the first `skip` as one number, ordered as the strings are (characters beyond 2**16 - 2 count as the last)."""
    place = lambda k: F.coalesce(F.least(F.ascii(F.substring(text, skip + 1 + k, 1)) + 1, F.lit(DIGIT_BASE - 1)), F.lit(0))
    value = lambda k: F.when(F.length(text) > skip + k, place(k)).otherwise(0).cast("long")
    return sum((value(k) * DIGIT_BASE ** (DIGITS - 1 - k) for k in range(DIGITS)), F.lit(0).cast("long"))


def shared_length(least: str | None, most: str | None) -> int:
    """Characters that all values between least and most begin with."""
    pairs = zip(least or "", most or "", strict=False)
    return next((i for i, (a, b) in enumerate(pairs) if a != b), min(len(least or ""), len(most or "")))


@dataclass
class Curve:
    """Numbers that stand for the dimensions, where to cut each, bits of each."""

    values: list[Column] = field(default_factory=list)
    cuts: list[list[float]] = field(default_factory=list)
    bits: int = 4
    rows: int = 0

    def cell(self) -> Column:
        """Coordinates of a row's cell: how many cuts lie below its value, spread over the range where there are fewer cuts; nulls are in the first."""
        below = lambda value, cuts: F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value)) if cuts else F.lit(0)
        spread = lambda value, cuts: F.floor(F.greatest(below(value, cuts), F.lit(0)) * F.lit(1 << self.bits) / F.lit(len(cuts) + 1)).cast("int")
        return F.array(*[F.when(v.isNull(), 0).otherwise(spread(v, c)) for v, c in zip(self.values, self.cuts, strict=True)])

    def index(self) -> Column:
        return hilbert_index(self.cell(), len(self.values), self.bits)


def fit_curve(rows: DataFrame, dimensions: list[str], bits: int = 4) -> Curve:
    """Cuts at the 2**bits quantiles of each dimension over all rows: numbers, dates and timestamps by value, strings in their order. Two aggregates, whose results are a few numbers; no other columns are read."""
    texts = [d for d in dimensions if isinstance(rows.schema[d].dataType, StringType)]
    ends = rows.agg(F.count("*").alias("n"), *[f(d).alias(f"{name}{k}") for k, d in enumerate(texts) for name, f in (("least", F.min), ("most", F.max))]).first()
    skip = {d: shared_length(ends[f"least{k}"], ends[f"most{k}"]) for k, d in enumerate(texts)}

    def number(d: str) -> Column:
        if d in skip:
            return F.when(F.col(d).isNotNull(), digits(F.col(d), skip[d])).cast("double")
        kind = rows.schema[d].dataType.typeName()
        return F.unix_date(F.col(d)).cast("double") if kind == "date" else F.col(d).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(d).cast("double")

    values = [F.nanvl(number(d), F.lit(None).cast("double")) for d in dimensions]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"q{k}") for k, v in enumerate(values)]).first()
    return Curve(values, [sorted(set(c or [])) for c in cuts], bits, ends["n"])


def hilbert_index(cell: Column, n: int, bits: int) -> Column:
    """Place (long) of a cell of n coordinates of `bits` bits on the Hilbert curve, by Skilling's transformation (AIP Conf. Proc. 707, 2004)."""
    at = lambda x, i: F.element_at(x, i + 1)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        """Inverts or exchanges the low bits of the first coordinate by the bit q of coordinate i."""
        low = s["q"] - 1
        inverted = at(x, s["i"]).bitwiseAND(s["q"]) != 0
        swap = at(x, F.lit(0)).bitwiseXOR(at(x, s["i"])).bitwiseAND(low)
        return F.transform(x, lambda v, k: F.when(inverted, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, cell, undo) if bits > 1 else cell
    start = F.array().cast("array<int>")
    gray = F.aggregate(turned, start, lambda out, v: F.concat(out, F.array(v.bitwiseXOR(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0))))))
    # The last coordinate's bits flip the lower bits of all coordinates. `gray` is bound once by the transform around it.
    flips = lambda g: F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda t, q: F.when(at(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)) if bits > 1 else F.lit(0)
    flipped = F.transform(F.array(gray), lambda g: F.struct(g.alias("g"), flips(g).alias("t")))
    planes = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    woven = lambda f: F.aggregate(planes, F.lit(0).cast("long"), lambda out, s: out * 2 + F.when(at(f["g"], s["i"]).bitwiseXOR(f["t"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))
    return F.get(F.transform(flipped, woven), 0)


def hilbert_places(docs: DataFrame, dimensions: list[str], id_col: str, keep: dict[str, Column], bits: int = 4) -> DataFrame:
    """The columns `keep` of docs with curve_index, place (long, from 0, gapless over all rows) and n_rows.

    Order: by curve index, then by a hash of the identifier, then by identifier and the kept columns.
    Every row has a place: nulls in dimensions count as the least value, a null or repeated identifier
    shares its part; rows that are alike in all kept columns are exchangeable. An empty table gives an
    empty one. Only dimensions and identifier are read for the places, `keep` is shuffled once.
    """
    curve = fit_curve(docs, dimensions, bits)
    parts = max(LEAST_PARTS, -(-curve.rows // PART_ROWS))
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)).cast("int")
    counts = docs.select(curve.index().alias("curve_index"), part.alias("__part")).groupBy("curve_index", "__part").agg(F.count("*").alias("n"))
    # At most 2**(bits * dimensions) cells are ordered in one task and broadcast; parts are summed up within their cell.
    cells = counts.groupBy("curve_index").agg(F.sum("n").alias("m"))
    cells = cells.select("curve_index", (F.sum("m").over(W.orderBy("curve_index")) - F.col("m")).alias("before"))
    within = F.sum("n").over(W.partitionBy("curve_index").orderBy("__part")) - F.col("n")
    first = counts.withColumn("within", within).join(F.broadcast(cells), "curve_index").select("curve_index", "__part", (F.col("before") + F.col("within")).alias("__first"))
    rows = docs.select(curve.index().alias("curve_index"), part.alias("__part"), F.col(id_col).alias("__id"), *[c.alias(name) for name, c in keep.items()])
    order = ["__id", *[name for name, _ in rows.dtypes if name in keep and not dict(rows.dtypes)[name].startswith("map")]]
    number = F.row_number().over(W.partitionBy("curve_index", "__part").orderBy(*[F.col(f"`{c}`") for c in order]))
    placed = rows.withColumn("__number", number).join(first, ["curve_index", "__part"])
    return placed.select(*[F.col(f"`{c}`") for c in keep], "curve_index", (F.col("__first") + F.col("__number") - 1).alias("place"), F.lit(curve.rows).cast("long").alias("n_rows"))


def cut_runs(placed: DataFrame, shards: int) -> DataFrame:
    """placed with shard (int) and slot (long): runs of the order, whose counts differ by one at most."""
    rows = placed.withColumn("shard", F.expr(f"cast((place * {shards}L) div n_rows as int)"))
    return rows.withColumn("slot", F.expr(f"place - (shard * n_rows + {shards - 1}L) div {shards}L"))


def write_shards(docs: DataFrame, path: str, dimensions: list[str], id_col: str = "doc_id", shards: int = 8, bits: int = 4, file_rows: int = 100_000) -> str:
    """Writes docs, all columns, as Parquet under path/shard=N: files of at most file_rows rows, in curve order, with narrow min/max statistics of every dimension. The folder's column is `shard`, with underscores after it where docs has one of that name; it is returned."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    keep = {"row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}  # as one column: whatever docs' columns are called, they stay
    placed = cut_runs(hilbert_places(docs, dimensions, id_col, keep, bits), shards).withColumn("file", F.expr(f"slot div {file_rows}L"))
    files = placed.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot")
    files.select(F.col("shard").alias(name), "row.*").write.option("maxRecordsPerFile", file_rows).partitionBy(name).parquet(path)
    return name
