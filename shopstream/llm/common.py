"""Helpers of the corpus operators: shared work folder, fixed-size cell maps, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: Bytes of rows that go to a Python worker together, at most about so many.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or, where that is unset in local mode (tests), one of our own. A cluster without that setting is an error: its executors see no folder of the driver's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_OWN_DIR[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage in a way that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of stored() frames that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def docs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier and text alone, under fixed names: whatever other columns are called, they can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_column: str | Column = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the identifier as text, modulo 4, is 2 (a null identifier is held out too)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(True)) if isinstance(id_column, str) else held_out_column(id_column)


def held_out_column(identifier: Column) -> Column:
    return F.coalesce(F.crc32(identifier.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def in_cells(bits: np.ndarray, keys: np.ndarray, log2: int) -> np.ndarray:
    """Which 64-bit keys fall into marked cells of a packed map of 2**log2 bits."""
    at = (keys & np.uint64((1 << log2) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def id_cells(ids: DataFrame, column: str, log2: int) -> np.ndarray:
    """A map of 2**log2 bits (fixed size, whatever the number of ids) marking xxhash64(column). Used to leave out rows that a later exact join would drop."""
    mask = (1 << log2) - 1
    cell = F.xxhash64(column).bitwiseAND(F.lit(mask))
    rows = ids.select(cell.alias("c")).groupBy(F.shiftright("c", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros((mask + 1) // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)


def salted_join(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner", by: str | None = None, salts: int | None = None) -> DataFrame:
    """rows joined with a table of one row for each key, where a key may have a third of all rows: the rows of a key are dealt over `salts` partitions, and the key's row goes to each of them. They are dealt by the column `by`, or by their place in a stored() table, so that a task that runs again deals them alike. Without `salts` these are 16, more on a cluster of over 64 cores, 64 at most."""
    salts = salts or min(64, max(16, rows.sparkSession.sparkContext.defaultParallelism // 4))
    dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id() if by is None else F.xxhash64(by), F.lit(salts)))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): for each end of an edge the smallest id that it reaches.

    In each round every id points to its smallest neighbour or to itself, pointers are followed to their
    ends, and edges are drawn between these: edges within a part are gone, and at most half of the parts
    that still have edges are left. So the joins of all rounds grow with the edges, in groups of any size.
    Each round is written to the shared folder, so the lineage stays short and no links or components go
    to the driver.
    """
    left = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        ends = left.union(left.select("b", "a"))
        roots = stored(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "roots")
        while True:
            beyond = roots.select(F.col("id").alias("label"), F.col("label").alias("next"))
            ahead = stored(roots.join(beyond, "label").select("id", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "roots")
            dropped(roots)
            roots = ahead.select("id", "label")
            if not ahead.where("moved").limit(1).count():
                break
        held = labels
        labels = roots if held is None else stored(relabelled(held, roots), "labels")
        of = lambda end: roots.select(F.col("id").alias(end), F.col("label").alias(f"{end}_root"))  # noqa: E731, B023
        between = left.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
        rest = stored(between.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        dropped(left, *([] if held is None else [held, roots]))
        left = rest
        if not left.limit(1).count():
            dropped(left)
            return labels


def relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """labels (id, label) whose labels are followed to those that roots (id, label) has for them; what it does not name stays."""
    beyond = roots.select(F.col("id").alias("label"), F.col("label").alias("next"))
    return labels.join(beyond, "label", "left").select("id", F.coalesce("next", "label").alias("label"))


def in_batches(frame: DataFrame, run, returns: str) -> DataFrame:
    """frame.mapInArrow(run, returns) with batches of about BATCH_BYTES, or one row that is longer.

    The JVM holds a batch several times over outside its heap, as arrays that grow by doubling and as a message, and so does
    the worker; Spark's own limit of 64 MB, in each task, is a large part of an executor's overhead. Spark reads the limit
    where a plan is run, so it stays set in the session; a smaller one that is set already is kept.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"([0-9]+)([kmgtp]?)i?b?", conf.get(key).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return frame.mapInArrow(run, returns)


def text_map(docs: DataFrame, text_col: str, keep: list[str], make, returns: str) -> DataFrame:
    """Rows of docs as a struct `row` of the columns `keep`, and beside it the columns `returns` that a function of the texts gives.

    make() is called once in each task and gives a function from a string array (a bounded slice of
    rows, see textvec.slices) to the arrays of the result columns. Order and number of rows are kept.
    A text that is kept goes to the worker once, within its row.
    """
    import pyarrow as pa

    from .textvec import release, slices

    if not keep:
        rows = F.struct(F.lit(1).alias("none"))
    else:
        rows = F.struct(*[F.col(f"`{c}`") for c in keep])
    frame = docs.select(rows.alias("row"), F.col(text_col).cast("string").alias("text"))
    row_type = frame.schema["row"].dataType.simpleString() if all(c.isidentifier() for c in keep) else None
    if row_type is None:
        row_type = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in frame.schema["row"].dataType.fields) + ">"
    names = [part.strip().split(" ")[0] for part in _top_level(returns)]
    within = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string" else None
    if within is not None:
        frame = frame.select("row")

    def run(batches):
        work = None
        for batch in batches:
            row = batch.column(0)
            text = batch.column(1) if within is None else row.field(within)
            for lo, hi in slices(text):
                work = work or make()
                yield pa.RecordBatch.from_arrays([row.slice(lo, hi - lo), *work(text.slice(lo, hi - lo))], names=["row", *names])
            release()

    return in_batches(frame, run, f"row {row_type}, {returns}")


def _top_level(schema: str) -> list[str]:
    """Parts of a schema string between its outer commas."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
