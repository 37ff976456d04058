"""Hard negatives, Hilbert shards and whitening against plain Python, and their edges."""

from __future__ import annotations

import itertools
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shopstream.llm import hard_negatives, hilbert_shards, queries, whitening

NAN, INF = float("nan"), float("inf")


def test_residue_products_are_exact():
    rng = np.random.default_rng(3)
    for span, d in ((200, 64), (5000, 130), (1 << 24, 200), (3, 1)):
        a, b = rng.integers(-span, span + 1, (7, d)), rng.integers(-span, span + 1, (9, d + 5))
        b[:, d:] = 0
        a[0], b[0, :d] = span, -span  # the largest sums
        primes = hard_negatives.residue_primes(float(d * span * span))
        assert math.prod(primes) > 2 * d * span * span and len(primes) >= 2 - (span < 10)
        got = hard_negatives.residue_products(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v[:d], strict=True)) for v in b] for u in a]


def mined(rows, every, positives, negatives, window):
    """Plain Python over (id, label, vector) rows."""
    whole = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, l, v in whole:
        if i % every:
            continue
        rest = sorted((-score(v, w), j, m) for j, m, w in whole if j != i)
        for s, j, _ in [r for r in rest if r[2] == l][:positives]:
            inside = [r for r in rest if r[2] != l and window[0] * -s <= 100 * -r[0] <= window[1] * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_by_hand(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 16)  # many blocks; the tasks' code gets the values packed here
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), np.round(rng.normal(size=6), 1).tolist()) for i in range(120)]
    rows[7:9] = [(7, rows[7][1], rows[40][2]), (8, rows[8][1], rows[40][2])]  # ties
    rows += [(200, None, [1.0] * 6), (210, 1, None), (220, 1, [1.0, NAN]), (230, 1, [1.0, None]), (240, 1, [INF]), (None, 1, [1.0] * 6), (250, 1, [2.0, 1.0]), (260, 9, []), (270, 5, [1.0] * 6)]
    rows += [rows[50], rows[50], rows[30]]  # repeated rows count, a repeated anchor too
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, key string").repartition(4)
    got = hard_negatives.hard_negatives(frame, F.col("id") % 10 == 0, positives=3, negatives=4).collect()
    want = mined(rows, 10, 3, 4, (30, 90))
    assert sorted(map(tuple, got)) == want and len(want) > 50
    empty = hard_negatives.hard_negatives(frame.limit(0), F.col("id") % 10 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_scores_that_do_not_fit_fail(spark):
    with pytest.raises(Exception, match="too large"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e7])], "vec_id long, label int, embedding array<double>"), F.col("id") == 0).count()


def test_op11_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(queries.OP11_SQL).fetchdf()
    got = queries.op11_hard_negatives(spark, sf_dir).toPandas()[list(want.columns)]
    assert len(want) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 2), (1, 4), (2, 1)])
def test_the_curve_visits_each_cell_once_and_moves_to_neighbours(spark, n, bits):
    cells = [list(c) for c in itertools.product(range(1 << bits), repeat=n)]
    rows = spark.createDataFrame([(c,) for c in cells], "c array<int>").select("c", hilbert_shards.hilbert_index(F.col("c"), n, bits).alias("h")).collect()
    path = [r.c for r in sorted(rows, key=lambda r: r.h)]
    assert sorted(r.h for r in rows) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in itertools.pairwise(path))


def test_shards_are_runs_of_the_curve(spark, sf_dir):
    rows = queries.op12_hilbert_shards(spark, sf_dir).toPandas().sort_values(["shard", "slot"])
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(rows.doc_id) == sorted(texts) and rows.curve_index.is_monotonic_increasing
    assert (rows["size"] == [len(texts[i].encode()) + 1 for i in rows.doc_id]).all() and (rows.text_crc32 == [zlib.crc32(texts[i].encode()) for i in rows.doc_id]).all()
    counts = rows.groupby("shard").slot.agg(["count", "min", "max"])
    assert set(counts.index) == set(range(8)) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and rows.grown_shard.isna().all()


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None, NAN), (None, None, None, NAN), (1, "", "z", INF), (1, "naïve中", "z", -INF), (2, "a", None, 0.0), (2, "a", None, 0.0), (3, "ab", "\U0001f600", 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, place string, shard double")
    placed = hilbert_shards.cut_runs(hilbert_shards.hilbert_places(frame, ["lang", "place", "shard"], "doc_id", {"doc_id": F.col("doc_id"), "text": F.col("lang")}), 3).collect()
    assert sorted(r.place for r in placed) == list(range(7)) and sorted((r.shard, r.slot) for r in placed) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert sorted(str(r.doc_id) for r in placed) == sorted(str(r[0]) for r in rows)
    assert hilbert_shards.hilbert_places(frame.limit(0), ["lang"], "doc_id", {"doc_id": F.col("doc_id")}).count() == 0
    alike = spark.createDataFrame([(1, "a")] * 40, "doc_id long, lang string")  # more shards than different rows
    assert sorted(r.place for r in hilbert_shards.hilbert_places(alike, ["lang"], "doc_id", {"doc_id": F.col("doc_id")}).collect()) == list(range(40))


def test_strings_are_cut_in_their_order(spark):
    names = ["src1", "src10", "src2", "src", "srd", "srcé", "src19"]
    curve = hilbert_shards.fit_curve(spark.createDataFrame([(n,) for n in names], "s string"), ["s"])
    rows = spark.createDataFrame([(n,) for n in names], "s string").select("s", curve.values[0].alias("v"), curve.index().alias("h")).collect()
    assert [r.s for r in sorted(rows, key=lambda r: r.v)] == sorted(names) and len({r.h for r in rows}) == len(names)


def test_written_shards_prune(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("shard", F.lit("own"))
    name = hilbert_shards.write_shards(docs, f"file://{tmp_path}/out", queries.SHARD_DIMENSIONS, shards=4, file_rows=20)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert name == "shard_" and sorted(back.columns) == sorted([*docs.columns, "shard_"]) and back.count() == docs.count() == back.select("doc_id").distinct().count()
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.min("n_chars").alias("a"), F.max("n_chars").alias("b")).collect()
    assert max(f.n for f in files) <= 20
    assert sum(f.langs for f in files) / len(files) < 0.75 * docs.select("lang").distinct().count()  # files skip languages


def fitted(vectors, weights):
    x = np.floor(1024 * np.asarray(vectors, float)) + 100_000
    mean = np.average(x, axis=0, weights=weights)
    covariance = (x - mean).T @ ((x - mean) * np.asarray(weights)[:, None]) / np.sum(weights)
    values, axes = np.linalg.eigh(covariance)
    return x, mean, covariance, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("by_count", [True, False])
def test_whitening_equals_numpy(spark, by_count):
    rng = np.random.default_rng(6)
    distinct = rng.normal(size=(40, 12)) * np.arange(1, 13)
    counts = rng.integers(1, 4, 40)
    counts[3] = 200  # one vector holds most rows
    rows = [(1000 * g + k, v.tolist()) for g, (v, c) in enumerate(zip(distinct, counts, strict=True)) for k in range(c)]
    odd = [(-1, None), (-2, [NAN] * 12), (-3, [1.0] * 11 + [None]), (-4, [INF] * 12)]
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows + odd], "vec_id long, embedding array<double>, x string, weight int").repartition(5)
    got = whitening.whitened(frame, by_count=by_count).toPandas()
    weights = counts if by_count else np.ones(40)
    x, mean, covariance, values, axes = fitted(distinct, weights)
    assert len(got) == 8 * len(rows) and set(got.n) == {int(weights.sum())} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values[:8] / np.trace(covariance), rtol=1e-9)
    table = got.pivot(index="row_id", columns="component", values="whitened")
    want = (x - mean) @ axes[:, :8] / np.sqrt(values[:8])
    for row_id, z in table.iterrows():
        assert np.allclose(np.abs(z), np.abs(want[row_id // 1000]), atol=1e-8)
    signs = np.sign((table.loc[[1000 * g for g in range(40)]].to_numpy() * want).sum(0))
    assert np.allclose(table.loc[[1000 * g for g in range(40)]].to_numpy() * signs, want, atol=1e-8)
    n, s = int(weights.sum()), [int(v) for v in (x * np.asarray(weights)[:, None]).sum(0)]
    exact = {g: sum((n * int(a) - b) ** 2 for a, b in zip(x[g], s, strict=True)) for g in range(40)}
    assert all(int(r.deviation_exact) == exact[r.row_id // 1000] == int(r.deviation) for r in got.itertuples()) and all(r.weight == counts[r.row_id // 1000] for r in got.itertuples())


def test_whitening_without_variance(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (2, [1.0, 3.0, 5.0]), (None, [1.0, 3.0])], "vec_id long, embedding array<double>")
    rows = whitening.whitened(frame).collect()  # two dimensions vary, the short vector ends in a zero
    assert len(rows) == 4 * 3 and [r.whitened is None for r in sorted(rows, key=lambda r: r.component)] == [False] * 8 + [True] * 4
    one = whitening.whitened(frame.limit(1)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 0, None, None, None) for k in (1, 2, 3)]
    assert whitening.whitened(frame.limit(0)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).count() == 0


def test_a_deviation_beyond_64_bits_is_null(spark):
    rows = whitening.whitened(spark.createDataFrame([(k, [1e8 * (k % 3), float(k)]) for k in range(9)], "vec_id long, embedding array<double>")).toPandas()
    assert rows.deviation.isna().any() and rows.deviation_exact.notna().all() and rows.identity_error[0] < 1e-4
