"""Components and crossing pairs: what a large group costs grows with its edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopstream.llm import common, ngram_join


def joined_up(edges):
    label = {i: i for e in edges for i in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components_of_odd_shapes(spark, kind):
    rng = random.Random(7)
    edges = {"path": [(i, i + 1) for i in range(-3, 40)] + [(100, 99)], "star": [(50, i) for i in range(40)] + [(60, 60), (61, 62), (62, 61)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]}[kind]
    got = {r.id: r.label for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = joined_up(edges)
    assert all(want[i] == i and not any(i in e and e[0] != e[1] for e in edges) for i in want.keys() - got.keys()) and all(want[i] == x for i, x in got.items())


def test_more_links_join_components(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "id long, label long")
    got = ngram_join.with_links(labels, spark.createDataFrame([(6, 2), (9, 20), (30, 31), (1, 2)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8), (20, 8), (30, 30), (31, 30)]


def test_edges_within_a_part_are_read_once(spark, monkeypatch):
    sizes = []
    stored = common.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(common, "stored", counted)
    common.connected(spark.range(1, 300).select((F.col("id") % 5).alias("a"), F.col("id").alias("b")))
    assert sizes[0] > 280 and sum(sizes[1:]) < 10


def test_a_list_of_unlike_sets_makes_no_pairs(spark):
    rng = np.random.default_rng(3)
    n = 900  # SMALL maps of 256 bits can't tell such sets apart
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(30)]
    sets.append(np.sort(np.concatenate([sets[0][:-20], rng.integers(0, 2**63, 20, dtype=np.uint64)])))
    small = [ngram_join.parity_of(s, 64 * len(ngram_join.SMALL)).tolist() for s in sets]
    lists = spark.createDataFrame([(1, i, len(s), 0, *small[i]) for i, s in enumerate(sets)], "sig long, set_id long, n int, v int, " + ", ".join(f"{p} long" for p in ngram_join.SMALL))
    wanted = spark.range(len(sets)).select(F.col("id").alias("set_id"), F.col("id").alias("rep"))
    tokens = spark.createDataFrame([(i, i, ngram_join.parity_of(s).tolist()) for i, s in enumerate(sets)] * 2, "rep long, set_id long, parity array<long>")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "id long, label long")
    fits = sum(1 for i in range(30) for j in range(i) if sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(small[i], small[j])) <= 2 * n - 2 * -(-80 * 2 * n // 180))
    assert fits > 300  # what the small maps alone would let through
    got = ngram_join._crossing(lists, wanted, labels, tokens, 80)
    assert [tuple(r) for r in got.collect()] == [(0, 30)]
