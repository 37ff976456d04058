"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopstream.llm import language_id, license_scan, ngram_join, packing, pii, quality_classifier, quality_rules, toxicity, warc
from shopstream.llm.decontaminate import benchmark_matches, decontaminated
from shopstream.llm.queries import packing_digest, word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, row string, score string, spans string, label string, n_words string, g string, tokens string"
LONG = "lorem ipsum dolor " * 20_000 + "a@b.co " + "9" * 3000 + " " + "1 " * 6000
TEXTS = [(1, "one two three four five six seven eight nine ten eleven"), (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, " \n\t "), (None, "Null id here a@b.co"), (5, LONG), (6, "!!! 123 ###"), (7, "naïve café\x00 ünï €<|endoftext|> it's")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 6 else "en", "s", *"abcdefg") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")


def run_all(docs, labels, benchmark):
    return {
        "1": ngram_join.ngram_components(docs, size=4, percent=85),
        "2": license_scan.scan_licenses(docs, ["doc_id", "row"]),
        "3": toxicity.toxicity_scores(docs, toxicity.fit_toxicity_model(docs, labels), ["doc_id", "score"]),
        "4": language_id.identify(docs, language_id.fit_language_model(docs), ["doc_id", "row"]),
        "5": pii.personal_data(docs, ["doc_id", "spans"]),
        "6": benchmark_matches(docs, benchmark, ["doc_id", "n_words"]),
        "7": quality_rules.quality_rules(docs, ["doc_id", "g", "row"]),
        "10": quality_classifier.quality_scores(docs, quality_classifier.fit_subword_model(docs, labels), ["doc_id", "score"]),
    }


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "five six"), (2, None), (3, ""), (None, "one two"), (4, "zzz yyy")], "item_id long, text string")


def test_every_row_has_its_row(docs, labels, benchmark):
    for name, out in run_all(docs, labels, benchmark).items():
        assert out.count() == len(TEXTS), name


def test_empty_tables(docs, labels, benchmark):
    none = docs.limit(0)
    for name, out in run_all(none, labels.limit(0), benchmark.limit(0)).items():
        assert out.count() == 0, name
    assert packing.packed(none, word_tokenizer()).count() == 0
    assert decontaminated(none, benchmark).columns == docs.columns
    assert warc.read_archives(warc.write_archives(none.select(F.col("doc_id").alias("page_id"), F.col("row").alias("url"), F.col("text").alias("html")))).count() == 0


def test_documents_without_words_are_their_own_component(docs):
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, size=4, percent=85).collect()]
    assert sorted(x for x in out if x[0] in (1, 2, 3, 4)) == [(1, 8, 1), (1, 8, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4)]
    assert [x[2] for x in out if x[0] is None] == [None]


def test_near_copies_leave_one_row_and_all_columns(docs):
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 6, 7)] + [(True, 0)]


def test_texts_without_letters_are_und(docs):
    out = {r.row.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit_language_model(docs), ["doc_id"]).collect()}
    assert {i: out[i] for i in (2, 3, 4, 6)} == dict.fromkeys((2, 3, 4, 6), "und") and out[1] == "en"


def test_decontamination_keeps_the_rest(docs, benchmark):
    assert sorted(str(r.doc_id) for r in decontaminated(docs, benchmark).collect()) == sorted(map(str, (2, 3, 4, None, 5, 6, 7)))


def test_packing_of_odd_texts_is_whole(docs):
    rows = packing_digest(packing.packed(docs, word_tokenizer(), size=64, n_open=3)).toPandas()
    assert rows[rows.doc_id.isin([2, 3, 4])].doc_tokens.tolist() == [1, 1, 1]
    whole = rows[rows.doc_id == 5].sort_values("start")
    assert (whole.start.values[1:] == (whole.start + whole.length).values[:-1]).all() and whole.length.sum() == whole.doc_tokens.iloc[0]
    assert rows.groupby("sequence_id").length.sum().max() <= 64


def test_codewords_stay_apart_however_many_languages():
    for n in (2, 4, 20, 50, 170, 1024, 2048):
        codes = language_id.codewords(n, language_id.bits_for(n))
        gram = codes @ codes.T - codes.shape[1] * np.eye(n, dtype=int) * 2  # the diagonal far below
        assert (codes.shape[1] - gram.max()) // 2 >= 5, n


def test_many_languages_are_told_apart(spark):
    """80 made languages of their own syllables, more than 15 bits can keep apart."""
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(80):
        syllables = ["".join(rng.choice(list(letters), 3)) for _ in range(12)]
        rows += [(k * 20 + i, " ".join(rng.choice(syllables, 40)), f"l{k:02}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs)
    assert model.codes.shape == (80, 42)
    found = language_id.identify(docs, model, ["doc_id", "lang"]).select("row.*", "lang_pred")
    held = found.where("pmod(crc32(cast(doc_id as string)), 4) = 2").collect()
    assert len(held) > 300 and sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held)
