"""The counts of operator 5 against a plain recount: different texts with each term, copies counted once."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from shopstream.llm import pii


def recount(texts):
    held = defaultdict(set)
    for text in set(texts) - {None}:
        for word in re.split(r"[\W\d_]+", text.lower()):
            if 3 <= len(word) <= 40:
                held[word].add(text)
    return {term: len(of) for term, of in held.items()}


def counted(spark, texts, wanted):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    terms = spark.createDataFrame([(t,) for t in wanted], "term string")
    return {r.term: r.n_term for r in pii.term_counts(pii.find_entities(docs, ["doc_id"]), docs, "text", terms).collect()}


def test_copies_count_once_and_only_wanted_terms_are_moved(spark):
    texts = ["Ann Lee, ann@x.org, oak beam"] * 7 + ["oak oak door", "Oak door", "oak door", "", None, None, "beam 12 of oak", "beam 12 of oak"] + [f"oak number{i}x word" for i in range(40)]
    want = recount(texts)
    got = counted(spark, texts, ["oak", "beam", "door", "ann", "absent"])
    assert {t: got.get(t) for t in ("oak", "beam", "door", "ann", "absent")} == {t: want.get(t) for t in ("oak", "beam", "door", "ann", "absent")}
    assert "word" not in got


def test_counts_of_a_table_equal_a_recount(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += texts[:50]
    want = {t: n for t, n in recount(texts).items() if t.isascii()}
    got = counted(spark, texts, list(want))
    assert {t: got.get(t) for t in want} == want


def test_no_rows_and_no_copies(spark):
    assert counted(spark, [None, "", "oak"], ["oak"]) == {"oak": 1}
    empty = spark.createDataFrame([], "doc_id long, text string")
    found = pii.find_entities(empty, ["doc_id"])
    assert pii.term_counts(found, empty, "text", spark.createDataFrame([("oak",)], "term string")).count() == 0


def test_a_map_marks_every_value_it_was_made_of(spark):
    rows = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("term"))
    cells = pii.cell_map(rows.where("term < 't3'"), "term")
    assert pii.marked(rows, "term", cells).where("term < 't3'").count() == rows.where("term < 't3'").count()
    hit, left = pii.marked(rows, "term", cells).count(), pii.marked(rows, "term", cells, wanted=False).count()
    assert hit + left == 5000 and left > 0.9 * rows.where("term >= 't3'").count()
