"""What a review found missing, on small fixtures."""

from __future__ import annotations

import re

import pyarrow as pa

from shopstream.llm import common, pii, quality_rules, toxicity


def test_a_rare_name_beside_one_address_is_removed_and_usual_words_stay(spark):
    """Every address occurs once: only its kind can tell that the name beside it is rare elsewhere."""
    texts = [f"the report of today came in late and we saw number{i} again" for i in range(200)]
    texts[50] = "the report of today came from Zebulon at zz@corp.example and we saw it again"
    texts[150] = texts[151] = "the report of today came from Quillon at qq@else.example and we saw it again"  # a copy
    texts[199] = ""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Zebulon" not in out[50] and "Quillon" not in out[150] + out[151]
    assert all(w in out[50] for w in ("report", "today", "came", "saw", "again"))
    assert out[3] == texts[3] and out[199] == ""


def test_rows_of_small_groups_are_judged(spark):
    text = lambda i, n: " ".join(f"w{(i * 7 + k * k) % 97}x{k}" for k in range(n))
    junk = " ".join(f"#$%|<>*&{k}" for k in range(60))
    rows = [(i, text(i, 60 + i % 40), "en", "big") for i in range(120)]
    rows += [(200, text(3, 70), "en", "tiny"), (201, junk, "en", "junk"), (202, text(5, 80), "fr", "tiny"), (203, junk, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.row.doc_id: r for r in quality_rules.quality_rules(docs, ["doc_id"]).collect()}
    assert len(out) == len(rows) and all(r.base_failed or r.distance is not None for r in out.values())
    assert {i: out[i].kept for i in (0, 200, 201, 202, 203)} == {0: True, 200: True, 201: False, 202: True, 203: False}
    assert not out[201].base_failed and not out[203].base_failed


def test_inner_words_lie_in_three_windows():
    data, spans, row = toxicity.windows(pa.array([" ".join(f"w{i:02}" for i in range(25))]))
    held = [sum(f"w{i:02}".encode() in data[int(a) : int(a + n)] for a, n in spans) for i in range(25)]
    assert min(held) >= 1 and min(held[4:-5]) >= 3 and set(row) == {0}


def test_a_disclosing_term_goes_wherever_it_stands_in_the_text(spark):
    texts = [f"the report of today came in late and we saw number{i} again" for i in range(200)]
    far = "and we saw the report of today again " * 5
    texts[50] = f"the report of today came from Zebulon at zz@corp.example {far} Zebulon was late"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Zebulon" not in out[50] and out[50].count("we saw the report of today again") == 5 and out[50].endswith("was late")


def test_overlapping_spans_are_replaced_together(spark):
    docs = spark.createDataFrame([(1, "x +1 (212) 555-1234-bob@x.org y"), (2, "call 4111111111111111@foo.com now"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert out[1] == "x <phone> y" and "foo" not in out[2] and "4111" not in out[2] and out[3] is None


def test_places_of_many_matches(spark):
    text = "ab 12 é 3 " * 700
    got = spark.createDataFrame([(text,)], "text string").select(pii.places(pii.F.col("text"), "[0-9]+").alias("p")).first().p
    assert [(p.start, p.end, p.value) for p in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


def test_held_out_labels_change_no_toxicity_score(spark):
    from pyspark.sql import functions as F

    from shopstream.llm.common import held_out

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_toxicity_model(docs, x) for x in (labels, flipped))
    assert (a.ordinary, a.toxic, a.slope, a.offset) == (b.ordinary, b.toxic, b.slope, b.offset) and (a.ratio == b.ratio).all()
    assert len(a.toxic) == len(a.ordinary)


def test_toxic_texts_are_told_from_others(spark):
    """Recall and false alarms on held-out rows; a constant answer fails one of them."""
    from shopstream.llm import queries

    sf = "/root/testdata/sf0.1"
    out = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted", "score").toPandas()
    rank = out.score.rank()
    n1, n0 = (out.toxic == 1).sum(), (out.toxic == 0).sum()
    assert (rank[out.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) >= 0.88
    assert out.predicted[out.toxic == 1].mean() >= 0.3 and out.predicted[out.toxic == 0].mean() <= 0.05

def test_many_copies_of_one_page_refer_to_the_smallest(spark):
    from pyspark.sql import functions as F

    from shopstream.llm import warc

    pages = spark.range(1, 401).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.when(F.col("id") % 3 == 0, "<p>gone</p>").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("page "), "id")).alias("html"), F.lit("x").alias("payload"), F.lit("y").alias("sha1"))
    out = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).where("last").collect()}
    empty = [i for i in range(1, 401) if i % 3 and i % 50 == 1]
    assert len(out) == 400
    for i, r in out.items():
        first = 3 if i % 3 == 0 else empty[0] if i in empty else i
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))


def test_few_encodings_are_held_at_once():
    from types import SimpleNamespace

    from shopstream.llm import packing

    sizes = []
    fake = SimpleNamespace(encode_batch=lambda parts, add_special_tokens: sizes.append(len(parts)) or [SimpleNamespace(ids=[len(p)]) for p in parts])
    cut = packing.PartTokenizer.__new__(packing.PartTokenizer)
    cut.tokenizer = fake
    got = cut.each(["x" * (k % 7) for k in range(2 * packing.WORDS + 5)])
    assert [int(x[0]) for x in got] == [k % 7 for k in range(2 * packing.WORDS + 5)]
    assert sizes == [packing.WORDS, packing.WORDS, 5] and cut.each([]) == []


def test_rows_go_to_workers_in_small_batches(spark):
    """An executor holds a batch several times over: 64 MB in each task is much of what it has beside its heap."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(cast(id as string), 1000) as text", "cast(null as string) as lang")
    lengths = lambda: lambda column: [pa.array([len(t) for t in column.to_pylist()], pa.int64())]
    out = common.text_map(docs, "text", docs.columns, lengths, "n long")
    rows = out.selectExpr("row.doc_id", "row.text", "row.lang", "n").collect()
    assert len(rows) == 3000 and all(r.text == str(r.doc_id) * 1000 and r.n == len(r.text) and r.lang is None for r in rows)
    sizes = common.in_batches(docs, lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) < 5 << 20 and sum(r.n for r in sizes) > 10_000_000
    key, was = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for given, kept in (("1m", "1m"), ("64MB", str(common.BATCH_BYTES))):
        spark.conf.set(key, given)
        common.text_map(docs, "text", ["doc_id"], lengths, "n long")
        assert spark.conf.get(key) == kept
    spark.conf.set(key, was)
