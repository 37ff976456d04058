"""Findings of round 3: what grows is not sent through the driver, pauses to the microsecond, rules asked once for each kind of product."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from shopstream.operators import events, labelling, learn, relevance, requests, retrieve


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["match_terms", "window_parents", "filter_to_candidates"])
def test_postings_and_documents_are_not_broadcast(spark, sf_dir, name):
    text = plan_of(entry_module.queries()[name](spark, sf_dir))
    # The tables are tiny here, so Spark would broadcast all that nothing keeps from it.
    for part in re.split(r"(?=BroadcastExchange)", text)[1:]:
        first = part.split("\n")[1]
        assert "p_partkey" not in first and "transform(sequence" not in first and "InMemoryTableScan" not in first, first


def test_a_frequent_word_is_met_in_parts(spark):
    index = spark.range(200).select(F.lit("a").alias("site_id"), F.concat(F.lit("S"), "id").alias("sku"), F.lit("P").alias("parent_id"), F.lit("title").alias("field"), F.lit("oak").alias("token"), F.lit(0).alias("position"))
    queries = spark.createDataFrame([("q", ["oak"]), ("none", ["oak", "pine"])], "query_id string, terms array<string>")
    expanded = spark.createDataFrame([("oak", "oak", 0, 0), ("pine", "pine", 0, 0)], "term string, token string, distance int, kind int")
    got = retrieve.match_terms(queries, index, expanded)
    assert sorted((r.query_id, r.sku) for r in got.collect()) == sorted(("q", f"S{i}") for i in range(200)) and "part" in plan_of(got)


def test_found_documents_are_not_broadcast(spark):
    from test_requests import plan, small_shop

    index = requests.stored(small_shop(spark), "index")
    plans = requests.with_surfaces(plan(spark, [("1", "a", "keyword", ["oak"], {}, "relevance")]), requests.vocabulary_of(index))
    found = requests.found_documents(plans, index, requests.list_sizes(index))
    for part in re.split(r"(?=BroadcastExchange)", plan_of(found))[1:]:
        assert "texts" not in part.split("\n")[1]
    assert sorted(r.sku for r in found.collect()) == ["S1", "S2"]


@pytest.mark.parametrize(("second", "sessions"), [("10:30:00.4", [1, 1]), ("10:30:00.6", [1, 2]), ("10:30:00.400001", [1, 2])])
def test_a_pause_is_measured_to_the_microsecond(spark, second, sessions):
    rows = spark.createDataFrame([("u", "2024-01-01 10:00:00.4"), ("u", f"2024-01-01 {second}")], "user string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r.session_no for r in events.sessionise(rows, "user", "ts").collect()) == sessions


def test_label_units_are_not_compared_pairwise(spark):
    products = spark.range(1).select(F.lit("a").alias("site_id"), F.lit("P").alias("parent_id"), F.lit("T").alias("title"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.struct(F.concat(F.lit("S"), i.cast("string")).alias("sku"), F.lit("B").alias("brand"), F.lit(2.0).alias("price"), F.lit(0.0).alias("sale_price"), (i % 3).cast("long").alias("inventory"))).alias("variants"))
    units = labelling.unit_values(products)
    assert "array_distinct" not in plan_of(units)
    rows = [tuple(r) for r in units.collect()]
    assert len(rows) == len(set(rows)) and sum(r[2] is None and r[3] == "variant.brand" for r in rows) == 1
    rules = spark.createDataFrame([("a", "two", '{"field":"variant.inventory","op":"equals","value":"2"}'), ("a", "rest", '{"none":[{"field":"title","op":"equals","value":"x"}]}'), ("b", "two", '{"none":[{"field":"title","op":"equals","value":"x"}]}')], "site_id string, label string, selector string")
    got = labelling.apply_label_rules(products, rules, spark.createDataFrame([], "site_id string, label string, parent_id string, mode string"))
    found = {label: {r.sku for r in got.where(F.col("label") == label).collect()} for label in ("two", "rest")}
    assert found["two"] == {f"S{i}" for i in range(1, 31) if i % 3 == 2} and len(found["rest"]) == 30


def test_cases_are_held_against_different_documents_in_parts(spark):
    case = spark.createDataFrame([("c", "a", None, (None, "B", None, None, {"k": ["v"]}, None), None, None, None, None, None, None)], f"case_id string, site_id string, k int, expect {relevance.JUDGMENT}, at_least struct<n:int,of:{relevance.JUDGMENT}>, forbid {relevance.JUDGMENT}, partial boolean, min_results bigint, understands array<string>, rescued boolean")
    rows = [("a", f"S{i}", f"P{i % 3}", ["X"], "B", True, "t", {"k": "v"} if i % 3 else None) for i in range(90)]
    docs = spark.createDataFrame(rows, "site_id string, sku string, parent_id string, category_path array<string>, brand string, in_stock boolean, title string, attrs map<string,string>")
    hits = spark.createDataFrame([("c", 1, "S1")], "case_id string, card int, sku string")
    answers = spark.createDataFrame([("c", 2, None, None)], "case_id string, total bigint, understood array<string>, strategy string")
    judged = relevance.judge_cases(case, hits, answers, docs)
    assert "part" in plan_of(judged)  # a site is no single task
    row = judged.first()
    assert row.expected == 2 and row.passed


def test_pairs_of_a_row_are_chosen_without_a_shuffle(spark):
    rows = spark.range(10).select(F.col("id").alias("row_ix"), F.lit("x SIZE: 1 SIZE: 2 COLOR: red").alias("title"), F.lit("SIZE: 3 WOOD: oak").alias("details"))
    pairs = learn.labelled_pairs(rows, ["title", "details"])
    assert "hashpartitioning(row_ix" not in plan_of(pairs)
    assert {(r.key, r.value, r.source) for r in pairs.where("row_ix = 4").collect()} == {("size", "1", "title"), ("color", "red", "title"), ("wood", "oak", "details")} and pairs.count() == 30


def test_impacts_and_list_sizes_are_not_broadcast(spark):
    from test_requests import plan, small_shop

    index = requests.stored(small_shop(spark), "index")
    text = plan_of(requests.impacts(index))
    assert text.count("BroadcastExchange") == 1 and "SortMergeJoin [site_id" in text  # sites alone
    sizes = requests.stored(requests.list_sizes(index), "sizes")
    plans = requests.with_surfaces(plan(spark, [("1", "a", "keyword", ["oak"], {}, "relevance")]), requests.vocabulary_of(index))
    starts = plan_of(requests.starting_lists(plans.withColumn("groups", requests.groups_of(True)), sizes, True))
    assert "SortMergeJoin [site_id" in starts and "LeftOuter" in starts


def test_parts_are_not_broadcast_to_events(spark, sf_dir):
    from shopstream.plans.views import shopper_events, table

    rows = shopper_events(spark, sf_dir)
    text = plan_of(rows)
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"))
    events_of = table(spark, sf_dir, "events").select(F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))
    assert rows.count() == events_of.join(keys, "k").count()


def test_anchors_are_merged_in_parts(spark):
    from shopstream.operators import recommend

    asked = spark.createDataFrame([("a", f"P{i}", "q") for i in range(20)], "site_id string, anchor string, query_id string")
    cards = spark.createDataFrame([("q", f"P{i}", i + 1) for i in range(20)], "query_id string, parent_id string, card int")
    got = recommend.similar(asked, cards)
    assert "part" in plan_of(got) and "SortMergeJoin [query_id" in plan_of(got)
    first = [r.parent_id for r in got.where("anchor = 'P2'").orderBy("rank").collect()]
    assert first == ["P0", "P1", "P3", "P4", "P5", "P6", "P7", "P8"] and got.count() == 160


def test_what_words_meet_is_shuffled_once(spark):
    rows = [("a", "S1", "P", f, t, i) for f, t, i in [("title", "oak", 0), ("title", "oak", 2), ("attributes", "oak", 0), ("title", "door", 1), ("title", "dor", 3)]] + [("a", "S2", "P", "title", "oak", 0)]
    index = spark.createDataFrame(rows, "site_id string, sku string, parent_id string, field string, token string, position int")
    queries = spark.createDataFrame([("q", ["oak", "door"]), ("one", ["oak"]), (None, ["oak"])], "query_id string, terms array<string>")
    expanded = spark.createDataFrame([("oak", "oak", 0, 0), ("door", "door", 0, 0), ("door", "dor", 1, 1)], "term string, token string, distance int, kind int")
    got = retrieve.match_terms(queries, index, expanded)
    text = plan_of(got)
    assert text.count("hashpartitioning(query_id") == 1 and "LeftSemi" not in text
    found = sorted((r.query_id, r.sku, r.term, r.token, r.field, r.position) for r in got.collect())
    oak = [("oak", "oak", "attributes", 0), ("oak", "oak", "title", 0), ("oak", "oak", "title", 2)]
    assert found == sorted([("q", "S1", *x) for x in [*oak, ("door", "door", "title", 1), ("door", "dor", "title", 3)]] + [("one", "S1", *x) for x in oak] + [("one", "S2", "oak", "oak", "title", 0)])
