from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from shopstream.operators import events, history, rollup, rules, selectors
from shopstream.sources import feed


def test_pins_take_their_places(spark):
    cards = spark.createDataFrame([("q", p, i) for i, p in enumerate("abcde", 1)], "query_id string, parent_id string, card int")
    actions = spark.createDataFrame([("q", "e", "pin", 1), ("q", "z", "pin", 3), ("q", "a", "bury", 0), ("q", "c", "hide", 0)], "query_id string, parent_id string, action string, slot int")
    products = spark.createDataFrame([(p,) for p in "abcdez"], "parent_id string")
    out = rules.apply_query_rule(cards, actions, products).orderBy("card").collect()
    assert [(r.parent_id, r.pinned) for r in out] == [("e", True), ("b", False), ("z", True), ("d", False), ("a", False)]


def test_two_pins_for_one_place_and_one_beyond_the_end(spark):
    cards = spark.createDataFrame([("q", "a", 1)], "query_id string, parent_id string, card int")
    actions = spark.createDataFrame([("q", "x", "pin", 1), ("q", "y", "pin", 1), ("q", "z", "pin", 9), ("q", "gone", "pin", 1)], "query_id string, parent_id string, action string, slot int")
    products = spark.createDataFrame([(p,) for p in "axyz"], "parent_id string")
    assert [r.parent_id for r in rules.apply_query_rule(cards, actions, products).orderBy("card").collect()] == ["y", "x", "a", "z"]


def test_a_pattern_that_does_not_compile_matches_nothing(spark):
    log = spark.createDataFrame([("oak beam",)], "query string")
    table = spark.createDataFrame([(1, "regex", "(oak", "/bad", 9, True), (2, "regex", "^oak", "/oak", 1, True)], "rule_id int, kind string, pattern string, target string, priority int, enabled boolean")
    assert [r.target for r in rules.match_redirects(log, table).collect()] == ["/oak"]


def test_rules_meet_queries_as_if_each_pair_was_compared(spark):
    """Against a loop over all pairs: short and long patterns, gaps, repeats, empty and null ones, two sites."""
    words = ["oak", "oak beam", "white oak beams", "beam", "b", "", None, "oakoak", "a b a b a", "long beam of very white oak wood", "Öl 4x4", "x"]
    log = spark.createDataFrame([(s, w) for s in ("m", "t") for w in words + words[:3]], "site_id string, query string")
    patterns = ["oak", "oak beam", "b", "", "ak b", "very white oak", "long beam of very white oak w", "a b", "4x", "none", None, "m"]
    redirects = [(s, i, k, p, f"/{i}", i * 7 % 5, i % 6 != 5) for s, off in (("m", 0), ("t", 1)) for i, (p, k) in enumerate((p, k) for p in patterns[off:] for k in ("exact", "starts_with", "contains", "regex"))]
    table = spark.createDataFrame(redirects, "site_id string, rule_id int, kind string, pattern string, target string, priority int, enabled boolean")
    got = {(r.site_id, r.query): r.target for r in rules.match_redirects(log, table, ["site_id"]).collect()}
    plain = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower().replace("ö", "o")).split())
    wanted = {}
    for s in ("m", "t"):
        for w in filter(None, words):
            q = plain(w)
            holds = {"exact": lambda p, q=q: q == plain(p), "starts_with": lambda p, q=q: q.startswith(plain(p)), "contains": lambda p, q=q: plain(p) in q, "regex": lambda p, q=q: re.search(p, q) is not None}
            fit = [(-pr, i, t) for site, i, k, p, t, pr, on in redirects if site == s and on and p is not None and holds[k](p)]
            if fit:
                wanted[s, w] = min(fit)[2]
    assert got == wanted and len(got) > 10

    kinds = ("exact", "phrase", "contains")
    triggers = [(s, i, k, p, i * 5 % 3) for s, off in (("m", 0), ("t", 1)) for i, (p, k) in enumerate((p, k) for p in patterns[off:] for k in kinds)]
    table = spark.createDataFrame(triggers, "site_id string, rule_id int, match string, trigger string, priority int")
    got = {(r.site_id, r.query): r.rule_id for r in rules.match_query_rules(log, table, ["site_id"]).collect()}
    wanted = {}
    for s in ("m", "t"):
        for w in filter(None, words):
            q = plain(w)
            holds = {"exact": lambda p, q=q: q == p, "phrase": lambda p, q=q: f" {p} " in f" {q} ", "contains": lambda p, q=q: p in q}
            fit = [(-pr, kinds.index(k), -len(p), i) for site, i, k, p, pr in triggers if site == s and p and holds[k](p)]
            if fit:
                wanted[s, w] = min(fit)[3]
    assert got == wanted
    assert "NestedLoop" not in rules.match_query_rules(log, table, ["site_id"])._jdf.queryExecution().executedPlan().toString()


def test_rules_without_sites_and_empty_tables(spark):
    log = spark.createDataFrame([("oak",), ("elm",)], "query string")
    table = spark.createDataFrame([(1, "contains", "", "/all", 0, True), (2, "contains", "oa", "/oak", 0, True), (3, "starts_with", "o", "/o", 2, True)], "rule_id int, kind string, pattern string, target string, priority int, enabled boolean")
    assert {(r.query, r.target) for r in rules.match_redirects(log, table).collect()} == {("oak", "/o"), ("elm", "/all")}
    assert rules.match_redirects(log.limit(0), table).count() == 0 and rules.match_redirects(log, table.limit(0)).count() == 0


def test_a_page_is_tilted_only_without_rule_and_beyond_one_card(spark):
    hits = spark.createDataFrame([("q", 1, "White / PVC", "A"), ("q", 2, "BLACK / pvc ", "acme"), ("q", 3, None, None), ("r", 1, "White", "A"), ("r", 2, "Black", "A"), ("s", 1, "Black", "A")], "query_id string, card int, variant_title string, brand string")
    out = rules.personalise(hits, F.array(F.lit(" black"), F.lit("Acme"), F.lit("")), F.col("query_id") == "r").collect()
    assert sorted((r.query_id, r.place, r.card, r.score) for r in out) == [("q", 1, 2, 2), ("q", 2, 1, 0), ("q", 3, 3, 0), ("r", 1, 1, 0), ("r", 2, 2, 0), ("s", 1, 1, 0)]
    assert {r.place for r in rules.personalise(hits, F.lit(None).cast("array<string>")).where("query_id = 'q'").collect()} == {1, 2, 3}


def test_synonyms_take_the_longest_phrase_once(spark):
    log = spark.createDataFrame([(1, ["oak", "beams", "red"]), (2, []), (3, ["red"])], "query_id int, terms array<string>")
    table = spark.createDataFrame([(1, "oak beam", ["timber"]), (2, "beam", ["joist"]), (3, "red", ["crimson", "red"])], "rule_id int, trigger string, alternatives array<string>")
    out = {r.query_id: (r.terms, r.rule_ids) for r in rules.expand_synonyms(log, table).collect()}
    assert out == {1: (["oak", "beams", "red", "timber", "crimson"], [1, 3]), 2: ([], []), 3: (["red", "crimson"], [3])}


def test_selectors_are_checked_before_any_job():
    for bad in ({"all": []}, {"field": "title", "op": "like", "value": 1}, {"field": "title", "op": "equals"}, {"all": [{"any": [{"all": [{"any": [{"all": [{"field": "a", "op": "exists"}]}]}]}]}]}):
        with pytest.raises(ValueError):
            selectors.compile_selector(bad)


def test_negative_selector_on_an_array_looks_for_any_element(spark):
    rows = spark.createDataFrame([("p", ["Sale", "x"]), ("q", ["Sale"]), ("r", None)], "parent_id string, tags array<string>")
    found = rows.where(selectors.compile_selector({"field": "tags", "op": "not_contains", "value": "sale"})).collect()
    assert [r.parent_id for r in found] == ["p"]


def test_sessions_split_after_the_gap_and_keep_ties(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("u", at(0)), ("u", at(0)), ("u", at(30)), ("v", at(59))], "user string, ts timestamp")
    assert sorted((r.user, r.ts.minute, r.session_no) for r in events.sessionise(rows, "user", "ts", 29).collect()) == [("u", 0, 1), ("u", 0, 1), ("u", 30, 2), ("v", 59, 1)]


def test_attributed_revenue_sums_to_that_of_touched_purchases(spark, sf_dir):
    from shopstream.plans.views import shopper_events

    log = shopper_events(spark, sf_dir)
    touches = rollup.purchase_touches(log)
    shared = rollup.attribute_revenue(rollup.rollup_query_day(log), touches).agg({"revenue": "sum"}).first()[0]
    bought = touches.select("purchase_id", "revenue").distinct().agg({"revenue": "sum"}).first()[0]
    assert shared == pytest.approx(bought)


def test_overwritten_days_repair_and_never_double(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2024-01-01", 1), ("s", "2024-01-02", 2)], "site_id string, day string, n int")
    path = str(tmp_path / "t")
    rollup.overwrite_days(rows, path)
    rollup.overwrite_days(rows.where("day = '2024-01-02'").selectExpr("site_id", "day", "n + 5 as n"), path)
    assert sorted((str(r.day), r.n) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 7)]


def test_feed_is_read_with_its_own_delimiter(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text('﻿SKU|Display Name|Width\nA1| 4" beam |3-1/2 in\n\nA1|again|2\nB2|\nC3|post|x\n')
    rows = feed.read_feed(spark, str(path))
    assert rows.columns == ["SKU", "Display Name", "Width"]
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window as W

    rows = rows.withColumn("row_ix", F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1)
    good, bad = feed.normalise_feed(feed.map_feed(rows, feed.infer_mapping(["SKU", "Display Name", "Width"])))
    assert [(r.sku, r.title, r.attrs_in) for r in good.orderBy("sku").collect()] == [("A1", '4" beam', {"width_in": 3.5}), ("C3", "post", {})]
    assert sorted((r.sku, r.reason) for r in bad.collect()) == [("A1", "duplicate SKU"), ("B2", "no title")]


def test_json_diff_and_undo(spark):
    rows = spark.createDataFrame([(1, "badge", 7, "update", '{"a":"1","b":null,"updatedAt":"x"}', '{"a":"2"}'), (2, "badge", 7, "create", None, '{"a":"2"}'), (3, "badge", 7, "revert", "{}", "{}"), (4, "experiment", 7, "update", "{}", "{}"), (5, "badge", None, "update", "{}", "{}"), (6, "badge", 7, "update", None, None)], "audit_id int, entity string, entity_id int, action string, before string, after string")
    out = {r.audit_id: r for r in history.audit_diff(rows).collect()}
    assert [tuple(c) for c in out[1].changes] == [("a", "1", "2")] and out[3].revertible and not out[4].revertible and not out[5].revertible and not out[6].revertible
    undone = history.inverse_changes(rows, rows.select("audit_id")).orderBy("reverts").collect()
    assert [(r.reverts, r.outcome, r.after) for r in undone] == [(1, "restored", '{"a":"1","b":null,"updatedAt":"x"}'), (2, "removed", None), (3, "restored", "{}")]


def test_events_are_appended_by_day_without_the_refused(spark, tmp_path):
    rows = spark.createDataFrame([("s", "click", "u", "x", 1, "Red  Bolt", dt.datetime(2024, 1, 2)), ("s", "click", "u", "x", 0, "q", dt.datetime(2024, 1, 2))], "site_id string, type string, shopper_id string, session_id string, position int, query string, occurred_at timestamp")
    for _ in range(2):
        events.append_events(rows, str(tmp_path / "e"))
    out = spark.read.parquet(str(tmp_path / "e")).collect()
    assert [(r.normalised_query, str(r.day)) for r in out] == [("red bolt", "2024-01-02")] * 2


def test_preview_scales_a_sample_and_counts_all_without_one(spark):
    rows = spark.createDataFrame([("s", f"p{i}", "red" if i % 2 else "blue") for i in range(9)] + [("t", "q", "blue")], "site_id string, parent_id string, title string")
    tree = {"field": "title", "op": "equals", "value": "red"}
    got = {r.site_id: r for r in selectors.preview_selector(rows, tree, most=2).collect()}
    assert (got["s"].matched, got["s"].exact, got["s"].examples) == (4, True, ["p1", "p3"]) and (got["t"].matched, got["t"].examples) == (0, [])
    part = {r.site_id: r for r in selectors.preview_selector(rows, tree, sample_limit=4).collect()}["s"]
    assert (part.matched, part.total, part.sampled, part.exact) == (5, 9, 4, False)


def test_an_exclusion_wins_and_labels_without_members_stay(spark):
    values = spark.createDataFrame([("s", "a", "{}"), ("s", "b", "{}")], "site_id string, label string, selector string")
    given = spark.createDataFrame([("s", "a", "p", "include", 3), ("s", "a", "p", "include", None), ("s", "a", "q", "include", 1), ("s", "a", "q", "exclude", None)], "site_id string, label string, parent_id string, mode string, position int")
    plan = selectors.label_plan(values, given)
    assert sorted((r.label, r.parent_id or "", r.mode or "", r.position) for r in plan.collect()) == [("a", "p", "include", 3), ("a", "q", "exclude", None), ("b", "", "", None)]
    docs = spark.createDataFrame([("s", "p"), ("s", "q")], "site_id string, parent_id string")
    assert {r.parent_id: [tuple(x) for x in r.positions] for r in selectors.curated_positions(docs, plan).collect()} == {"p": [("a", 3)], "q": []}
