"""Operators that have no query of their own: reading and writing, filters, liveness, learning and small text functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shopstream.functions import measure, text
from shopstream.operators import catalogue, discover, facets, learn, recommend, retrieve, rollup, selectors
from shopstream.sources import feed

NOW = dt.datetime(2024, 1, 31)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_feeds_of_json_rows_and_csv_out_and_back(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"sku": "A1", "price": 3, "more": 1}\n{"sku": null}\n')
    rows = feed.read_rows(spark, str(tmp_path / "rows.json"), ["sku", "price"])
    assert [tuple(r) for r in rows.collect()] == [("A1", "3"), (None, None)]
    table = spark.createDataFrame([("a,b", 'say "x"', None), ("", "line\nbreak", "z")], "a string, b string, c string")
    feed.export_csv(table.coalesce(1), str(tmp_path / "out"))
    written = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert written == 'a,b,c\n"a,b","say ""x""",\n,"line\nbreak",z\n'


def test_a_snapshot_becomes_current_only_when_written(spark, tmp_path):
    first, second = spark.createDataFrame([("a",)], "sku string"), spark.createDataFrame([("b",), ("c",)], "sku string")
    catalogue.publish_snapshot(first, str(tmp_path), "1", "current_docs")
    assert spark.table("current_docs").count() == 1
    catalogue.publish_snapshot(second, str(tmp_path), "2", "current_docs")
    assert sorted(r.sku for r in spark.table("current_docs").collect()) == ["b", "c"]


def test_category_and_label_filters(spark):
    rows = spark.createDataFrame([("p", ["a", "a/b"], ["col:x", "style:y"]), ("q", ["a"], ["col:z"]), ("r", None, None)], "sku string, category_ids array<string>, labels array<string>")
    pick = lambda test: [r.sku for r in rows.where(test).collect()]
    assert pick(retrieve.category_filter("a/b")) == ["p"] and pick(retrieve.category_filter("a")) == ["p", "q"]
    assert pick(retrieve.label_filter({"col": ["x", "z"]})) == ["p", "q"] and pick(retrieve.label_filter({"col": ["x", "z"], "style": ["y"]})) == ["p"] and pick(retrieve.label_filter({"col": ["n"]})) == []


def test_live_at_its_end_or_not(spark):
    rows = [("on", True, None, None, "marketing"), ("off", False, None, None, "marketing"), ("early", True, NOW + dt.timedelta(1), None, "marketing"), ("ends now", True, None, NOW, "marketing"), ("over", True, None, NOW - dt.timedelta(1), "marketing"), ("rule", True, NOW, None, "automatic")]
    table = spark.createDataFrame(rows, "name string, enabled boolean, starts_at timestamp, ends_at timestamp, kind string")
    names = lambda df: {r.name for r in df.collect()}
    assert names(table.where(selectors.is_live(F.lit(NOW)))) == {"on", "rule"}
    assert names(table.where(selectors.is_live(F.lit(NOW), end_excluded=False))) == {"on", "rule", "ends now"}
    assert names(selectors.browsable_collections(table, F.lit(NOW))) == {"on"}


def test_labelled_pairs_run_to_the_next_label(spark):
    rows = [(i, "Beam SIZE (RO): 4  x 6 FINISH-2: matte", "FINISH-2: gloss X: short OLD: __ BRAND: b") for i in range(6)] + [(6, None, "note: small"), (7, "RARE: once", None), (8, "LONG: " + "word " * 20, "")]
    table = spark.createDataFrame(rows, "row_ix int, title string, description string")
    got = {(r.row_ix, r.key): (r.value, r.source) for r in learn.labelled_pairs(table, ["title", "description"], taken=["brand"]).collect()}
    assert got == {(i, k): (v, "title") for i in range(6) for k, v in (("size", "4 x 6"), ("finish-2", "matte"))}
    assert learn.labelled_pairs(table.limit(0), ["title"]).count() == 0


def test_learn_report_has_two_samples(spark):
    filled = spark.createDataFrame([(i, "finish", "oak", "filled") for i in (5, 3, 9)] + [(1, "finish", None, "several values")], "row_ix int, key string, value string, outcome string")
    got = {(r.outcome, r.value): (r.rows, r.samples) for r in learn.learn_report(filled).collect()}
    assert got == {("filled", "oak"): (3, [3, 5]), ("several values", None): (1, [1])}


def test_facets_are_adopted_after_each_sites_last(spark):
    configured = spark.createDataFrame([("m", "brand", 4)], "site_id string, facet string, place int")
    new = spark.createDataFrame([("m", "brand", 1), ("m", "wood_type", 3), ("m", "finish", 2), ("m", "finish", 9), ("n", "size", 1)], "site_id string, facet string, seen int")
    got = [(r.site_id, r.facet, r.label, r.place, r.collapsed) for r in discover.adopt_facets(configured, new).orderBy("site_id", "place").collect()]
    assert got == [("m", "finish", "Finish", 5, True), ("m", "wood_type", "Wood Type", 6, True), ("n", "size", "Size", 1, True)]


def test_runs_are_logged_once(spark):
    runs = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b")], "site_id string, run_id int, note string")
    again = spark.createDataFrame([("m", 2, "c"), ("n", 2, "d")], "site_id string, run_id int, note string")
    assert sorted(tuple(r) for r in discover.log_ingest_run(runs, again).collect()) == [("m", 1, "a"), ("m", 2, "c"), ("n", 2, "d")]
    days = lambda rows: spark.createDataFrame(rows, "site_id string, day string, events_seen int")
    assert sorted(tuple(r) for r in rollup.log_rollup_run(days([("m", "d1", 1), ("m", "d2", 2)]), days([("m", "d2", 5)])).collect()) == [("m", "d1", 1), ("m", "d2", 5)]


def test_rollup_gives_the_tables_of_its_parts(spark, sf_dir):
    from shopstream.plans.views import impressions, shopper_events

    log, shown = shopper_events(spark, sf_dir), impressions(spark, sf_dir)
    out = rollup.rollup(log, shown)
    assert set(out) == {"daily_query", "daily_product", "daily_facet"}
    assert out["daily_product"].count() == rollup.rollup_product_day(log, shown).count() and out["daily_facet"].count() == rollup.rollup_facet_day(log).count()
    first = log.agg(F.date_add(F.min("day"), 10).cast("string").alias("d")).first().d
    assert rollup.rollup(log, shown, first)["daily_query"].where(F.col("day") < first).count() == 0


def test_small_text_functions(spark):
    assert [one(spark, measure.to_boolean(F.lit(v))) for v in (" Yes", "T", "1", "no", "", None)] == [True, True, True, False, False, False]
    attrs = F.create_map(*[F.lit(x) for x in ("size", "4", "finish", "oak", "other", "z", "color", "")])
    assert one(spark, text.variant_title(attrs)) == "oak / 4"
    searchable = lambda k, v, f=(): one(spark, text.searchable_attribute(F.lit(k), F.lit(v), list(f)))
    assert [searchable("a", "solid oak"), searchable("a", "x12-b"), searchable("a", "w" * 61), searchable("a", "12"), searchable("a", "12", ["a"])] == [True, False, False, False, True]
    assert one(spark, text.highlight(F.lit("Oak beam, soak OAKEN"), ["oak", "oak beam"])) == "<mark>Oak beam</mark>, soak <mark>OAK</mark>EN"
    assert one(spark, text.highlight(F.lit("a.b axb"), ["a.b"])) == "<mark>a.b</mark> axb"
    assert one(spark, text.slugify(F.lit("  Oak & Pine: Beams! "))) == "oak-pine-beams" and len(one(spark, text.slugify(F.lit("ab " * 60)))) <= 60


def test_facets_shown_keep_selected_values_and_leave_out_empty_ones(spark):
    counts = spark.createDataFrame([("finish", "oak", 5), ("finish", "ash", 9), ("finish", "red", 1), ("in_stock", "0", 2), ("in_stock", "1", 3), ("extra", "b", 1), ("extra", "a", 2)], "facet string, value string, products long")
    stats = spark.createDataFrame([("price", 1.0, 9.0)], "facet string, least double, most double")
    config = [("finish", "Finish", "checkbox", 2, False, "count", 1, []), ("in_stock", "Stock", "checkbox", 1, False, "alpha", 0, []), ("price", "Price", "slider", 3, False, "count", 0, []), ("weight", "Weight", "slider", 4, False, "count", 0, []), ("none", "None", "checkbox", 5, False, "count", 0, []), ("extra", "Extra", "checkbox", 6, True, "alpha", 1, [])]
    config = spark.createDataFrame(config, "facet string, label string, display string, position int, attribute boolean, sort_by string, truncate_at int, custom array<string>")
    out = facets.build_facets(counts, stats, config, spark.createDataFrame([("finish", "red")], "facet string, value string")).orderBy("position", "place").collect()
    assert [(r.facet, r.value_label, r.products, r.chosen, r.most) for r in out] == [
        ("in_stock", "In Stock", 3, False, None), ("in_stock", "Out of Stock", 2, False, None), ("finish", "ash", 9, False, None), ("finish", "red", 1, True, None), ("price", None, None, None, 9.0), ("extra", "a", 2, False, None), ("extra", "b", 1, False, None),
    ]


def test_similar_asks_once_for_equal_anchors_and_leaves_the_anchor_out(spark):
    anchors = [("m", "p", "One two three four five six seven", ["a", "a/b"], "Oak"), ("m", "q", "one TWO three four five six eight", ["a", "a/b"], "oak"), ("m", "r", "", ["a"], None), ("m", "s", "one", [], "oak")]
    asked = recommend.similar_requests(spark.createDataFrame(anchors, "site_id string, parent_id string, title string, category_ids array<string>, style string"), ["style"])
    rows = asked.collect()
    assert {r.anchor for r in rows} == {"p", "q"} and len({r.query_id for r in rows}) == 1 and rows[0].terms == ["one", "two", "three", "four", "five", "six", "oak"] and rows[0].category_id == "a/b"
    cards = spark.createDataFrame([(rows[0].query_id, p, i) for i, p in enumerate("xqyp", 1)], "query_id string, parent_id string, card int")
    got = sorted((r.anchor, r.parent_id, r["rank"]) for r in recommend.similar(asked, cards, limit=2, spare=1).collect())
    assert got == [("p", "q", 2), ("p", "x", 1), ("q", "x", 1), ("q", "y", 2)]
