"""Search over request tables, entities, rescue, snapshots, row numbers, streams and judging."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_queries import TABLES, plain

import __spark_entry__ as entry_module
from shopstream.operators import catalogue, entities, relevance, requests
from shopstream.plans import shop
from shopstream.sources import feed
from shopstream.streaming import streams


@pytest.mark.parametrize("name", ["read_requests", "search_requests", "facet_panels", "bm25_scores", "complete", "judge_cases"])
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert plain(entry_module.queries()[name](spark, sf_dir).toPandas()) == plain(con.execute(shop.ORACLE[name]).fetchdf())


@pytest.fixture(scope="module")
def names(spark):
    categories = [("ceiling", ["Interior", "Ceiling"], 5), ("beams", ["Millwork", "Beams"], 9), ("medallions", ["Interior", "Ceiling Medallions"], 4), ("panels", ["Wall Panels"], 3)]
    values = [("color", "Hunter Green", 7), ("color", "Colonial Red", 5), ("material", "Western Red Cedar", 9), ("frame", "Standard Frame", 2), ("frame", "Brickmould Frame", 2), ("frame", "Brickmould Sill Frame", 1), ("style", "Raised Panel", 4), ("color", "Slate Gray", 2), ("finish", "Black", 3), ("size", "12", 9), ("material", None, 1)]
    return entities.entity_names(
        spark.createDataFrame([("a", *c) for c in categories] + [("b", "beams", ["Beams"], 1)], "site_id string, category_id string, path array<string>, products int"),
        spark.createDataFrame([("a", "Heritage Mills", 3), ("a", "Black", 1), ("a", None, 1)], "site_id string, brand string, products int"),
        spark.createDataFrame([("a", *v) for v in values], "site_id string, field string, value string, products int"),
    ).persist()


def test_names_of_values(names):
    attributes = {r.key: r.value for r in names.where("kind = 'attribute' and site_id = 'a'").collect()}
    assert attributes["green"] == "Hunter Green" and attributes["red"] == "Colonial Red" and attributes["cedar"] == "Western Red Cedar"  # red is the head of one
    assert attributes["sill"] == "Brickmould Sill Frame" and "frame" not in attributes and "brickmould" not in attributes  # claimed twice
    assert "panel" not in attributes and "12" not in attributes and attributes["grey"] == attributes["gray"] == "Slate Gray"


@pytest.mark.parametrize(
    ("query", "kinds", "rest"),
    [
        ("ceiling beams", ["category=beams"], ["ceiling"]),
        ("ceiling medallions", ["category=medallions"], []),
        ("heritage mills beams", ["brand=Heritage Mills", "category=beams"], []),
        ("black black beam", ["brand=Black", "attribute=Black", "category=beams"], []),
        ("green red shutter", ["attribute=Hunter Green"], ["red", "shutter"]),
        ("", [], []),
    ],
)
def test_lifted_entities(spark, names, query, kinds, rest):
    q = spark.createDataFrame([("a", query, query.split())], "site_id string, query string, tokens array<string>")
    row = entities.lift_entities(q, names, 3).first()
    assert [f"{c.kind}={c.value}" for c in row.constraints] == kinds and row.rest == rest
    other = entities.lift_entities(q.withColumn("site_id", F.lit("b")), names, 3).first()
    assert [c.value for c in other.constraints] == (["beams"] if "beam" in query else [])  # names are those of the site


def test_the_shoppers_filters_hold(spark, names):
    rows = spark.createDataFrame([({"color": ["x"], "brand": []}, None, None), (None, "own", None), (None, None, "sale")], "filters map<string,array<string>>, category string, collection string")
    constraint = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit("").alias("source")) for k, f, v in (("brand", "brand", "B"), ("attribute", "color", "Red"), ("category", "category_id", "c"))])
    filters, category = entities.with_constraints(F.col("filters"), F.col("category"), F.col("collection"), constraint)
    got = rows.select(filters.alias("f"), category.alias("c")).collect()
    assert got[0].f == {"color": ["x"], "brand": ["B"]} and [r.c for r in got] == ["c", "own", None] and got[1].f == {"color": ["Red"], "brand": ["B"]}


def small_shop(spark):
    rows = [("a", "S1", "P1", "oak beam", 10.0, 3.0), ("a", "S2", "P1", "oak beam long", 20.0, 1.0), ("a", "S3", "P2", "pine board", 5.0, 9.0), ("b", "S1", "P9", "oak chair", 7.0, 2.0), ("a", "S4", "P3", None, None, None)]
    docs = spark.createDataFrame(rows, "site_id string, sku string, parent_id string, title string, effective_price double, sales_velocity double")
    empty = F.array().cast("array<string>")
    return requests.document_index(
        docs.select("*", F.lit(None).cast("string").alias("mpn"), empty.alias("category_ids"), F.array(F.lit("use:in")).alias("labels"), F.lit(0.0).alias("discount_pct"), F.lit(True).alias("in_stock"), F.lit(None).cast("timestamp").alias("date_added"), F.lit(None).cast("double").alias("review_score"), F.lit(0.5).alias("business")),
        {"title": F.col("title")}, {"wood": F.get(F.split("title", " "), 0)},
    )


def plan(spark, rows):
    none = {"constraints": requests.NO_CONSTRAINTS, "ranges": requests.NO_RANGES, "dimensions": requests.NO_LENGTHS, "labels": requests.MAP, "category_id": "string", "collection": "string", "sku": "string"}
    out = spark.createDataFrame(rows, "query_id string, site_id string, type string, terms array<string>, filters map<string,array<string>>, sort string")
    return out.select("*", *[(F.array() if t.startswith("array") else F.create_map() if t.startswith("map") else F.lit(None)).cast(t).alias(c) for c, t in none.items()])


def test_candidates_totals_and_facets_by_site(spark):
    index = small_shop(spark)
    plans = plan(spark, [("1", "a", "keyword", ["oak"], {}, "relevance"), ("2", "b", "keyword", ["oak"], {}, "relevance"), ("3", "a", "empty", [], {"wood": ["oak"]}, "price_asc"), ("4", "a", "empty", [], {}, "price_asc"), ("5", "a", "keyword", ["zzz"], {}, "relevance"), ("6", "a", "empty", [], {}, "price_asc")])
    answers, _, found, parents = requests.search(plans, index, requests.vocabulary_of(index))
    of = {r.query_id: r.plan_id for r in answers.collect()}
    assert of["4"] == of["6"] and len(set(of.values())) == 5  # equal requests share a plan
    totals = {r.query_id: (r.products, r.variants) for r in requests.totals(parents).collect()}
    assert [totals.get(of[q]) for q in "12345"] == [(1, 2), (1, 1), (1, 2), (3, 4), None]
    facets = {(r.query_id, r.value): r.products for r in requests.request_facets(parents).where("facet = 'wood'").collect()}
    assert facets[of["3"], "pine"] == 1 and facets[of["3"], "oak"] == 1 and (of["1"], "pine") not in facets  # a facet is free of its own selection
    cards = {(r.query_id, r.card): (r.sku, r.siblings) for r in requests.ranked_cards(found, parents, plans.withColumn("query_id", F.col("query_id")).join(answers, "query_id").drop("query_id").withColumnRenamed("plan_id", "query_id")).collect()}
    assert cards[of["3"], 1] == ("S1", ["S2"])


def test_rescue_tries_in_order(spark):
    index = small_shop(spark)
    plans = plan(spark, [("spell", "a", "keyword", ["pinne"], {}, "relevance"), ("relax", "a", "keyword", ["zz", "oak"], {}, "relevance"), ("best", "a", "keyword", ["zzzz"], {}, "relevance"), ("near", "b", "keyword", ["oakchairs"], {}, "relevance"), ("fine", "a", "keyword", ["oak"], {}, "relevance"), ("none", "c", "keyword", ["oak"], {}, "relevance")])
    corrections = spark.createDataFrame([("a", "pinne", "pine")], "site_id string, term string, correction string")
    directory = spark.createDataFrame([("a", "x", ["Other"])], "site_id string, category_id string, path array<string>")
    # Without fuzzy words (an own vocabulary that lacks them) the correction is what helps.
    bare = spark.createDataFrame([("a", "unrelated")], "site_id string, token string")
    answers, *_ = requests.search(plans, index, bare, corrections, directory)
    got = {r.query_id: r.strategy for r in answers.collect()}
    assert got == {"spell": "spell_correct", "relax": "relax_query", "best": "best_sellers", "near": "best_sellers", "fine": None, "none": None}


def test_rows_are_numbered_as_in_the_files(spark, tmp_path):
    want = []
    for name, n in (("a", 700), ("b", 1), ("c", 450)):
        lines = [f"{name}{i},title {i} " + "x" * (i % 37) for i in range(n)]
        want += [line.split(",")[0] for line in lines]
        (tmp_path / f"{name}.csv").write_text("sku,title\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = feed.with_row_numbers(feed.read_feed(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.select("sku", "row_ix").rdd.getNumPartitions() >= 1
    assert [r.sku for r in sorted(rows.collect(), key=lambda r: r.row_ix)] == want and [r.row_ix for r in rows.select("row_ix").orderBy("row_ix").collect()] == list(range(len(want)))
    mapped = feed.map_feed(rows, feed.infer_mapping([c for c in rows.columns if c != "row_ix"]))
    good, rejects = feed.normalise_feed(mapped)
    assert good.count() == len(want) and rejects.count() == 0


def test_a_snapshot_is_seen_whole_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/snapshots"
    docs = lambda *skus: spark.createDataFrame([(s,) for s in skus], "sku string")
    seen = lambda: sorted(r.sku for r in catalogue.read_snapshot(spark, folder).collect())
    with pytest.raises(FileNotFoundError):
        catalogue.read_snapshot(spark, folder)
    catalogue.publish_snapshot(docs("a"), folder, "1")
    reader = catalogue.read_snapshot(spark, folder)
    broken = docs("x", "y").repartition(2).select(F.when(F.col("sku") == "y", F.raise_error(F.lit("dies half way"))).otherwise(F.col("sku")).alias("sku"))
    with pytest.raises(Exception, match="half way"):
        catalogue.publish_snapshot(broken, folder, "2")
    assert seen() == ["a"] and catalogue.current_version(spark, folder) == "1"
    catalogue.publish_snapshot(docs("b"), folder, "3")
    assert seen() == ["b"] and [r.sku for r in reader.collect()] == ["a"]  # who began before can end
    assert sorted(p.name for p in (tmp_path / "snapshots").glob("version=*")) == ["version=1", "version=3"]  # the broken build went
    catalogue.publish_snapshot(docs("c"), folder, "4")
    assert sorted(p.name for p in (tmp_path / "snapshots").glob("version=*")) == ["version=3", "version=4"]
    with pytest.raises(Exception, match="(?i)exist"):
        catalogue.publish_snapshot(docs("d"), folder, "4")
    assert seen() == ["c"]


def test_a_batch_run_twice_is_there_once(spark, tmp_path):
    from test_streams import write_events

    folder = str(tmp_path / "raw")
    raw = write_events(spark, folder)
    for k in (1, 2):  # without its checkpoint the stream runs batch 0 again
        streams.stream_events(spark.readStream.schema(raw.schema).parquet(folder), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / f"c{k}")).awaitTermination()
    good = spark.read.parquet(str(tmp_path / "ok"))
    assert good.count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    day = good.where("site_id = 's' and day = date'2024-01-01'")
    assert day.count() == 1 and len(day.inputFiles()) <= len(good.inputFiles())
    assert "PartitionFilters: [isnotnull(site_id" in day._jdf.queryExecution().toString() and (tmp_path / "ok" / "site_id=s" / "day=2024-01-01" / "batch=0").exists()


def test_hits_without_documents_fail_the_corpus_check(spark):
    case = spark.createDataFrame([("c", "a", None, None, None, None, None, None, None, None)], f"case_id string, site_id string, k int, expect {relevance.JUDGMENT}, at_least struct<n:int,of:{relevance.JUDGMENT}>, forbid {relevance.JUDGMENT}, partial boolean, min_results bigint, understands array<string>, rescued boolean")
    docs = spark.createDataFrame([("a", "S1", "P", ["X"], "B", True, "t", {"k": "v"})], "site_id string, sku string, parent_id string, category_path array<string>, brand string, in_stock boolean, title string, attrs map<string,string>")
    hits = spark.createDataFrame([("c", 1, "S1"), ("c", 2, "gone"), ("c", 11, "far")], "case_id string, card int, sku string")
    answers = spark.createDataFrame([("c", 2, None, None)], "case_id string, total bigint, understood array<string>, strategy string")
    row = relevance.judge_cases(case, hits, answers, docs).first()
    assert row.failures == ["corpus"] and not row.passed and row.precision == 1.0 and row.judged == 1 and row.coverage is None
    row = relevance.judge_cases(case, hits.limit(0), answers.limit(0), docs).first()
    assert row.passed and row.precision == 0.0 and row.total == 0
