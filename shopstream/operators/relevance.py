"""Judged relevance: coverage cases (D12), judging (D13), summary (A23) and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .retrieve import PARTS


def coverage_cases(docs: DataFrame, least: int = 3) -> DataFrame:
    """(case_id, query, category_id, finish, expected): a case for each leaf category with enough products, and for each finish in its most usual leaf."""
    leaf = F.element_at("category_ids", -1)
    rows = docs.select("parent_id", "finish", leaf.alias("category_id"), "category_leaf")
    leaves = rows.groupBy("category_id", "category_leaf").agg(F.count_distinct("parent_id").alias("expected")).where(F.col("expected") >= least)
    leaves = leaves.select(F.concat_ws(":", F.lit("category"), "category_id").alias("case_id"), F.lower("category_leaf").alias("query"), "category_id", F.lit(None).cast("string").alias("finish"), "expected")
    spoken = rows.groupBy("finish", "category_id", "category_leaf").agg(F.count_distinct("parent_id").alias("expected"))
    spoken = spoken.withColumn("n", F.row_number().over(W.partitionBy("finish").orderBy(F.desc("expected"), "category_id"))).where((F.col("n") == 1) & (F.col("expected") >= least))
    spoken = spoken.select(F.concat_ws(":", F.lit("finish"), "finish").alias("case_id"), F.lower(F.concat_ws(" ", "finish", "category_leaf")).alias("query"), "category_id", "finish", "expected")
    return leaves.unionByName(spoken)


def judge_hits(cases: DataFrame, hits: DataFrame, totals: DataFrame, docs: DataFrame, k: int = 10, at_least: float = 0.8) -> DataFrame:
    """(case_id, precision, coverage, focus, passed). hits: (case_id, card, sku); totals: (case_id, total). A hit is right if it is in the case's category and has its finish, where it names one."""
    seen = hits.where(F.col("card") <= k).join(docs.select("sku", F.col("finish").alias("doc_finish"), "category_ids").hint("merge"), "sku").join(cases, "case_id")
    right = F.exists("category_ids", lambda c: c == F.col("category_id")) & (F.col("finish").isNull() | (F.col("finish") == F.col("doc_finish")))
    found = seen.groupBy("case_id").agg((F.count_if(right) / F.count("*")).alias("precision"))
    rows = cases.join(found, "case_id", "left").join(totals, "case_id", "left").fillna({"precision": 0.0, "total": 0})
    e, t = F.col("expected").cast("double"), F.col("total").cast("double")
    return rows.select("case_id", F.round("precision", 6).alias("precision"), F.round(F.least(F.lit(1.0), t / e), 6).alias("coverage"), F.round(F.least(F.lit(1.0), e / F.greatest(t, e)), 6).alias("focus"), (F.col("precision") >= at_least).alias("passed"))


#: A judgment of a document; all that is not null must hold, of any_of one.
SIMPLE = "category string, brand string, in_stock boolean, title string, attrs map<string,array<string>>"
JUDGMENT = f"struct<{', '.join(f.replace(' ', ':', 1) for f in SIMPLE.split(', '))}, any_of:array<struct<{', '.join(f.replace(' ', ':', 1) for f in SIMPLE.split(', '))}>>>".replace(", ", ",")


def fulfils(judgment: Column, doc: dict[str, Column]) -> Column:
    """Whether a document is what a judgment asks for (true for a null judgment). doc: category_path, brand, in_stock, title (with the variant's), attrs (map<string, string>)."""

    def simple(j: Column) -> Column:
        path = F.exists(doc["category_path"], lambda c: F.lower(c).contains(F.lower(j["category"])))
        attrs = F.forall(F.map_entries(j["attrs"]), lambda e: F.coalesce(F.array_contains(F.transform(e["value"], lambda v: F.lower(v)), F.lower(F.try_element_at(doc["attrs"], e["key"]))), F.lit(False)))
        tests = [(j["category"], path), (j["brand"], F.lower(doc["brand"]) == F.lower(j["brand"])), (j["in_stock"], doc["in_stock"] == j["in_stock"]), (j["title"], F.regexp_like(doc["title"], F.concat(F.lit("(?i)"), j["title"]))), (j["attrs"], attrs)]
        return reduce(lambda a, b: a & b, [asked.isNull() | F.coalesce(test, F.lit(False)) for asked, test in tests])

    some = F.coalesce(F.size(judgment["any_of"]), F.lit(0)) > 0
    return judgment.isNull() | (simple(judgment) & (~some | F.exists(judgment["any_of"], simple)))


def judge_cases(cases: DataFrame, hits: DataFrame, answers: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, precision, coverage, focus, expected, matched, judged, total, passed, failures) of all cases in one pass.

    cases: (case_id, site_id, k, expect, at_least: struct<n, of>, forbid, partial, min_results, understands:
    array<string>, rescued), judgments as JUDGMENT, nulls for what a case does not ask. hits: (case_id,
    card, sku); answers: (case_id, total, understood: array<string>, strategy); docs: (site_id, sku,
    parent_id, category_path, brand, in_stock, title, attrs).

    A case passes if nothing is in failures: corpus (a hit's document is not there), expect, at_least,
    forbid, min_results, understands, rescued, coverage. Precision is over the first k hits (10), 0 without
    hits; coverage and focus compare the products found with those of the whole site that are expected,
    and are null for partial cases and where none are. Cases without an answer count as found nothing.
    """
    doc = {c: F.col(f"doc.{c}") for c in ("category_path", "brand", "in_stock", "title", "attrs")}
    packed = docs.select("site_id", "sku", "parent_id", F.struct(*[F.col(c) for c in doc]).alias("doc"))
    asked = cases.withColumn("k", F.coalesce("k", F.lit(10)))
    seen = hits.join(asked, "case_id").where(F.col("card") <= F.col("k")).join(packed.hint("merge"), ["site_id", "sku"], "left")
    there = F.col("doc").isNotNull()
    seen = seen.groupBy("case_id").agg(
        F.count("*").alias("shown"), F.count_if(there).alias("judged"), F.count_if(there & fulfils(F.col("expect"), doc)).alias("matched"), F.count_if(there & fulfils(F.col("at_least.of"), doc)).alias("enough"),
        F.count_if(there & F.col("forbid").isNotNull() & fulfils(F.col("forbid"), doc)).alias("bad"),
    )
    whole = asked.where(F.col("expect").isNotNull() & ~F.coalesce("partial", F.lit(False))).select("case_id", "site_id", "expect")
    # The suite is a stated set of cases; each is held against all different documents of its site, in parts, so that a site is no single task.
    listed = [F.sort_array(F.map_entries("doc.attrs")).alias("attrs") if c == "attrs" else F.col(f"doc.{c}").alias(c) for c in doc]
    different = packed.select("site_id", "parent_id", *listed).distinct().withColumn("attrs", F.map_from_entries("attrs"))
    different = different.select("site_id", "parent_id", F.pmod(F.xxhash64("parent_id", "brand", "title"), F.lit(PARTS)).cast("int").alias("part"), F.struct(*doc).alias("doc"))
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    expected = different.hint("merge").join(whole, ["site_id", "part"]).where(fulfils(F.col("expect"), doc)).groupBy("case_id").agg(F.count_distinct("parent_id").alias("expected"))
    rows = asked.join(seen, "case_id", "left").join(answers, "case_id", "left").join(expected, "case_id", "left").fillna(0, ["shown", "judged", "matched", "enough", "bad", "total"])
    e, t = F.col("expected").cast("double"), F.col("total").cast("double")
    coverage = F.when(e.isNotNull(), F.least(F.lit(1.0), t / e))  # least() passes over nulls
    focus = F.when(e.isNotNull(), F.least(F.lit(1.0), e / F.greatest(t, e)))
    lifted = F.transform(F.coalesce("understood", F.array().cast("array<string>")), lambda v: F.lower(v))
    fails = {
        "corpus": F.col("shown") > F.col("judged"), "expect": F.col("matched") < F.col("judged"), "at_least": F.col("enough") < F.col("at_least.n"), "forbid": F.col("bad") > 0, "min_results": F.col("total") < F.col("min_results"),
        "understands": F.exists("understands", lambda u: ~F.array_contains(lifted, F.lower(u))), "rescued": F.col("strategy").isNotNull() != F.col("rescued"), "coverage": coverage < 0.999,
    }
    failures = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in fails.items()]), lambda f: f.isNotNull())
    precision = F.when(F.col("judged") > 0, F.col("matched") / F.col("judged")).otherwise(0.0)
    three = lambda c: F.round(c, 3)
    return rows.select("case_id", three(precision).alias("precision"), three(coverage).alias("coverage"), three(focus).alias("focus"), "expected", "matched", "judged", "total", (F.size(failures) == 0).alias("passed"), failures.alias("failures"))


def suite_summary(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("focus"), 6).alias("focus"))


def baseline_drift(now: DataFrame, before: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(case_id, drift): regression, improvement, same, new or gone, of two runs of a suite."""
    measures = ["precision", "coverage", "focus"]
    rows = now.select("case_id", F.struct(*measures, "passed").alias("now")).join(before.select("case_id", F.struct(*measures, "passed").alias("old")), "case_id", "full_outer")
    down, up = F.col("old.passed") & ~F.col("now.passed"), F.col("now.passed") & ~F.col("old.passed")
    for m in measures:
        down, up = down | (F.col(f"now.{m}") < F.col(f"old.{m}") - tolerance), up | (F.col(f"now.{m}") > F.col(f"old.{m}") + tolerance)
    return rows.select("case_id", F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "gone").when(down, "regression").when(up, "improvement").otherwise("same").alias("drift"))


def landing_pages(directory: DataFrame, collections: DataFrame) -> DataFrame:
    """(path, title, priority, source) of category and collection pages (R15, U5). directory: (category_id, depth, path, products); collections: (slug, title)."""
    pages = directory.select(F.concat(F.lit("/c/"), "category_id").alias("path"), F.col("path").alias("title"), F.round(F.greatest(F.lit(0.3), 1 - 0.2 * (F.col("depth") - 1)), 4).alias("priority"), F.lit("category").alias("source"))
    return pages.unionByName(collections.select(F.concat(F.lit("/collections/"), "slug").alias("path"), "title", F.lit(0.8).alias("priority"), F.lit("collection").alias("source")))


def union_cases(written: DataFrame, generated: DataFrame) -> DataFrame:
    """Hand-written cases and generated ones; columns that only one of them has are null in the other."""
    return written.unionByName(generated, allowMissingColumns=True)
