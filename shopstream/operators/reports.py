"""Reports over events and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import half_up, rate
from .rollup import SEARCHES, count_type


def days_back(as_of: Column, n: int) -> Column:
    return F.date_sub(F.to_date(as_of), n)


def search_attributed_purchases(events: DataFrame) -> DataFrame:
    """Purchases with an earlier or simultaneous search in their session. Each session's first search is enough to tell."""
    first = events.where(F.col("type").isin(SEARCHES)).groupBy("site_id", "session_id").agg(F.min("occurred_at").alias("first_search"))
    return events.where("type = 'purchase'").join(first, ["site_id", "session_id"]).where("first_search <= occurred_at").drop("first_search")


def overview(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row for each site: volume, quality, engagement and revenue in the window."""
    rows = events.where((F.col("occurred_at") >= as_of - F.expr(f"interval {days} days")) & (F.col("occurred_at") <= as_of))
    sums = rows.groupBy("site_id").agg(
        count_type(*SEARCHES).alias("searches"),
        F.count_distinct("normalised_query").alias("unique_queries"),
        count_type("zero_result").alias("zero_results"),
        F.count_if(F.col("type").isin(SEARCHES) & (F.col("result_count") < 3)).alias("low_results"),
        count_type("click").alias("clicks"),
        count_type("add_to_cart").alias("carts"),
        count_type("purchase").alias("orders"),
        F.round(F.coalesce(F.sum(F.when(F.col("type") == "purchase", F.col("revenue"))), F.lit(0.0)), 2).alias("revenue"),
        F.count_distinct(F.when(F.col("type").isin(SEARCHES), F.col("session_id"))).alias("search_sessions"),
    )
    led = search_attributed_purchases(rows).groupBy("site_id").agg(F.count("*").alias("search_orders"), F.round(F.sum("revenue"), 2).alias("search_revenue"))
    out = sums.join(led, "site_id", "left").fillna({"search_orders": 0, "search_revenue": 0.0})
    return out.select(
        "*",
        rate(F.col("zero_results"), F.col("searches")).alias("zero_rate"),
        rate(F.col("clicks"), F.col("searches")).alias("ctr"),
        rate(F.col("search_orders"), F.col("search_sessions")).alias("conversion"),
    )


def query_sums(rollup: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Sums over the window; avg_results is the mean of the daily means."""
    return rollup.where(F.col("day") >= days_back(as_of, days)).groupBy("site_id", "normalised_query").agg(
        F.sum("searches").alias("searches"), F.sum("clicks").alias("clicks"), F.sum("carts").alias("carts"), F.sum("purchases").alias("purchases"),
        F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("zero_results").alias("zero_results"), F.round(F.avg("avg_results"), 4).alias("avg_results"), F.sum("rescued").alias("rescued"),
    )


def with_suggestion(rows: DataFrame) -> DataFrame:
    return rows.withColumn("suggestion", F.when(F.col("zero_results") > 0, "synonym").when((F.col("clicks") == 0) & (F.col("searches") >= 3), "review"))


def top_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each site."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("site_id").orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def top_queries(rollup: DataFrame, as_of: Column, days: int = 30, limit: int = 25) -> DataFrame:
    return with_suggestion(top_n(query_sums(rollup, as_of, days), limit, F.desc("searches"), F.asc("normalised_query")))


def problem_queries(rollup: DataFrame, as_of: Column, days: int = 30, limit: int = 25) -> DataFrame:
    rows = query_sums(rollup, as_of, days).where("zero_results > 0 or avg_results < 3")
    return with_suggestion(top_n(rows, limit, F.desc("zero_results"), F.desc("searches"), F.asc("normalised_query")))


def trending(rollup: DataFrame, as_of: Column, days: int = 7, limit: int = 10) -> DataFrame:
    """Queries of the window against the equal one before it: rising (largest change first) and falling (below zero only)."""
    recent = F.col("day") >= days_back(as_of, days)
    rows = rollup.where(F.col("day") >= days_back(as_of, 2 * days)).groupBy("site_id", "normalised_query").agg(
        F.coalesce(F.sum(F.when(recent, F.col("searches"))), F.lit(0)).alias("current"), F.coalesce(F.sum(F.when(~recent, F.col("searches"))), F.lit(0)).alias("previous")
    ).where("current + previous >= 3")
    change = F.when(F.col("previous") == 0, 100.0).otherwise(half_up(100.0 * (F.col("current") - F.col("previous")) / F.col("previous"), 1))
    rows = rows.withColumn("change", change)
    rising = top_n(rows, limit, F.desc("change"), F.asc("normalised_query")).withColumn("direction", F.lit("rising"))
    falling = top_n(rows.where("change < 0"), limit, F.asc("change"), F.asc("normalised_query")).withColumn("direction", F.lit("falling"))
    return rising.unionByName(falling)


def clicked_products(events: DataFrame, limit: int = 10) -> DataFrame:
    """For each query the products most clicked or put in the cart; both count as clicks and towards the mean position."""
    rows = events.where(F.col("type").isin("click", "add_to_cart") & F.col("sku").isNotNull() & (F.coalesce(F.col("normalised_query"), F.lit("")) != ""))
    rows = rows.groupBy("site_id", "normalised_query", "sku").agg(F.count("*").alias("clicks"), F.round(F.avg("position"), 4).alias("avg_position"), count_type("add_to_cart").alias("carts"))
    rank = F.row_number().over(W.partitionBy("site_id", "normalised_query").orderBy(F.desc("clicks"), F.asc("sku")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def facet_usage(facet_days: DataFrame, as_of: Column, days: int = 30, limit: int = 20) -> DataFrame:
    rows = facet_days.where(F.col("day") >= days_back(as_of, days)).groupBy("site_id", "field", "value").agg(F.sum("applications").alias("applications"))
    return top_n(rows, limit, F.desc("applications"), F.asc("field"), F.asc("value"))


def timeseries(rollup: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    rows = rollup.where(F.col("day") >= days_back(as_of, days)).groupBy("site_id", "day")
    return rows.agg(F.sum("searches").alias("searches"), F.sum("zero_results").alias("zero_results"), F.sum("clicks").alias("clicks"), F.round(F.sum("revenue"), 2).alias("revenue"))


def terms_of(column: str = "normalised_query") -> Column:
    return F.explode(F.filter(F.split(column, " "), lambda t: F.length(t) > 2)).alias("term")


def term_insights(events: DataFrame, parents: DataFrame, limit: int = 25, per_term: int = 5) -> DataFrame:
    """For each word of queries: searches, clicks on products, the most clicked products and how concentrated the clicks are. parents: (sku, parent_id)."""
    asked = events.where(F.col("type").isin(SEARCHES) & F.col("normalised_query").isNotNull()).select("site_id", terms_of())
    asked = asked.groupBy("site_id", "term").agg(F.count("*").alias("searches"))
    clicked = events.where((F.col("type") == "click") & F.col("normalised_query").isNotNull()).join(parents, "sku").select("site_id", terms_of(), "parent_id")
    clicked = clicked.groupBy("site_id", "term", "parent_id").agg(F.count("*").alias("clicks"))
    order = W.partitionBy("site_id", "term").orderBy(F.desc("clicks"), F.asc("parent_id"))
    clicked = clicked.withColumn("n", F.row_number().over(order)).groupBy("site_id", "term").agg(
        F.sum("clicks").alias("clicks"), F.max("clicks").alias("top_clicks"), F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= per_term, F.struct("n", "parent_id")))), lambda s: s["parent_id"]).alias("products")
    )
    rows = top_n(asked, limit, F.desc("searches"), F.asc("term")).join(clicked, ["site_id", "term"], "left").fillna({"clicks": 0, "top_clicks": 0})
    return rows.select("site_id", "term", "searches", "clicks", rate(F.col("clicks"), F.col("searches")).alias("click_rate"), F.round(F.coalesce(F.try_divide("top_clicks", "clicks"), F.lit(0.0)), 4).alias("concentration"), F.array_join(F.coalesce("products", F.array()), "|").alias("products"))


def popular_queries(events: DataFrame, as_of: Column, days: int = 30, limit: int = 200) -> DataFrame:
    rows = events.where((F.col("type") == "search") & (F.col("result_count") > 0) & (F.col("occurred_at") >= as_of - F.expr(f"interval {days} days")))
    return top_n(rows.groupBy("site_id", "normalised_query").agg(F.count("*").alias("searches")), limit, F.desc("searches"), F.asc("normalised_query"))


def diagnose(rollup: DataFrame, understood: DataFrame, as_of: Column, days: int = 30, limit: int = 25) -> DataFrame:
    """Queries that go wrong, by kind and severity. understood: (site_id, normalised_query, brand, category) as recognised, null where not (without site_id: alike at every site)."""
    rows = top_n(query_sums(rollup, as_of, days).where("searches >= 5"), 500, F.desc("searches"), F.asc("normalised_query"))
    s = F.col("searches").cast("double")
    click_rate = F.col("clicks") / s
    rows = rows.withColumn("click_rate", click_rate).where("not (clicks > 0 and click_rate >= 0.15 and zero_results = 0)").join(understood, [*(c for c in ("site_id",) if c in understood.columns), "normalised_query"], "left")
    known = F.col("brand").isNotNull() | F.col("category").isNotNull()
    cases = [
        (F.col("zero_results") / s >= 0.5, "no_results", 3 * s),
        ((F.col("clicks") == 0) & ~known, "uncategorised", 2.5 * s),
        (F.col("clicks") == 0, "wrong_products", 2 * s),
        (F.col("rescued") / s >= 0.5, "rescue_dependent", s),
        (F.col("click_rate") < 0.15, "wrong_products", s * (1 - F.col("click_rate"))),
    ]
    kind, severity = F.lit(None).cast("string"), F.lit(None).cast("double")
    for test, name, weight in reversed(cases):
        kind, severity = F.when(test, name).otherwise(kind), F.when(test, weight).otherwise(severity)
    rows = rows.select("site_id", "normalised_query", "searches", "clicks", "zero_results", kind.alias("kind"), F.round(severity, 4).alias("severity")).where("kind is not null")
    return top_n(rows, limit, F.desc("severity"), F.asc("normalised_query"))
