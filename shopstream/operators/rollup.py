"""Daily rollups (A1-A4, J1, J3, J12, D1) and their maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCHES = ["search", "zero_result"]


def count_type(*types: str):
    return F.count_if(F.col("type").isin(*types))


def rollup_query_day(events: DataFrame) -> DataFrame:
    """One row for each site, day and query that is not empty: volume, engagement, quality."""
    rows = events.where(F.coalesce(F.col("normalised_query"), F.lit("")) != "")
    return rows.groupBy("site_id", "day", "normalised_query").agg(
        count_type(*SEARCHES).alias("searches"),
        count_type("click").alias("clicks"),
        count_type("add_to_cart").alias("carts"),
        count_type("purchase").alias("purchases"),
        F.coalesce(F.sum(F.when(F.col("type") == "purchase", F.col("revenue"))), F.lit(0.0)).alias("revenue"),
        count_type("zero_result").alias("zero_results"),
        F.avg("result_count").alias("avg_results"),
        F.avg(F.when(F.col("type") == "click", F.col("position"))).alias("avg_click_position"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(F.col("rescue_strategy").isNotNull()).alias("rescued"),
    )


def purchase_touches(events: DataFrame) -> DataFrame:
    """(site_id, purchase_id, revenue, query, day): the different queries, by day, that a session searched up to each purchase.

    Searches are made distinct by session, query and day before the join, with their earliest time: a
    touch exists if that one is not later than the purchase. So a session's searches do not multiply.
    """
    bought = events.where((F.col("type") == "purchase") & F.col("revenue").isNotNull()).select("site_id", "session_id", F.col("id").alias("purchase_id"), "revenue", F.col("occurred_at").alias("bought_at"))
    asked = events.where(F.col("type").isin(SEARCHES) & (F.coalesce(F.col("normalised_query"), F.lit("")) != ""))
    asked = asked.groupBy("site_id", "session_id", F.col("normalised_query").alias("query"), "day").agg(F.min("occurred_at").alias("asked_at"))
    return bought.join(asked, ["site_id", "session_id"]).where("asked_at <= bought_at").select("site_id", "purchase_id", "revenue", "query", "day")


def attribute_revenue(rollup: DataFrame, touches: DataFrame) -> DataFrame:
    """rollup with revenue shared out evenly over the touches of each purchase; rows that no touch reaches keep theirs."""
    n = touches.groupBy("site_id", "purchase_id").agg(F.count("*").alias("n"))
    shares = touches.join(n, ["site_id", "purchase_id"]).groupBy("site_id", F.col("query").alias("normalised_query"), "day").agg(F.sum(F.col("revenue") / F.col("n")).alias("share"))
    joined = rollup.join(shares, ["site_id", "normalised_query", "day"], "left")
    return joined.withColumn("revenue", F.coalesce("share", "revenue")).drop("share")


def rollup_product_day(events: DataFrame, impressions: DataFrame) -> DataFrame:
    """One row for each site, day and SKU that was shown or acted on."""
    acted = events.where(F.col("sku").isNotNull()).groupBy("site_id", "day", "sku").agg(
        count_type("click").alias("clicks"),
        count_type("add_to_cart").alias("carts"),
        count_type("purchase").alias("purchases"),
        F.coalesce(F.sum(F.when(F.col("type") == "purchase", F.col("revenue"))), F.lit(0.0)).alias("revenue"),
    )
    zeros = {"impressions": 0, "clicks": 0, "carts": 0, "purchases": 0, "revenue": 0.0}
    return acted.join(impressions, ["site_id", "day", "sku"], "full_outer").select("site_id", "day", "sku", *zeros).fillna(zeros)


def explode_event_filters(events: DataFrame) -> DataFrame:
    """(site_id, day, field, value) of every filter that an event carries."""
    parsed = F.from_json("filters", "map<string,array<string>>")
    return events.where(F.col("filters").isNotNull()).select("site_id", "day", F.explode(parsed).alias("field", "values")).select("site_id", "day", "field", F.explode("values").alias("value"))


def rollup_facet_day(events: DataFrame) -> DataFrame:
    return explode_event_filters(events).groupBy("site_id", "day", "field", "value").agg(F.count("*").alias("applications"))


def since(events: DataFrame, first_day: str | None) -> DataFrame:
    """Events from midnight of a day on, so that whole days are rolled up."""
    return events if first_day is None else events.where(F.col("day") >= F.lit(first_day).cast("date"))


def rollup(events: DataFrame, impressions: DataFrame, first_day: str | None = None) -> dict[str, DataFrame]:
    """The daily tables. Touches look at searches of all days, purchases from first_day on."""
    recent = since(events, first_day)
    touches = purchase_touches(events)
    if first_day is not None:
        touches = touches.join(recent.where("type = 'purchase'").select(F.col("id").alias("purchase_id"), "site_id"), ["site_id", "purchase_id"], "left_semi")
    return {
        "daily_query": attribute_revenue(rollup_query_day(recent), touches),
        "daily_product": rollup_product_day(recent, since(impressions, first_day)),
        "daily_facet": rollup_facet_day(recent),
    }


def overwrite_days(df: DataFrame, path: str) -> None:
    """Replaces the (site, day) partitions that df has, and no others: a repeated run repairs and never counts twice."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy("site_id", "day").mode("overwrite").parquet(path)


def rollup_runs(events: DataFrame) -> DataFrame:
    """Events seen for each site and day."""
    return events.groupBy("site_id", "day").agg(F.count("*").alias("events_seen"))


def log_rollup_run(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Runs by (site, day), the new ones in place of the old."""
    return existing.join(new, ["site_id", "day"], "left_anti").unionByName(new)
