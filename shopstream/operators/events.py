"""Shopper events: validation (P12), sessions (W10), impressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normalise

TYPES = ["search", "zero_result", "click", "product_view", "add_to_cart", "purchase", "facet_apply"]


def with_reject_reason(events: DataFrame, types: list[str] = TYPES) -> DataFrame:
    """events with `reason`: why an event is refused, first rule first; null for a valid one. Columns site_id, shopper_id, session_id, type and position are looked at; null and empty are missing."""
    missing = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    reason = (
        F.when(F.col("type").isNull() | ~F.col("type").isin(types), "unknown type")
        .when(missing("site_id"), "no site")
        .when(missing("shopper_id"), "no shopper")
        .when(missing("session_id"), "no session")
        .when((F.col("type") == "click") & (F.col("position") < 1), "bad position")
    )
    return events.withColumn("reason", reason)


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    marked = with_reject_reason(events)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def sessionise(events: DataFrame, user: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """events with session_no: per user from 1, a new one after a pause of more than gap_minutes. Events with one time belong together."""
    order = W.partitionBy(user).orderBy(ts)
    # To the microsecond: whole seconds would make a pause of 30:00.5 one of 30:00 or 30:01.
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    idle = at - F.lag(at).over(order)
    fresh = F.when(idle.isNull() | (idle > gap_minutes * 60 * 10**6), 1).otherwise(0)
    return events.withColumn("__new", fresh).withColumn("session_no", F.sum("__new").over(order.rangeBetween(W.unboundedPreceding, 0))).drop("__new")


def add_impressions(existing: DataFrame, served: DataFrame) -> DataFrame:
    """(site_id, day, sku, impressions): counts of served SKUs added to those there are."""
    more = served.groupBy("site_id", "day", "sku").agg(F.count("*").alias("impressions"))
    return existing.select("site_id", "day", "sku", "impressions").unionByName(more).groupBy("site_id", "day", "sku").agg(F.sum("impressions").alias("impressions"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends the valid events with their normalised query, by site and day. events: the columns of with_reject_reason, query and occurred_at."""
    accepted, _ = validate_events(events)
    rows = accepted.withColumn("normalised_query", normalise(F.col("query"))).withColumn("day", F.to_date("occurred_at"))
    rows.write.mode("append").partitionBy("site_id", "day").parquet(path)
