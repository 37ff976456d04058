"""Streams of shopper events: appended with rejects aside (T1), impressions (T2), rollups kept current (T3), sessions (T4), price deltas (T5).

Sources are streaming DataFrames; sinks are tables of Parquet files. Checkpoints belong to the caller:
every function takes the folder for its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import normalise
from ..operators.catalogue import apply_price_deltas
from ..operators.events import with_reject_reason
from ..operators.rollup import overwrite_days, rollup_query_day


def stream_events(raw: DataFrame, path: str, rejects: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Valid events by site, day and batch, refused ones with their reason beside them.

    A batch owns the folders site_id=/day=/batch= of its number. One that fails is run again over the same
    rows and replaces these folders and no others, so each event is there once, and readers of a site's day
    see only its folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = lambda rows, *by: rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch")
        marked = with_reject_reason(batch.withColumn("normalised_query", normalise(F.col("query"))).withColumn("day", F.to_date("occurred_at")))
        own(marked.where("reason is null").drop("reason"), "site_id", "day").parquet(path)
        own(marked.where("reason is not null")).parquet(rejects)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_impressions(served: DataFrame, late: str = "2 days") -> DataFrame:
    """(window, site_id, sku, impressions), event time in column ts."""
    return served.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "site_id", "sku").agg(F.count("*").alias("impressions"))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_window, shopper_id, events, clicks): sessions that end after a pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "shopper_id").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "click").alias("clicks"))


def stream_query_rollup(events: DataFrame, stored_events: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the daily query rollup current: the days that a batch touches are computed again from the stored events, so distinct counts stay exact."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        days = batch.select("site_id", F.to_date("occurred_at").alias("day")).distinct()
        overwrite_days(rollup_query_day(spark.read.parquet(stored_events).join(days, ["site_id", "day"], "left_semi")), path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_price_deltas(updates: DataFrame, docs_path: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch of updates gives the next snapshot of the documents; of several updates for a SKU the last by `at` counts."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = docs_path if number == 0 else f"{out}/snapshot={number - 1}"
        apply_price_deltas(spark.read.parquet(current), batch).write.mode("overwrite").parquet(f"{out}/snapshot={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
