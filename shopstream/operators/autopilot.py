"""Proposed merchandising changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .reports import days_back, top_n

PROPOSAL = ["site_id", "id", "kind", "subject", "object", "reach", "confidence"]


def promotions(events: DataFrame, rollup: DataFrame, parents: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Products that shoppers dig out from deep positions of much-searched queries. The 40 strongest rows are taken before the three best of each query, as in reports that look at rows."""
    recent = days_back(as_of, days - 1)
    asked = rollup.where(F.col("day") >= recent).groupBy("site_id", "normalised_query").agg(F.sum("searches").alias("searches")).where("searches >= 20")
    rows = events.where(F.col("type").isin("click", "add_to_cart") & F.col("sku").isNotNull() & (F.col("day") >= recent) & F.col("normalised_query").isNotNull())
    rows = rows.groupBy("site_id", "normalised_query", "sku").agg(F.count_if(F.col("type") == "click").alias("clicks"), F.avg(F.when(F.col("type") == "click", F.col("position"))).alias("depth"), F.count_if(F.col("type") == "add_to_cart").alias("carts"))
    rows = rows.where("clicks >= 5 and depth >= 4").join(asked, ["site_id", "normalised_query"]).join(parents, "sku")
    rows = top_n(rows, 40, F.desc("clicks"), F.asc("normalised_query"), F.asc("sku"))
    best = W.partitionBy("site_id", "normalised_query").orderBy(F.desc(F.round(F.col("clicks") * F.col("depth"), 6)), F.asc("sku"))
    rows = rows.withColumn("slot", F.row_number().over(best)).where("slot <= 3")
    confidence = 0.25 + F.least(F.lit(0.3), F.col("clicks") / 60) + F.least(F.lit(0.25), (F.col("depth") - 3) / 20) + F.when(F.col("carts") > 0, 0.1).otherwise(0.0)
    return rows.select("site_id", F.concat_ws(":", F.lit("promote"), "normalised_query", "parent_id").alias("id"), F.lit("promote").alias("kind"), F.col("normalised_query").alias("subject"), F.col("parent_id").alias("object"), F.col("searches").alias("reach"), F.round(confidence, 4).alias("confidence"), "slot")


def demotions(product_days: DataFrame, as_of: Column, days: int = 30, least: int = 120, limit: int = 25) -> DataFrame:
    """Products shown often and never clicked; confidence that the site's mean rate would have given a click."""
    rows = product_days.where(F.col("day") >= days_back(as_of, days - 1)).groupBy("site_id", "sku").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    mean = rows.groupBy("site_id").agg((F.sum("clicks") / F.sum("impressions")).alias("mean"))
    rows = rows.where((F.col("impressions") >= least) & (F.col("clicks") == 0)).join(mean, "site_id")
    rows = top_n(rows, limit, F.desc("impressions"), F.asc("sku"))
    return rows.select("site_id", F.concat_ws(":", F.lit("demote"), "sku").alias("id"), F.lit("demote").alias("kind"), F.col("sku").alias("subject"), F.lit(None).cast("string").alias("object"), F.col("impressions").alias("reach"), F.round(1 - F.pow(1 - F.col("mean"), F.col("impressions")), 4).alias("confidence"))


def synonym_proposals(rollup: DataFrame, as_of: Column, days: int = 30, least: int = 20, zero_share: float = 0.9) -> DataFrame:
    """Queries that find nothing beside the most alike productive query: shared words over the larger word set, at least a half."""
    sums = rollup.where(F.col("day") >= days_back(as_of, days - 1)).groupBy("site_id", "normalised_query").agg(F.sum("searches").alias("searches"), F.sum("clicks").alias("clicks"), F.sum("zero_results").alias("zero"))
    words = F.array_distinct(F.split("normalised_query", " "))
    dead = top_n(sums.where((F.col("searches") >= least) & (F.col("zero") >= zero_share * F.col("searches"))), 15, F.desc("searches"), F.asc("normalised_query"))
    live = top_n(sums.where("clicks > 0 and zero = 0"), 200, F.desc("clicks"), F.asc("normalised_query"))
    dead = dead.select("site_id", F.col("normalised_query").alias("subject"), F.col("searches").alias("reach"), F.size(words).alias("n1"), F.explode(words).alias("word"))
    live = live.select("site_id", F.col("normalised_query").alias("object"), F.col("clicks").alias("live_clicks"), F.size(words).alias("n2"), F.explode(words).alias("word"))
    pairs = dead.join(live, ["site_id", "word"]).groupBy("site_id", "subject", "object", "reach", "live_clicks", "n1", "n2").agg(F.count("*").alias("shared"))
    pairs = pairs.withColumn("score", F.col("shared") / F.greatest("n1", "n2")).where("score >= 0.5")
    best = W.partitionBy("site_id", "subject").orderBy(F.desc("score"), F.desc("live_clicks"), F.asc("object"))
    pairs = pairs.withColumn("n", F.row_number().over(best)).where("n = 1")
    return pairs.select("site_id", F.concat_ws(":", F.lit("synonym"), "subject", "object").alias("id"), F.lit("synonym").alias("kind"), "subject", "object", "reach", F.round(0.3 + 0.4 * F.col("score"), 4).alias("confidence"))


def proposals(kinds: list[DataFrame], dismissed: DataFrame, limit: int = 25) -> DataFrame:
    """All proposals that were not dismissed, by confidence and reach."""
    rows = kinds[0].select(PROPOSAL)
    for more in kinds[1:]:
        rows = rows.unionByName(more.select(PROPOSAL))
    rows = rows.join(dismissed, ["site_id", "id"], "left_anti")
    return top_n(rows.withColumn("weight", F.round(F.col("confidence") * F.log1p("reach"), 6)), limit, F.desc("weight"), F.asc("id"))


def auto_apply_candidates(promoted: DataFrame, least: float = 0.7, limit: int = 5) -> DataFrame:
    """Pin rules of the surest promotions: query, product, slot from 1."""
    rows = top_n(promoted.where(F.col("confidence") >= least), limit, F.desc("confidence"), F.asc("id"))
    slot = F.row_number().over(W.partitionBy("site_id", "subject").orderBy(F.desc("confidence"), F.asc("id")))
    return rows.select("site_id", F.col("subject").alias("query"), F.col("object").alias("parent_id"), slot.alias("pin_slot"), "confidence")
