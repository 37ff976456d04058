"""Recommendations for all anchors at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .retrieve import PARTS


def similar_requests(anchors: DataFrame, extra: list[str], words: int = 6) -> DataFrame:
    """(site_id, anchor, query_id, terms, category_id): a request for each anchor (C1), of the first words of its title and the values of the columns `extra` (style, material), inside its deepest category. Anchors that ask the same have the same query_id. anchors: (site_id, parent_id, title, category_ids, extra); those without a word or a category ask nothing."""
    plain = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
    title = F.slice(F.filter(F.split(F.coalesce("title", F.lit("")), r"\s+"), lambda t: t != ""), 1, words)
    terms = F.array_distinct(F.concat(plain(F.array_join(title, " ")), *[plain(F.col(c)) for c in extra]))
    rows = anchors.select("site_id", F.col("parent_id").alias("anchor"), terms.alias("terms"), F.try_element_at("category_ids", F.lit(-1)).alias("category_id"))
    return rows.where((F.size("terms") > 0) & F.col("category_id").isNotNull()).withColumn("query_id", F.concat_ws("|", "site_id", F.array_join("terms", " "), "category_id"))


def similar(requests: DataFrame, cards: DataFrame, limit: int = 8, spare: int = 4) -> DataFrame:
    """(site_id, anchor, parent_id, rank): what each anchor's request found, without the anchor itself. cards: (query_id, parent_id, card) of the distinct requests, of which limit + spare are looked at, so rows grow with the anchors and not with their pairs."""
    asked = requests.select("site_id", "anchor", "query_id").distinct().withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(PARTS)).cast("int"))
    shown = cards.where(F.col("card") <= limit + spare).select("query_id", "parent_id", "card", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    # anchors are many and a request may be asked by many of them: they are merged in parts, not sent through the driver
    found = asked.hint("merge").join(shown, ["query_id", "part"]).drop("part").where("anchor <> parent_id")
    rank = F.row_number().over(W.partitionBy("site_id", "anchor").orderBy("card"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("site_id", "anchor", "parent_id", "rank")


def bought_together(events: DataFrame, as_of: Column, days: int = 90, least: int = 2, limit: int = 8) -> DataFrame:
    """(site_id, anchor, parent_id, sessions, rank): products carted or bought in the same sessions as the anchor, whatever their variants. events: with parent_id. The window holds for the anchor's side only. Each session counts a product once before the join, so pairs grow with a session's different products."""
    acted = events.where(F.col("type").isin("purchase", "add_to_cart") & F.col("parent_id").isNotNull()).groupBy("site_id", "session_id", "parent_id").agg(F.max("occurred_at").alias("last"))
    anchors = acted.where(F.col("last") >= as_of - F.expr(f"interval {days} days")).select("site_id", "session_id", F.col("parent_id").alias("anchor"))
    pairs = anchors.join(acted.select("site_id", "session_id", "parent_id"), ["site_id", "session_id"]).where("anchor <> parent_id")
    pairs = pairs.groupBy("site_id", "anchor", "parent_id").agg(F.count("*").alias("sessions")).where(F.col("sessions") >= least)
    rank = F.row_number().over(W.partitionBy("site_id", "anchor").orderBy(F.desc("sessions"), F.asc("parent_id")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit)


def recently_viewed(events: DataFrame, parents: DataFrame, as_of: Column, days: int = 30, limit: int = 8) -> DataFrame:
    """(site_id, shopper_id, parent_id, last_seen, rank): each shopper's products, newest first."""
    seen = events.where(F.col("type").isin("product_view", "click") & (F.col("occurred_at") >= as_of - F.expr(f"interval {days} days"))).join(parents, "sku")
    seen = seen.groupBy("site_id", "shopper_id", "parent_id").agg(F.max("occurred_at").alias("last_seen"))
    rank = F.row_number().over(W.partitionBy("site_id", "shopper_id").orderBy(F.desc("last_seen"), F.asc("parent_id")))
    return seen.withColumn("rank", rank).where(F.col("rank") <= limit)


def viewed_beside(anchors: DataFrame, viewed: DataFrame, limit: int = 8) -> DataFrame:
    """(site_id, shopper_id, anchor, parent_id, last_seen, rank): what each shopper has seen lately, without the product now looked at. anchors: (site_id, shopper_id, anchor); viewed: what recently_viewed gives for limit + 1."""
    rows = anchors.join(viewed, ["site_id", "shopper_id"]).where("not (anchor <=> parent_id)")
    rank = F.row_number().over(W.partitionBy("site_id", "shopper_id", "anchor").orderBy("rank"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("site_id", "shopper_id", "anchor", "parent_id", "last_seen", "rank")


def trending_products(events: DataFrame, as_of: Column, days: int = 7, limit: int = 8) -> DataFrame:
    """(site_id, parent_id, clicks, rank): the most clicked products of each site. events: with parent_id."""
    rows = events.where((F.col("type") == "click") & F.col("parent_id").isNotNull() & (F.col("occurred_at") >= as_of - F.expr(f"interval {days} days")))
    rows = rows.groupBy("site_id", "parent_id").agg(F.count("*").alias("clicks"))
    rank = F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("clicks"), F.asc("parent_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def top_sellers(docs: DataFrame, limit: int = 8) -> DataFrame:
    """(site_id, parent_id, velocity, rank): best-selling products of each site."""
    rows = docs.groupBy("site_id", "parent_id").agg(F.max("sales_velocity").alias("velocity"))
    rank = F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("velocity"), F.asc("parent_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def with_fallback(anchors: DataFrame, found: DataFrame, sellers: DataFrame, limit: int = 8) -> DataFrame:
    """(site_id, anchor, item, rank, served_by): what was found for each anchor, or the top sellers without the anchor itself. anchors: (site_id, anchor); found: (site_id, anchor, item, rank); sellers: (site_id, item, rank)."""
    own = found.select("site_id", "anchor", "item", "rank", F.lit("strategy").alias("served_by"))
    empty = anchors.join(found, ["site_id", "anchor"], "left_anti")
    rest = empty.join(sellers, "site_id").where("anchor <> item")
    rank = F.row_number().over(W.partitionBy("site_id", "anchor").orderBy("rank"))
    rest = rest.withColumn("rank", rank).where(F.col("rank") <= limit).select("site_id", "anchor", "item", "rank", F.lit("top_sellers").alias("served_by"))
    return own.unionByName(rest)
