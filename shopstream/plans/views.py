"""The shop's tables, derived from the driver's: catalogue variants from part and lineitem, shopper events and impressions from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
SITE = "main"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each buyable variant, with its parent's fields."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    sold = line.groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"), F.min("l_shipdate").alias("date_added"))
    key, name = F.col("p_partkey"), F.split("p_name", " ")
    return part.join(sold, key == F.col("l_partkey"), "left").select(
        F.lit(SITE).alias("site_id"),
        F.concat(F.lit("P"), key.cast("string")).alias("sku"),
        F.concat_ws("/", "p_name", "p_type").alias("parent_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category_top"),
        F.get(name, 1).alias("category_leaf"),
        F.get(name, 0).alias("finish"),
        F.col("p_size").cast("double").alias("size_in"),
        F.col("p_retailprice").alias("price"),
        F.when(key % 5 == 0, F.round(F.col("p_retailprice") * 0.8, 2)).otherwise(0.0).alias("sale_price"),
        F.when(key % 12 == 0, 0).otherwise(key % 320).alias("inventory"),
        (18 + key % 46).cast("double").alias("margin"),
        F.coalesce("units", F.lit(0.0)).alias("sales_velocity"),
        "date_added",
    )


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))


def shopper_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id")
    # The file of parts is small for its rows: Spark would send all of them through the driver.
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name").hint("merge")
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    types = {"view": "search", "error": "zero_result", "signup": "add_to_cart"}
    mapped = kind
    for old, new in types.items():
        mapped = F.when(kind == old, new).otherwise(mapped)
    return _keyed_events(spark, sf_dir).join(names, "k").select(
        F.lit(SITE).alias("site_id"),
        eid.alias("id"),
        mapped.alias("type"),
        F.col("user_id").cast("string").alias("shopper_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string")).alias("session_id"),
        F.col("ts").alias("occurred_at"),
        F.to_date("ts").alias("day"),
        F.when(kind != "purchase", F.col("p_name")).alias("normalised_query"),
        F.when(kind == "click", 1 + eid % 20).alias("position"),
        F.when(kind.isin("click", "signup", "purchase"), F.concat(F.lit("P"), ((F.col("k") * 7 + eid % 3) % 200).cast("string"))).alias("sku"),
        F.when((kind == "view") & (eid % 4 == 0), F.concat(F.lit('{"finish":["'), F.get(F.split("p_name", " "), 0), F.lit('"]}'))).alias("filters"),
        F.when(kind == "view", F.col("k")).when(kind == "error", 0).alias("result_count"),
        F.when(kind == "purchase", F.col("value")).alias("revenue"),
        F.when((kind == "error") & (eid % 3 == 0), "spell_correct").alias("rescue_strategy"),
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _keyed_events(spark, sf_dir).where("event_type = 'view'").select(F.to_date("ts").alias("day"), "k", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    sku = F.concat(F.lit("P"), ((F.col("k") * 7 + F.col("i")) % 200).cast("string"))
    return shown.groupBy(F.lit(SITE).alias("site_id"), "day", sku.alias("sku")).agg(F.count("*").alias("impressions"))


#: The same tables as common table expressions for DuckDB.
VARIANTS_SQL = """variants AS (
  SELECT 'main' AS site_id, 'P' || p_partkey AS sku, p_name || '/' || p_type AS parent_id, p_name AS title, p_brand AS brand, p_type AS category_top,
    split_part(p_name, ' ', 2) AS category_leaf, split_part(p_name, ' ', 1) AS finish, CAST(p_size AS DOUBLE) AS size_in, p_retailprice AS price,
    CASE WHEN p_partkey % 5 = 0 THEN ROUND(p_retailprice * 0.8, 2) ELSE 0.0 END AS sale_price,
    CASE WHEN p_partkey % 12 = 0 THEN 0 ELSE p_partkey % 320 END AS inventory, CAST(18 + p_partkey % 46 AS DOUBLE) AS margin,
    COALESCE(l.units, 0.0) AS sales_velocity, l.first_ship AS date_added
  FROM part LEFT JOIN (SELECT l_partkey, SUM(l_quantity) AS units, MIN(l_shipdate) AS first_ship FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p_partkey)"""
EVENTS_SQL = """ev0 AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 7) AS INT) AS wk FROM events),
shopper_events AS (
  SELECT 'main' AS site_id, e.event_id AS id,
    CASE event_type WHEN 'view' THEN 'search' WHEN 'error' THEN 'zero_result' WHEN 'signup' THEN 'add_to_cart' ELSE event_type END AS type,
    CAST(user_id AS VARCHAR) AS shopper_id, CAST(user_id AS VARCHAR) || '-' || CAST(wk AS VARCHAR) AS session_id, ts AS occurred_at, CAST(ts AS DATE) AS day,
    CASE WHEN event_type = 'purchase' THEN NULL ELSE q.p_name END AS normalised_query,
    CASE WHEN event_type = 'click' THEN 1 + e.event_id % 20 END AS position,
    CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 'P' || CAST((k * 7 + e.event_id % 3) % 200 AS VARCHAR) END AS sku,
    CASE WHEN event_type = 'view' AND e.event_id % 4 = 0 THEN '{"finish":["' || split_part(q.p_name, ' ', 1) || '"]}' END AS filters,
    CASE event_type WHEN 'view' THEN k WHEN 'error' THEN 0 END AS result_count,
    CASE WHEN event_type = 'purchase' THEN value END AS revenue,
    CASE WHEN event_type = 'error' AND e.event_id % 3 = 0 THEN 'spell_correct' END AS rescue_strategy
  FROM ev0 e JOIN part q ON q.p_partkey = e.k),
impressions AS (
  SELECT 'main' AS site_id, CAST(ts AS DATE) AS day, 'P' || CAST((k * 7 + n.i) % 200 AS VARCHAR) AS sku, COUNT(*) AS impressions
  FROM ev0 CROSS JOIN (SELECT unnest(range(0, 6)) AS i) n WHERE event_type = 'view' GROUP BY ALL)"""
