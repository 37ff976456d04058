"""Queries over entities, browsing, autocomplete, rescue and feed housekeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discover, reports
from .registry import Registry
from .search import DOCS_SQL, docs
from .views import AS_OF, EVENTS_SQL, as_of, shopper_events, table

REGISTRY = Registry()
QUERIES, ORACLE, query = REGISTRY.queries, REGISTRY.oracle, REGISTRY.query


def index_of(spark, sf_dir):
    rows = docs(spark, sf_dir)
    count = lambda field, c: rows.groupBy(F.lit(field).alias("field"), F.col(c).alias("value")).agg(F.count_distinct("parent_id").alias("products"))
    return discover.entity_index(count("brand", "brand").unionByName(count("category", "category_leaf")), count("finish", "finish"))


KEYS = "CASE WHEN v LIKE '%ies' THEN regexp_replace(v, 'ies$', 'y') WHEN regexp_matches(v, '[^s]s$') THEN left(v, length(v) - 1) ELSE v END"
INDEX_SQL = f"""{DOCS_SQL}, en AS (SELECT 'brand' AS field, brand AS value, 0 AS p, COUNT(DISTINCT parent_id) AS n FROM docs GROUP BY brand UNION ALL SELECT 'category', category_leaf, 1, COUNT(DISTINCT parent_id) FROM docs GROUP BY category_leaf
  UNION ALL SELECT 'finish', finish, 2, COUNT(DISTINCT parent_id) FROM docs GROUP BY finish), ek AS (SELECT *, lower(value) AS v FROM en),
ix AS (SELECT key, field, value FROM (SELECT field, value, p, n, unnest(list_distinct([v, {KEYS}, {KEYS} || 's'])) AS key FROM ek) QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY p, n DESC, field, value) = 1)"""


@query(f"WITH {INDEX_SQL} SELECT key, field, value FROM ix")
def build_entity_index(spark, sf_dir):
    return index_of(spark, sf_dir).select("key", "field", "value")


def plural_queries(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat_ws(" ", F.lit("shiny"), F.concat("p_name", F.lit("s"))).alias("query_id")).distinct().withColumn("terms", F.split("query_id", " "))


@query("SELECT DISTINCT 'shiny ' || p_name || 's' AS query_id, 'finish=' || split_part(p_name, ' ', 1) || '|category=' || split_part(p_name, ' ', 2) AS entities, 'shiny' AS rest FROM part")
def lift_entities(spark, sf_dir):
    rows = discover.lift_entities(plural_queries(spark, sf_dir), index_of(spark, sf_dir))
    return rows.select("query_id", F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["field"], e["value"])), "|").alias("entities"), F.array_join("rest", "|").alias("rest"))


@query("SELECT DISTINCT 'shiny ' || p_name || 's' AS query_id, split_part(p_name, ' ', 1) AS finish, split_part(p_name, ' ', 2) AS category FROM part")
def constraints_to_filters(spark, sf_dir):
    rows = discover.constraints_to_filters(discover.lift_entities(plural_queries(spark, sf_dir), index_of(spark, sf_dir)))
    return rows.select("query_id", F.try_element_at("filters", F.lit("finish")).alias("finish"), "category")


@query(f"WITH {DOCS_SQL} SELECT category_id, CAST(ROW_NUMBER() OVER (PARTITION BY category_id ORDER BY MAX(sales_velocity) DESC, parent_id) AS INT) AS place, parent_id, MAX(sales_velocity) AS velocity FROM (SELECT unnest(category_ids) AS category_id, parent_id, sales_velocity FROM docs) GROUP BY category_id, parent_id QUALIFY place <= 24")
def browse(spark, sf_dir):
    return discover.browse(docs(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL}, pop AS (SELECT normalised_query AS query, COUNT(*) AS searches FROM shopper_events WHERE type = 'search' AND result_count > 0 AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1 QUALIFY ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, normalised_query) <= 200),
px AS (SELECT DISTINCT substr(w, 1, 3) AS prefix FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))
SELECT prefix, query, CAST(ROW_NUMBER() OVER (PARTITION BY prefix ORDER BY CASE WHEN starts_with(query, prefix) THEN 0 ELSE 1 END, searches DESC, query) AS INT) AS place FROM px JOIN pop ON contains(query, prefix) AND query <> prefix QUALIFY place <= 6""")
def autocomplete(spark, sf_dir):
    popular = reports.popular_queries(shopper_events(spark, sf_dir), as_of()).select(F.col("normalised_query").alias("query"), "searches")
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return discover.autocomplete(words.select(F.substring("w", 1, 3).alias("prefix")), popular)


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part), t AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a, substr(split_part(p_name, ' ', 2), 1, 1) || substr(split_part(p_name, ' ', 2), 3) AS b FROM part),
c AS (SELECT b, token FROM (SELECT DISTINCT b FROM t WHERE b NOT IN (SELECT token FROM v)) JOIN v ON substr(token, 1, 1) = substr(b, 1, 1) AND levenshtein(b, token) <= CASE WHEN length(b) >= 8 THEN 2 WHEN length(b) >= 4 THEN 1 ELSE 0 END AND length(b) >= 4 QUALIFY ROW_NUMBER() OVER (PARTITION BY b ORDER BY levenshtein(b, token), length(token), token) = 1)
SELECT p_name AS query_id, CASE WHEN c.token IS NOT NULL THEN 'spell_correct' ELSE 'relax_terms' END AS strategy, CASE WHEN c.token IS NOT NULL THEN a || '|' || c.token WHEN b IN (SELECT token FROM v) THEN a || '|' || b ELSE a END AS terms FROM t LEFT JOIN c USING (b)""")
def rescue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    leaf = F.get(F.split("p_name", " "), 1)
    empty = p.select(F.col("p_name").alias("query_id"), F.array(F.get(F.split("p_name", " "), 0), F.concat(F.substring(leaf, 1, 1), F.substring(leaf, F.lit(3), F.length(leaf)))).alias("terms")).distinct()
    vocabulary = p.select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return discover.rescue(empty, vocabulary).withColumn("terms", F.array_join("terms", "|"))


@query("SELECT p_partkey AS row_ix, p_size + 0.5 AS width_in, CAST(p_size AS DOUBLE) AS height_in FROM part")
def learn_dimensions(spark, sf_dir):
    size = F.col("p_size").cast("string")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_ix"), F.concat(F.col("p_name"), F.lit(" "), size, F.lit('-1/2"W x '), size, F.lit('"H')).alias("title"))
    return discover.learn_dimensions(rows).withColumn("width_in", F.col("width_in").cast("double"))


@query("WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS site_id, o_orderkey AS run_id, o_orderdate AS started_at FROM orders) SELECT site_id, run_id, CAST(ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY started_at DESC, run_id DESC) AS INT) AS place FROM r QUALIFY place <= 10")
def ingest_status(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("site_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return discover.ingest_status(runs).select("site_id", "run_id", "place")
