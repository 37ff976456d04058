"""Queries over shopper events: rollups, reports, signals, autopilot, experiments, recommendations, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import half_up, normal_cdf
from ..operators import autopilot, catalogue, entities, events as ev, experiments as ex, history, recommend, reports, rollup, signals
from .registry import Registry
from .views import AS_OF, EVENTS_SQL, VARIANTS_SQL, as_of, impressions, shopper_events, variants

REGISTRY = Registry()
QUERIES, ORACLE, query = REGISTRY.queries, REGISTRY.oracle, REGISTRY.query
NOW = f"TIMESTAMP '{AS_OF}'"


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select([F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def parents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("sku", "parent_id")


WITH = f"WITH {EVENTS_SQL}"
SEARCH = "type IN ('search', 'zero_result')"
DAILY_QUERY = f"""daily_query AS (
  SELECT site_id, day, normalised_query, COUNT(*) FILTER ({SEARCH}) AS searches, COUNT(*) FILTER (type = 'click') AS clicks, COUNT(*) FILTER (type = 'add_to_cart') AS carts,
    COUNT(*) FILTER (type = 'purchase') AS purchases, COALESCE(SUM(revenue) FILTER (type = 'purchase'), 0.0) AS revenue, COUNT(*) FILTER (type = 'zero_result') AS zero_results,
    AVG(result_count) AS avg_results, AVG(position) FILTER (type = 'click') AS avg_click_position, COUNT(DISTINCT session_id) AS sessions, COUNT(rescue_strategy) AS rescued
  FROM shopper_events WHERE COALESCE(normalised_query, '') <> '' GROUP BY site_id, day, normalised_query)"""
TOUCHES = f"""touches AS (
  SELECT DISTINCT p.site_id, p.id AS purchase_id, p.revenue, s.normalised_query AS query, s.day FROM shopper_events p JOIN shopper_events s
    ON s.site_id = p.site_id AND s.session_id = p.session_id AND s.occurred_at <= p.occurred_at
  WHERE p.type = 'purchase' AND p.revenue IS NOT NULL AND s.{SEARCH} AND COALESCE(s.normalised_query, '') <> '')"""
PRODUCT_DAY = """product_day AS (
  SELECT COALESCE(e.site_id, i.site_id) AS site_id, COALESCE(e.day, i.day) AS day, COALESCE(e.sku, i.sku) AS sku, CAST(COALESCE(impressions, 0) AS BIGINT) AS impressions, COALESCE(clicks, 0) AS clicks,
    COALESCE(carts, 0) AS carts, COALESCE(purchases, 0) AS purchases, COALESCE(revenue, 0.0) AS revenue
  FROM (SELECT site_id, day, sku, COUNT(*) FILTER (type = 'click') AS clicks, COUNT(*) FILTER (type = 'add_to_cart') AS carts, COUNT(*) FILTER (type = 'purchase') AS purchases,
      COALESCE(SUM(revenue) FILTER (type = 'purchase'), 0.0) AS revenue FROM shopper_events WHERE sku IS NOT NULL GROUP BY site_id, day, sku) e
  FULL OUTER JOIN impressions i ON i.site_id = e.site_id AND i.day = e.day AND i.sku = e.sku)"""
FACETS = """facet_day AS (
  SELECT site_id, day, 'finish' AS field, regexp_extract(filters, '\\["([^"]*)"', 1) AS value, COUNT(*) AS applications FROM shopper_events WHERE filters IS NOT NULL GROUP BY ALL)"""


@query(f"{WITH}, {DAILY_QUERY} SELECT * REPLACE (ROUND(revenue, 4) AS revenue, ROUND(avg_results, 4) AS avg_results, ROUND(avg_click_position, 4) AS avg_click_position) FROM daily_query", day=True)
def rollup_query_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.rollup_query_day(shopper_events(spark, sf_dir)))


@query(f"{WITH}, {TOUCHES} SELECT * REPLACE (ROUND(revenue, 4) AS revenue) FROM touches", day=True)
def purchase_touches(spark, sf_dir):
    return rounded(rollup.purchase_touches(shopper_events(spark, sf_dir)))


@query(f"""{WITH}, {DAILY_QUERY}, {TOUCHES}, n AS (SELECT purchase_id, COUNT(*) AS n FROM touches GROUP BY 1),
s AS (SELECT site_id, query, day, SUM(revenue / n) AS share FROM touches JOIN n USING (purchase_id) GROUP BY 1, 2, 3)
SELECT q.site_id, q.day, q.normalised_query, q.searches, ROUND(COALESCE(s.share, q.revenue), 8) AS revenue FROM daily_query q LEFT JOIN s ON s.site_id = q.site_id AND s.query = q.normalised_query AND s.day = q.day""", day=True)
def attribute_revenue(spark, sf_dir):
    events = shopper_events(spark, sf_dir)
    out = rollup.attribute_revenue(rollup.rollup_query_day(events), rollup.purchase_touches(events))
    return rounded(out.select("site_id", "day", "normalised_query", "searches", "revenue"), 8)


@query(f"{WITH}, {PRODUCT_DAY} SELECT * REPLACE (ROUND(revenue, 4) AS revenue) FROM product_day", day=True)
def rollup_product_day(spark, sf_dir):
    return rounded(rollup.rollup_product_day(shopper_events(spark, sf_dir), impressions(spark, sf_dir)))


@query(f"{WITH}, {FACETS} SELECT * FROM facet_day", day=True)
def rollup_facet_day(spark, sf_dir):
    return rollup.rollup_facet_day(shopper_events(spark, sf_dir))


@query(f"{WITH} SELECT site_id, day, COUNT(*) AS events_seen FROM shopper_events GROUP BY 1, 2", day=True)
def rollup_runs(spark, sf_dir):
    return rollup.rollup_runs(shopper_events(spark, sf_dir))


@query(f"""{WITH}, w AS (SELECT * FROM shopper_events WHERE occurred_at BETWEEN {NOW} - INTERVAL 30 DAY AND {NOW}),
a AS (SELECT site_id, COUNT(*) FILTER ({SEARCH}) AS searches, COUNT(DISTINCT normalised_query) AS unique_queries, COUNT(*) FILTER (type = 'zero_result') AS zero_results,
  COUNT(*) FILTER ({SEARCH} AND result_count < 3) AS low_results, COUNT(*) FILTER (type = 'click') AS clicks, COUNT(*) FILTER (type = 'add_to_cart') AS carts, COUNT(*) FILTER (type = 'purchase') AS orders,
  ROUND(COALESCE(SUM(revenue) FILTER (type = 'purchase'), 0), 2) AS revenue, COUNT(DISTINCT session_id) FILTER ({SEARCH}) AS search_sessions FROM w GROUP BY site_id),
l AS (SELECT site_id, COUNT(*) AS search_orders, ROUND(SUM(revenue), 2) AS search_revenue FROM w p WHERE type = 'purchase'
  AND EXISTS (SELECT 1 FROM w s WHERE s.site_id = p.site_id AND s.session_id = p.session_id AND s.{SEARCH} AND s.occurred_at <= p.occurred_at) GROUP BY site_id)
SELECT a.*, l.search_orders, l.search_revenue, FLOOR(1000.0 * zero_results / searches + 0.5) / 10 AS zero_rate, FLOOR(1000.0 * clicks / searches + 0.5) / 10 AS ctr,
  FLOOR(1000.0 * search_orders / search_sessions + 0.5) / 10 AS conversion FROM a JOIN l USING (site_id)""")
def overview(spark, sf_dir):
    return reports.overview(shopper_events(spark, sf_dir), as_of())


@query(f"""{WITH}, {DAILY_QUERY}, l AS (SELECT DISTINCT p.site_id, p.id FROM shopper_events p JOIN shopper_events s ON s.site_id = p.site_id AND s.session_id = p.session_id AND s.occurred_at <= p.occurred_at
  WHERE p.type = 'purchase' AND s.{SEARCH}) SELECT site_id, id FROM l""")
def search_attributed_purchases(spark, sf_dir):
    return reports.search_attributed_purchases(shopper_events(spark, sf_dir)).select("site_id", "id")


QUERY_SUMS = f"""q AS (SELECT site_id, normalised_query, CAST(SUM(searches) AS BIGINT) AS searches, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(carts) AS BIGINT) AS carts, CAST(SUM(purchases) AS BIGINT) AS purchases,
  ROUND(SUM(revenue), 2) AS revenue, CAST(SUM(zero_results) AS BIGINT) AS zero_results, ROUND(AVG(avg_results), 4) AS avg_results, CAST(SUM(rescued) AS BIGINT) AS rescued
  FROM daily_query WHERE day >= CAST({NOW} - INTERVAL 30 DAY AS DATE) GROUP BY 1, 2)"""
SUGGESTION = "CASE WHEN zero_results > 0 THEN 'synonym' WHEN clicks = 0 AND searches >= 3 THEN 'review' END AS suggestion"


def daily_query(spark, sf_dir):
    return rollup.rollup_query_day(shopper_events(spark, sf_dir))


@query(f"{WITH}, {DAILY_QUERY}, {QUERY_SUMS} SELECT *, {SUGGESTION} FROM q QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY searches DESC, normalised_query) <= 25")
def top_queries(spark, sf_dir):
    return reports.top_queries(daily_query(spark, sf_dir), as_of())


@query(f"{WITH}, {DAILY_QUERY}, {QUERY_SUMS} SELECT *, {SUGGESTION} FROM q WHERE zero_results > 0 OR avg_results < 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY zero_results DESC, searches DESC, normalised_query) <= 25")
def problem_queries(spark, sf_dir):
    return reports.problem_queries(daily_query(spark, sf_dir), as_of())


@query(f"""{WITH}, {DAILY_QUERY}, t AS (SELECT site_id, normalised_query, CAST(COALESCE(SUM(searches) FILTER (day >= CAST({NOW} - INTERVAL 7 DAY AS DATE)), 0) AS BIGINT) AS current,
  CAST(COALESCE(SUM(searches) FILTER (day < CAST({NOW} - INTERVAL 7 DAY AS DATE)), 0) AS BIGINT) AS previous FROM daily_query WHERE day >= CAST({NOW} - INTERVAL 14 DAY AS DATE) GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN previous = 0 THEN 100.0 ELSE FLOOR(1000.0 * (current - previous) / previous + 0.5) / 10 END AS change FROM t WHERE current + previous >= 3)
(SELECT *, 'rising' AS direction FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY change DESC, normalised_query) <= 10)
UNION ALL (SELECT *, 'falling' AS direction FROM c WHERE change < 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY change, normalised_query) <= 10)""")
def trending(spark, sf_dir):
    return reports.trending(daily_query(spark, sf_dir), as_of())


@query(f"""{WITH} SELECT site_id, normalised_query, sku, COUNT(*) AS clicks, ROUND(AVG(position), 4) AS avg_position, COUNT(*) FILTER (type = 'add_to_cart') AS carts,
  CAST(ROW_NUMBER() OVER (PARTITION BY site_id, normalised_query ORDER BY COUNT(*) DESC, sku) AS INT) AS rank
  FROM shopper_events WHERE type IN ('click', 'add_to_cart') AND sku IS NOT NULL AND COALESCE(normalised_query, '') <> '' GROUP BY 1, 2, 3 QUALIFY rank <= 10""")
def clicked_products(spark, sf_dir):
    return reports.clicked_products(shopper_events(spark, sf_dir))


@query(f"""{WITH}, {FACETS} SELECT site_id, field, value, CAST(SUM(applications) AS BIGINT) AS applications FROM facet_day WHERE day >= CAST({NOW} - INTERVAL 30 DAY AS DATE) GROUP BY 1, 2, 3
  QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY SUM(applications) DESC, field, value) <= 20""")
def facet_usage(spark, sf_dir):
    return reports.facet_usage(rollup.rollup_facet_day(shopper_events(spark, sf_dir)), as_of())


@query(f"""{WITH}, {DAILY_QUERY} SELECT site_id, day, CAST(SUM(searches) AS BIGINT) AS searches, CAST(SUM(zero_results) AS BIGINT) AS zero_results, CAST(SUM(clicks) AS BIGINT) AS clicks, ROUND(SUM(revenue), 2) AS revenue
  FROM daily_query WHERE day >= CAST({NOW} - INTERVAL 30 DAY AS DATE) GROUP BY 1, 2""", day=True)
def timeseries(spark, sf_dir):
    return reports.timeseries(daily_query(spark, sf_dir), as_of())


@query(f"""{WITH}, {VARIANTS_SQL}, a AS (SELECT site_id, term, COUNT(*) AS searches FROM (SELECT site_id, unnest(string_split(normalised_query, ' ')) AS term FROM shopper_events WHERE {SEARCH} AND normalised_query IS NOT NULL) WHERE length(term) > 2 GROUP BY 1, 2),
b AS (SELECT site_id, term, parent_id, COUNT(*) AS clicks FROM (SELECT e.site_id, v.parent_id, unnest(string_split(e.normalised_query, ' ')) AS term FROM shopper_events e JOIN variants v USING (sku) WHERE e.type = 'click' AND e.normalised_query IS NOT NULL) WHERE length(term) > 2 GROUP BY 1, 2, 3),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, term ORDER BY clicks DESC, parent_id) AS n FROM b),
d AS (SELECT site_id, term, CAST(SUM(clicks) AS BIGINT) AS clicks, MAX(clicks) AS top_clicks, string_agg(parent_id, '|' ORDER BY n) FILTER (n <= 5) AS products FROM c GROUP BY 1, 2),
t AS (SELECT * FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY searches DESC, term) <= 25)
SELECT t.site_id, t.term, t.searches, COALESCE(clicks, 0) AS clicks, FLOOR(1000.0 * COALESCE(clicks, 0) / searches + 0.5) / 10 AS click_rate,
  ROUND(COALESCE(CAST(top_clicks AS DOUBLE) / clicks, 0), 4) AS concentration, COALESCE(products, '') AS products FROM t LEFT JOIN d USING (site_id, term)""")
def term_insights(spark, sf_dir):
    return reports.term_insights(shopper_events(spark, sf_dir), parents_of(spark, sf_dir))


@query(f"""{WITH} SELECT site_id, normalised_query, COUNT(*) AS searches FROM shopper_events WHERE type = 'search' AND result_count > 0 AND occurred_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2
  QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY COUNT(*) DESC, normalised_query) <= 200""")
def popular_queries(spark, sf_dir):
    return reports.popular_queries(shopper_events(spark, sf_dir), as_of())


def understood(spark, sf_dir):
    """Brand and category recognised in each query of the log (Q6), by the names of the catalogue."""
    docs = catalogue.variant_docs(variants(spark, sf_dir))
    categories = catalogue.category_directory(docs).select("site_id", "category_id", F.split("path", " > ").alias("path"), "products")
    values = docs.groupBy("site_id", F.lit("finish").alias("field"), F.col("finish").alias("value")).agg(F.count_distinct("parent_id").alias("products"))
    names = entities.entity_names(categories, catalogue.brand_directory(docs), values)
    log = shopper_events(spark, sf_dir).select("site_id", F.col("normalised_query").alias("query")).where("query is not null").distinct()
    read = entities.read_queries(log, catalogue.vocabulary(docs, ["title", "brand"]), names)
    return entities.understand(read).select("site_id", F.col("query").alias("normalised_query"), "brand", "category")


DIAGNOSED = """k AS (SELECT *, CASE WHEN 1.0 * zero_results / searches >= 0.5 THEN 'no_results' WHEN clicks = 0 AND NOT known THEN 'uncategorised' WHEN clicks = 0 THEN 'wrong_products'
  WHEN 1.0 * rescued / searches >= 0.5 THEN 'rescue_dependent' WHEN 1.0 * clicks / searches < 0.15 THEN 'wrong_products' END AS kind FROM r)"""


@query(f"""{WITH}, {VARIANTS_SQL}, {DAILY_QUERY}, {QUERY_SUMS}, u AS (SELECT DISTINCT title FROM variants),
r AS (SELECT q.*, u.title IS NOT NULL AS known FROM (SELECT * FROM q WHERE searches >= 5 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY searches DESC, normalised_query) <= 500) q
  LEFT JOIN u ON u.title = q.normalised_query WHERE NOT (clicks > 0 AND 1.0 * clicks / searches >= 0.15 AND zero_results = 0)), {DIAGNOSED},
s AS (SELECT site_id, normalised_query, searches, clicks, zero_results, kind, ROUND(CASE kind WHEN 'no_results' THEN 3.0 * searches WHEN 'uncategorised' THEN 2.5 * searches WHEN 'rescue_dependent' THEN 1.0 * searches
  ELSE CASE WHEN clicks = 0 THEN 2.0 * searches ELSE searches * (1 - CAST(clicks AS DOUBLE) / searches) END END, 4) AS severity FROM k WHERE kind IS NOT NULL)
SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY severity DESC, normalised_query) <= 25""")
def diagnose(spark, sf_dir):
    return reports.diagnose(daily_query(spark, sf_dir), understood(spark, sf_dir), as_of())


def product_day(spark, sf_dir):
    return rollup.rollup_product_day(shopper_events(spark, sf_dir), impressions(spark, sf_dir))


CTR = f"""c AS (SELECT site_id, sku, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks FROM product_day WHERE day >= CAST({NOW} - INTERVAL 29 DAY AS DATE) GROUP BY 1, 2)"""


@query(f"""{WITH}, {PRODUCT_DAY}, {CTR}, i AS (SELECT * FROM c WHERE impressions > 0), m AS (SELECT site_id, SUM(clicks) / CAST(SUM(impressions) AS DOUBLE) AS mean FROM i GROUP BY 1)
SELECT site_id, sku, impressions, clicks, ROUND(mean, 6) AS mean, ROUND((clicks + 50 * mean) / (impressions + 50), 6) AS ctr FROM i JOIN m USING (site_id)""")
def product_ctr(spark, sf_dir):
    return rounded(signals.product_ctr(product_day(spark, sf_dir), as_of()), 6)


PROMOTE = f"""asked AS (SELECT site_id, normalised_query, CAST(SUM(searches) AS BIGINT) AS searches FROM daily_query WHERE day >= CAST({NOW} - INTERVAL 29 DAY AS DATE) GROUP BY 1, 2 HAVING SUM(searches) >= 20),
ev AS (SELECT site_id, normalised_query, sku, COUNT(*) FILTER (type = 'click') AS clicks, AVG(position) FILTER (type = 'click') AS depth, COUNT(*) FILTER (type = 'add_to_cart') AS carts FROM shopper_events
  WHERE type IN ('click', 'add_to_cart') AND sku IS NOT NULL AND day >= CAST({NOW} - INTERVAL 29 DAY AS DATE) AND normalised_query IS NOT NULL GROUP BY 1, 2, 3 HAVING clicks >= 5 AND depth >= 4),
e40 AS (SELECT ev.*, asked.searches, v.parent_id FROM ev JOIN asked USING (site_id, normalised_query) JOIN variants v USING (sku) QUALIFY ROW_NUMBER() OVER (PARTITION BY ev.site_id ORDER BY clicks DESC, normalised_query, sku) <= 40),
e3 AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY site_id, normalised_query ORDER BY ROUND(clicks * depth, 6) DESC, sku) AS INT) AS slot FROM e40 QUALIFY slot <= 3),
promote AS (SELECT site_id, concat_ws(':', 'promote', normalised_query, parent_id) AS id, 'promote' AS kind, normalised_query AS subject, parent_id AS object, searches AS reach,
  ROUND(0.25 + LEAST(0.3, clicks / 60.0::DOUBLE) + LEAST(0.25, (depth - 3) / 20) + CASE WHEN carts > 0 THEN 0.1 ELSE 0.0 END, 4) AS confidence, slot FROM e3)"""
DEMOTE = f"""{CTR}, dm AS (SELECT site_id, SUM(clicks) / CAST(SUM(impressions) AS DOUBLE) AS mean FROM c GROUP BY 1),
demote AS (SELECT site_id, 'demote:' || sku AS id, 'demote' AS kind, sku AS subject, CAST(NULL AS VARCHAR) AS object, impressions AS reach, ROUND(1 - POW(1 - mean, impressions), 4) AS confidence
  FROM c JOIN dm USING (site_id) WHERE impressions >= @least@ AND clicks = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY impressions DESC, sku) <= 25)"""
SYNONYM = f"""qs AS (SELECT site_id, normalised_query, SUM(searches) AS searches, SUM(clicks) AS clicks, SUM(zero_results) AS zero FROM daily_query WHERE day >= CAST({NOW} - INTERVAL 29 DAY AS DATE) GROUP BY 1, 2),
dead AS (SELECT *, list_distinct(string_split(normalised_query, ' ')) AS w FROM qs WHERE searches >= @syn@ AND zero >= @zero@ * searches QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY searches DESC, normalised_query) <= 15),
live AS (SELECT *, list_distinct(string_split(normalised_query, ' ')) AS w FROM qs WHERE clicks > 0 AND zero = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY clicks DESC, normalised_query) <= 200),
pr AS (SELECT d.site_id, d.normalised_query AS subject, l.normalised_query AS object, CAST(d.searches AS BIGINT) AS reach, l.clicks, CAST(len(list_intersect(d.w, l.w)) AS DOUBLE) / GREATEST(len(d.w), len(l.w)) AS score FROM dead d JOIN live l ON l.site_id = d.site_id),
synonym AS (SELECT site_id, concat_ws(':', 'synonym', subject, object) AS id, 'synonym' AS kind, subject, object, reach, ROUND(0.3 + 0.4 * score, 4) AS confidence FROM pr WHERE score >= 0.5
  QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id, subject ORDER BY score DESC, clicks DESC, object) = 1)"""
#: The test events have few impressions of a product and few zero results of a query: thresholds of the queries here.
LEAST_SHOWN, LEAST_ASKED, ZERO_SHARE = 30, 5, 0.55
DEMOTE, SYNONYM = DEMOTE.replace("@least@", str(LEAST_SHOWN)), SYNONYM.replace("@syn@", str(LEAST_ASKED)).replace("@zero@", str(ZERO_SHARE))


@query(f"{WITH}, {VARIANTS_SQL}, {DAILY_QUERY}, {PROMOTE} SELECT * FROM promote")
def promotions(spark, sf_dir):
    return autopilot.promotions(shopper_events(spark, sf_dir), daily_query(spark, sf_dir), parents_of(spark, sf_dir), as_of())


@query(f"{WITH}, {PRODUCT_DAY}, {DEMOTE} SELECT * FROM demote")
def demotions(spark, sf_dir):
    return autopilot.demotions(product_day(spark, sf_dir), as_of(), least=LEAST_SHOWN)


@query(f"{WITH}, {DAILY_QUERY}, {SYNONYM} SELECT * FROM synonym")
def synonym_proposals(spark, sf_dir):
    return autopilot.synonym_proposals(daily_query(spark, sf_dir), as_of(), least=LEAST_ASKED, zero_share=ZERO_SHARE)


def dismissed(spark, sf_dir):
    """Refused proposals: here those of every seventh promotion's query."""
    return promotions(spark, sf_dir).where("slot = 3").select("site_id", "id")


@query(f"""{WITH}, {VARIANTS_SQL}, {DAILY_QUERY}, {PRODUCT_DAY}, {PROMOTE}, {DEMOTE}, {SYNONYM},
u AS (SELECT * EXCLUDE (slot) FROM promote WHERE slot <> 3 UNION ALL SELECT * FROM demote UNION ALL SELECT * FROM synonym)
SELECT *, ROUND(confidence * LN(1 + reach), 6) AS weight FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY weight DESC, id) <= 25""")
def proposals(spark, sf_dir):
    kinds = [promotions(spark, sf_dir), demotions(spark, sf_dir), synonym_proposals(spark, sf_dir)]
    return autopilot.proposals(kinds, dismissed(spark, sf_dir))


@query(f"""{WITH}, {VARIANTS_SQL}, {DAILY_QUERY}, {PROMOTE}, t AS (SELECT * FROM promote WHERE confidence >= 0.5 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY confidence DESC, id) <= 5)
SELECT site_id, subject AS query, object AS parent_id, CAST(ROW_NUMBER() OVER (PARTITION BY site_id, subject ORDER BY confidence DESC, id) AS INT) AS pin_slot, confidence FROM t""")
def auto_apply_candidates(spark, sf_dir):
    return autopilot.auto_apply_candidates(promotions(spark, sf_dir), least=0.5)


def running(spark):
    return spark.createDataFrame([("main", 1, 50), ("main", 2, 10)], "site_id string, experiment_id int, exposure int")


HASHED = """sess AS (SELECT DISTINCT site_id, session_id FROM shopper_events), x AS (SELECT 1 AS experiment_id, 50 AS exposure UNION ALL SELECT 2, 10),
h0 AS (SELECT *, list_transform(string_split(experiment_id || ':' || session_id, ''), lambda c: CAST(ascii(c) AS BIGINT)) AS cs FROM sess, x),
h1 AS (SELECT *, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), cs), lambda s, c: CAST((CAST(xor(s, c) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT)) AS h FROM h0),
h2 AS (SELECT * REPLACE (CAST((CAST(xor(h, h >> 16) AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS h) FROM h1),
h3 AS (SELECT * REPLACE (CAST((CAST(xor(h, h >> 13) AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS h) FROM h2),
arms AS (SELECT site_id, session_id, CAST(experiment_id AS INT) AS experiment_id, xor(h, h >> 16) % 100 AS bucket, CASE WHEN xor(h, h >> 16) % 100 < exposure THEN 'treatment' ELSE 'control' END AS arm FROM h3)"""


def arms(spark, sf_dir):
    return ex.assign_arms(shopper_events(spark, sf_dir).select("site_id", "session_id").distinct(), running(spark))


@query(f"{WITH}, {HASHED} SELECT * FROM arms")
def assign_arms(spark, sf_dir):
    return arms(spark, sf_dir)


ARM_STATS = f"""st AS (SELECT e.site_id, experiment_id, arm, COUNT(DISTINCT e.session_id) AS sessions, COUNT(*) FILTER ({SEARCH}) AS searches, COUNT(DISTINCT e.session_id) FILTER (type = 'click') AS clicked,
  COUNT(DISTINCT e.session_id) FILTER (type = 'add_to_cart') AS carted, COUNT(DISTINCT e.session_id) FILTER (type = 'purchase') AS bought, ROUND(COALESCE(SUM(revenue), 0), 2) AS revenue, MIN(occurred_at) AS started, MAX(occurred_at) AS ended
  FROM shopper_events e JOIN arms a ON a.site_id = e.site_id AND a.session_id = e.session_id GROUP BY 1, 2, 3)"""


@query(f"{WITH}, {HASHED}, {ARM_STATS} SELECT * FROM st")
def arm_stats(spark, sf_dir):
    return ex.arm_stats(shopper_events(spark, sf_dir), arms(spark, sf_dir))


CDF = "(1 - 0.3989422804014327 * EXP(-z * z / 2) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))))"


@query(f"""{WITH}, {HASHED}, {ARM_STATS}, p AS (SELECT site_id, experiment_id, CAST(COALESCE(MAX(sessions) FILTER (arm = 'control'), 0) AS DOUBLE) AS n1, CAST(COALESCE(MAX(carted) FILTER (arm = 'control'), 0) AS DOUBLE) AS k1,
  CAST(COALESCE(MAX(sessions) FILTER (arm = 'treatment'), 0) AS DOUBLE) AS n2, CAST(COALESCE(MAX(carted) FILTER (arm = 'treatment'), 0) AS DOUBLE) AS k2 FROM st GROUP BY 1, 2),
r AS (SELECT *, COALESCE(k1 / NULLIF(n1, 0), 0) AS p1, COALESCE(k2 / NULLIF(n2, 0), 0) AS p2, (k1 + k2) / (n1 + n2) AS pooled FROM p),
z AS (SELECT *, ABS(COALESCE((p2 - p1) / NULLIF(SQRT(pooled * (1 - pooled) * (1 / n1 + 1 / n2)), 0), 0)) AS z FROM r), t AS (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM z), c AS (SELECT *, 2 * {CDF} - 1 AS conf FROM t)
SELECT site_id, experiment_id, CAST(n1 AS BIGINT) AS control_sessions, CAST(n2 AS BIGINT) AS treatment_sessions, ROUND(p1, 6) AS control_rate, ROUND(p2, 6) AS treatment_rate,
  CASE WHEN p1 > 0 THEN ROUND(100 * (p2 - p1) / p1, 4) END AS lift, ROUND(conf, 6) AS confidence,
  CASE WHEN p1 <> p2 THEN CAST(CEIL(CAST(2.8 AS DOUBLE) * 2.8 * 2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2) / ((p2 - p1) * (p2 - p1))) AS BIGINT) END AS sessions_needed,
  CASE WHEN n1 < 100 OR n2 < 100 THEN 'not_enough_data' WHEN conf < 0.95 THEN 'no_difference' WHEN p2 > p1 THEN 'treatment_wins' ELSE 'control_wins' END AS verdict FROM c""")
def experiment_results(spark, sf_dir):
    return ex.experiment_results(ex.arm_stats(shopper_events(spark, sf_dir), arms(spark, sf_dir)))


#: Shopper events with their product.
PRODUCT_EVENTS = "pe AS (SELECT e.*, v.parent_id FROM shopper_events e LEFT JOIN (SELECT sku, parent_id FROM variants) v USING (sku))"
TOGETHER = """ac AS (SELECT site_id, session_id, parent_id, MAX(occurred_at) AS last FROM pe WHERE type IN ('purchase', 'add_to_cart') AND parent_id IS NOT NULL GROUP BY 1, 2, 3)"""


def product_events(spark, sf_dir):
    return shopper_events(spark, sf_dir).join(parents_of(spark, sf_dir).select("sku", "parent_id"), "sku", "left")


@query(f"""{WITH}, {VARIANTS_SQL}, {PRODUCT_EVENTS}, {TOGETHER}
SELECT x.site_id, x.parent_id AS anchor, y.parent_id, COUNT(*) AS sessions, CAST(ROW_NUMBER() OVER (PARTITION BY x.site_id, x.parent_id ORDER BY COUNT(*) DESC, y.parent_id) AS INT) AS rank
FROM ac x JOIN ac y ON x.site_id = y.site_id AND x.session_id = y.session_id AND x.parent_id <> y.parent_id
WHERE x.last >= {NOW} - INTERVAL 90 DAY GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2 QUALIFY rank <= 8""")
def bought_together(spark, sf_dir):
    return recommend.bought_together(product_events(spark, sf_dir), as_of())


@query(f"""{WITH}, {VARIANTS_SQL} SELECT e.site_id, shopper_id, parent_id, MAX(occurred_at) AS last_seen, CAST(ROW_NUMBER() OVER (PARTITION BY e.site_id, shopper_id ORDER BY MAX(occurred_at) DESC, parent_id) AS INT) AS rank
FROM shopper_events e JOIN variants v USING (sku) WHERE type IN ('product_view', 'click') AND occurred_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2, 3 QUALIFY rank <= 8""")
def recently_viewed(spark, sf_dir):
    return recommend.recently_viewed(shopper_events(spark, sf_dir), parents_of(spark, sf_dir), as_of())


@query(f"""{WITH}, {VARIANTS_SQL}, s AS (SELECT e.site_id, shopper_id, parent_id, MAX(occurred_at) AS last_seen FROM shopper_events e JOIN variants v USING (sku) WHERE type IN ('product_view', 'click') AND occurred_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2, 3),
a AS (SELECT site_id, shopper_id, MIN(parent_id) AS anchor FROM shopper_events JOIN (SELECT sku, parent_id FROM variants) USING (sku) WHERE type = 'click' GROUP BY 1, 2)
SELECT site_id, shopper_id, anchor, parent_id, last_seen, CAST(ROW_NUMBER() OVER (PARTITION BY site_id, shopper_id ORDER BY last_seen DESC, parent_id) AS INT) AS rank FROM s JOIN a USING (site_id, shopper_id) WHERE parent_id <> anchor QUALIFY rank <= 8""")
def viewed_beside(spark, sf_dir):
    events, parents = shopper_events(spark, sf_dir), parents_of(spark, sf_dir)
    anchors = events.where("type = 'click'").join(parents.select("sku", "parent_id"), "sku").groupBy("site_id", "shopper_id").agg(F.min("parent_id").alias("anchor"))
    return recommend.viewed_beside(anchors, recommend.recently_viewed(events, parents, as_of(), limit=9))


@query(f"""{WITH}, {VARIANTS_SQL}, {PRODUCT_EVENTS} SELECT site_id, parent_id, COUNT(*) AS clicks, CAST(ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY COUNT(*) DESC, parent_id) AS INT) AS rank FROM pe
WHERE type = 'click' AND parent_id IS NOT NULL AND occurred_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1, 2 QUALIFY rank <= 8""")
def trending_products(spark, sf_dir):
    return recommend.trending_products(product_events(spark, sf_dir), as_of())


@query(f"WITH {VARIANTS_SQL} SELECT site_id, parent_id, MAX(sales_velocity) AS velocity, CAST(ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY MAX(sales_velocity) DESC, parent_id) AS INT) AS rank FROM variants GROUP BY 1, 2 QUALIFY rank <= 8")
def top_sellers(spark, sf_dir):
    return recommend.top_sellers(variants(spark, sf_dir))


@query(f"""{WITH}, {VARIANTS_SQL}, {PRODUCT_EVENTS}, {TOGETHER},
f AS (SELECT x.site_id, x.parent_id AS anchor, y.parent_id AS item, CAST(ROW_NUMBER() OVER (PARTITION BY x.site_id, x.parent_id ORDER BY COUNT(*) DESC, y.parent_id) AS INT) AS rank FROM ac x JOIN ac y ON x.site_id = y.site_id AND x.session_id = y.session_id AND x.parent_id <> y.parent_id WHERE x.last >= {NOW} - INTERVAL 90 DAY GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2 QUALIFY rank <= 8),
p AS (SELECT site_id, parent_id, MAX(sales_velocity) AS velocity FROM variants GROUP BY 1, 2),
s AS (SELECT site_id, parent_id AS item, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY velocity DESC, parent_id) AS r FROM p QUALIFY r <= 9),
e AS (SELECT p.site_id, p.parent_id AS anchor, s.item, CAST(ROW_NUMBER() OVER (PARTITION BY p.site_id, p.parent_id ORDER BY r) AS INT) AS rank FROM p JOIN s ON s.site_id = p.site_id AND s.item <> p.parent_id WHERE p.parent_id NOT IN (SELECT anchor FROM f) QUALIFY rank <= 8)
SELECT *, 'strategy' AS served_by FROM f UNION ALL SELECT *, 'top_sellers' FROM e""")
def recommend_with_fallback(spark, sf_dir):
    docs = variants(spark, sf_dir)
    found = recommend.bought_together(product_events(spark, sf_dir), as_of()).withColumnRenamed("parent_id", "item")
    sellers = recommend.top_sellers(docs, 9).withColumnRenamed("parent_id", "item")
    return recommend.with_fallback(docs.select("site_id", F.col("parent_id").alias("anchor")).distinct(), found, sellers)


@query("SELECT user_id, event_id, CAST(SUM(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM (SELECT *, CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS f FROM events)")
def sessionise(spark, sf_dir):
    from .views import table

    return ev.sessionise(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "event_id", "session_no")


@query("""SELECT event_id, CASE WHEN t NOT IN ('search', 'click', 'purchase') THEN 'unknown type' WHEN s = '' THEN 'no session' WHEN t = 'click' AND p < 1 THEN 'bad position' END AS reason
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'search' ELSE event_type END AS t, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'x' END AS s, event_id % 7 AS p FROM events)""")
def validate_events(spark, sf_dir):
    from .views import table

    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "search").otherwise(F.col("event_type")).alias("type"), F.lit("main").alias("site_id"), F.lit("u").alias("shopper_id"), F.when(F.col("event_id") % 11 == 0, "").otherwise("x").alias("session_id"), (F.col("event_id") % 7).alias("position"))
    return ev.with_reject_reason(raw).select("event_id", "reason")


@query(f"{WITH} SELECT site_id, day, sku, CAST(SUM(impressions) AS BIGINT) AS impressions FROM (SELECT * FROM impressions UNION ALL SELECT site_id, day, sku, 1 FROM shopper_events WHERE type = 'click' AND sku IS NOT NULL) GROUP BY 1, 2, 3", day=True)
def add_impressions(spark, sf_dir):
    return ev.add_impressions(impressions(spark, sf_dir), shopper_events(spark, sf_dir).where("type = 'click' and sku is not null"))


@query(f"{WITH} SELECT site_id, day, 'finish' AS field, regexp_extract(filters, '\\[\"([^\"]*)\"', 1) AS value FROM shopper_events WHERE filters IS NOT NULL", day=True)
def explode_event_filters(spark, sf_dir):
    return rollup.explode_event_filters(shopper_events(spark, sf_dir))


def audit_log(spark, sf_dir):
    """Changes of orders as an audit log: priority before, status after."""
    from .views import table

    doc = lambda *kv: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":"'), F.trim(v), F.lit('"')) for k, v in kv]), F.lit("}"))
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    entity = F.when(key % 4 == 0, "collection").when(key % 4 == 1, "badge").when(key % 4 == 2, "experiment").otherwise("synonym")
    return o.select(key.alias("audit_id"), entity.alias("entity"), F.col("o_custkey").alias("entity_id"), F.when(key % 7 == 0, "revert").when(key % 5 == 0, "create").otherwise("update").alias("action"),
                    F.when(key % 5 != 0, doc(("status", F.lit("O")), ("priority", F.col("o_orderpriority")), ("updatedAt", F.lit("1")))).alias("before"), doc(("status", F.col("o_orderstatus")), ("priority", F.lit("5-LOW"))).alias("after"))


AUDIT = """au AS (SELECT o_orderkey AS audit_id, CASE o_orderkey % 4 WHEN 0 THEN 'collection' WHEN 1 THEN 'badge' WHEN 2 THEN 'experiment' ELSE 'synonym' END AS entity, o_custkey AS entity_id, CASE WHEN o_orderkey % 7 = 0 THEN 'revert' WHEN o_orderkey % 5 = 0 THEN 'create' ELSE 'update' END AS action,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'O' END AS s0, CASE WHEN o_orderkey % 5 <> 0 THEN trim(o_orderpriority) END AS p0, trim(o_orderstatus) AS s1, '5-LOW' AS p1 FROM orders)"""


@query(f"""WITH {AUDIT} SELECT audit_id, entity <> 'experiment' AS revertible, CASE WHEN entity = 'experiment' THEN 'not of a kind that can be put back' END AS refused,
  concat_ws(';', CASE WHEN p0 IS DISTINCT FROM p1 THEN 'priority:' || coalesce(p0, '') || '>' || p1 END, CASE WHEN s0 IS DISTINCT FROM s1 THEN 'status:' || coalesce(s0, '') || '>' || s1 END) AS changes FROM au""")
def audit_diff(spark, sf_dir):
    rows = history.audit_diff(audit_log(spark, sf_dir))
    text = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), F.coalesce(c["before"], F.lit("")), F.lit(">"), F.coalesce(c["after"], F.lit("")))), ";")
    return rows.select("audit_id", "revertible", "refused", text.alias("changes"))


@query("""SELECT CASE WHEN o_custkey % 3 = 0 THEN 'trade' ELSE 'main' END AS site_id, o_orderkey AS audit_id, o_orderkey % 4 <> 2 AS revertible, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey % 3 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS place FROM orders QUALIFY place <= 500""")
def newest_changes(spark, sf_dir):
    from .views import table

    when = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_orderdate").alias("created_at"))
    audit = audit_log(spark, sf_dir).join(when, "audit_id").withColumn("site_id", F.when(F.col("entity_id") % 3 == 0, "trade").otherwise("main"))
    return history.newest_changes(audit).select("site_id", "audit_id", "revertible", "place")


@query(f"""WITH {AUDIT} SELECT audit_id AS reverts, entity, entity_id, 'revert' AS action, CASE WHEN s0 IS NULL THEN 'removed' ELSE 'restored' END AS outcome, entity IN ('collection', 'badge') AS reindex_required
FROM au WHERE entity <> 'experiment'""")
def inverse_changes(spark, sf_dir):
    audit = audit_log(spark, sf_dir)
    return history.inverse_changes(audit, audit.select("audit_id")).drop("before", "after")


@query("SELECT o_orderkey, FLOOR(o_totalprice * 10 + 0.5) / 10 AS tenths, ROUND(CASE WHEN z >= 0 THEN p ELSE 1 - p END, 6) AS cdf FROM (SELECT *, 1 - 0.3989422804014327 * EXP(-z * z / 2) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS p FROM (SELECT *, 1 / (1 + 0.2316419 * ABS(z)) AS t FROM (SELECT *, CAST(o_orderkey % 9 - 4 AS DOUBLE) / 2 AS z FROM orders)))")
def scoring_functions(spark, sf_dir):
    from .views import table

    z = (F.col("o_orderkey") % 9 - 4) / 2
    return table(spark, sf_dir, "orders").select("o_orderkey", half_up(F.col("o_totalprice"), 1).alias("tenths"), F.round(normal_cdf(z), 6).alias("cdf"))
