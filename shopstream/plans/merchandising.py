"""Queries over feeds, rules, labels, query analysis and judged relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measure, text
from ..operators import analyse, catalogue, facets, learn, relevance, retrieve, rules, selectors
from ..sources import feed
from .registry import Registry
from .search import CARDS_SQL, DOCS_SQL, HITS_SQL, RANKED_SQL, docs, prepared, query_totals, search
from .views import EVENTS_SQL, VARIANTS_SQL, shopper_events, table, variants

REGISTRY = Registry()
QUERIES, ORACLE, query = REGISTRY.queries, REGISTRY.oracle, REGISTRY.query


def raw_feed(spark, sf_dir):
    """part as a messy feed of texts: missing titles and prices, a duplicate SKU for every seventeenth part, money with signs."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        key.alias("row_ix"),
        F.concat(F.lit(" P"), F.when(key % 17 == 0, F.greatest(key - 1, F.lit(0))).otherwise(key).cast("string")).alias("Item Name/Number"),
        F.when(key % 19 == 0, "").otherwise(F.col("p_name")).alias("Display Name"),
        F.concat_ws("/", "p_name", "p_type").alias("Parent Item"),
        F.col("p_brand").alias("Manufacturer"),
        F.concat_ws(" > ", "p_type", F.get(F.split("p_name", " "), 1)).alias("Commerce Category"),
        F.when(key % 23 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))).alias("Base Price"),
        F.when(key % 13 == 0, "").otherwise(F.concat_ws(" ", F.lit("Fine"), "p_name", F.lit("for every house"))).alias("Sales Description"),
        F.when(key % 3 == 0, "").otherwise(F.get(F.split("p_name", " "), 0)).alias("Custom Item Field: Finish"),
        F.concat(F.col("p_size").cast("string"), F.lit(" 1/2 in")).alias("Custom Item Field: Width"),
        F.lit("x.png").alias("Image URL"),
    )


FEED_SQL = """raw AS (SELECT p_partkey AS row_ix, 'P' || CASE WHEN p_partkey % 17 = 0 THEN greatest(p_partkey - 1, 0) ELSE p_partkey END AS sku, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS title, p_name || '/' || p_type AS parent_id,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS DOUBLE) END AS price, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'Fine ' || p_name || ' for every house' END AS description,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE split_part(p_name, ' ', 1) END AS finish, p_size + 0.5 AS width_in, p_type AS category, split_part(p_name, ' ', 2) AS leaf FROM part),
marked AS (SELECT *, CASE WHEN row_ix > MIN(row_ix) OVER (PARTITION BY sku) THEN 'duplicate SKU' WHEN title = '' THEN 'no title' END AS reason FROM raw)"""


def mapped(spark, sf_dir):
    rows = raw_feed(spark, sf_dir)
    return feed.map_feed(rows, feed.infer_mapping([c for c in rows.columns if c != "row_ix"]))


@query(f"WITH {FEED_SQL} SELECT row_ix, sku, parent_id, title, price, CASE WHEN finish = '' THEN NULL ELSE finish END AS finish, CAST(width_in AS DOUBLE) AS width_in, category || '|' || leaf AS path FROM raw")
def map_feed(spark, sf_dir):
    return mapped(spark, sf_dir).select("row_ix", "sku", "parent_id", "title", "price", F.try_element_at("attrs", F.lit("finish")).alias("finish"), F.try_element_at("attrs_in", F.lit("width_in")).alias("width_in"), F.array_join("categoryPath", "|").alias("path"))


@query(f"WITH {FEED_SQL} SELECT row_ix + 2 AS row, sku, reason FROM marked WHERE reason IS NOT NULL")
def feed_rejects(spark, sf_dir):
    return feed.normalise_feed(mapped(spark, sf_dir))[1]


@query(f"WITH {FEED_SQL} SELECT sku, parent_id, title, COALESCE(price, 0.0) AS price, price IS NULL AS missing_price FROM marked WHERE reason IS NULL")
def normalise_feed(spark, sf_dir):
    return feed.normalise_feed(mapped(spark, sf_dir))[0].select("sku", "parent_id", "title", "price", "missing_price")


@query(f"""WITH {FEED_SQL}, ok AS (SELECT * FROM marked WHERE reason IS NULL) SELECT 'emptyDescriptions' AS "check", parent_id AS key FROM ok GROUP BY parent_id HAVING MAX(length(trim(description))) < 20
UNION ALL SELECT 'missingPrice', sku FROM ok WHERE price IS NULL UNION ALL SELECT 'duplicateSkus', sku FROM marked WHERE reason = 'duplicate SKU' UNION ALL SELECT 'rejected', CAST(row_ix + 2 AS VARCHAR) FROM marked WHERE reason IS NOT NULL""")
def quality_report(spark, sf_dir):
    return feed.quality_report(*feed.normalise_feed(mapped(spark, sf_dir)))


def feed_rows(spark, sf_dir):
    return mapped(spark, sf_dir).select("row_ix", F.get("categoryPath", 0).alias("category"), "attrs", "description", "title")


@query(f"""WITH {FEED_SQL}, v AS (SELECT category, lower(finish) AS value FROM raw WHERE finish <> '' AND length(finish) >= 3) SELECT scope, 'finish' AS key, value, COUNT(*) AS n FROM (SELECT category AS scope, value FROM v UNION ALL SELECT '*', value FROM v) GROUP BY 1, 2, 3""")
def stated_values(spark, sf_dir):
    return learn.stated_values(feed_rows(spark, sf_dir)).where("key = 'finish'")


@query(f"""WITH {FEED_SQL}, v AS (SELECT DISTINCT category, lower(finish) AS value FROM raw WHERE finish <> '' AND length(finish) >= 3)
SELECT row_ix, 'finish' AS key, MIN(v.value) AS value, 'filled' AS outcome FROM raw JOIN v USING (category) WHERE raw.finish = '' AND contains(' ' || lower(title) || ' ', ' ' || v.value || ' ') GROUP BY row_ix HAVING COUNT(*) = 1""")
def fill_blanks(spark, sf_dir):
    rows = feed_rows(spark, sf_dir)
    return learn.fill_blanks(rows, learn.stated_values(rows), F.col("title"), ["finish"])


TREE = {"all": [{"field": "brand", "op": "in", "value": ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"]}, {"any": [{"field": "variant.price", "op": "lt", "value": 1200}, {"field": "minPrice", "op": "gte", "value": "$1,500"}]}],
        "none": [{"field": "category_path", "op": "equals", "value": " PROMO "}, {"field": "title", "op": "starts_with", "value": "red"}]}
PRODUCTS_SQL = f"""{VARIANTS_SQL}, prod AS (SELECT site_id, parent_id, arg_min(brand, sku) AS brand, arg_min(title, sku) AS title, arg_min(category_top, sku) AS top, arg_min(category_leaf, sku) AS leaf, MIN(price) AS least_price,
  MIN(CASE WHEN sale_price > 0 THEN sale_price ELSE price END) AS min_price, MAX(inventory) AS most, COUNT(*) AS n, list(sku ORDER BY sku) AS skus FROM variants GROUP BY 1, 2)"""
TREE_SQL = "brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') AND (least_price < 1200 OR min_price >= 1500) AND NOT (lower(top) = 'promo' OR lower(leaf) = 'promo' OR starts_with(lower(title), 'red'))"


@query(f"WITH {PRODUCTS_SQL} SELECT site_id, parent_id, brand, title, n AS n_variants, array_to_string(skus, '|') AS skus FROM prod")
def group_variants(spark, sf_dir):
    return selectors.products(variants(spark, sf_dir)).select("site_id", "parent_id", "brand", "title", F.size("variants").cast("long").alias("n_variants"), F.array_join("variants.sku", "|").alias("skus"))


@query(f"WITH {PRODUCTS_SQL} SELECT parent_id FROM prod WHERE {TREE_SQL}")
def compile_selector(spark, sf_dir):
    return selectors.products(variants(spark, sf_dir)).where(selectors.compile_selector(TREE)).select("parent_id")


LABELS = [
    {"label": "collection:cheap", "selector": {"all": [{"field": "variant.price", "op": "lt", "value": 1000}]}, "exclude": ["red bolt/ECONOMY"]},
    {"label": "badge:sale", "selector": {"all": [{"field": "onSale", "op": "equals", "value": True}]}},
    {"label": "badge:red", "selector": {"all": [{"field": "title", "op": "starts_with", "value": "red"}]}},
    {"label": "badge:pick", "selector": {}, "include": ["blue gear/PROMO", "red bolt/ECONOMY"]},
]
LABELS_SQL = f"""{VARIANTS_SQL}, lab AS (SELECT sku, parent_id, 'collection:cheap' AS label FROM variants WHERE price < 1000 AND parent_id <> 'red bolt/ECONOMY' UNION ALL SELECT sku, parent_id, 'badge:sale' FROM variants WHERE sale_price > 0 AND sale_price < price
  UNION ALL SELECT sku, parent_id, 'badge:red' FROM variants WHERE starts_with(title, 'red') UNION ALL SELECT sku, parent_id, 'badge:pick' FROM variants WHERE parent_id IN ('blue gear/PROMO', 'red bolt/ECONOMY'))"""


def labelled(spark, sf_dir):
    return selectors.apply_labels(selectors.products(variants(spark, sf_dir)), LABELS)


@query(f"WITH {LABELS_SQL} SELECT 'main' AS site_id, sku, parent_id, label FROM lab")
def apply_labels(spark, sf_dir):
    return labelled(spark, sf_dir)


@query(f"WITH {LABELS_SQL} SELECT split_part(label, ':', 1) AS label_key, split_part(label, ':', 2) AS value, COUNT(DISTINCT parent_id) AS products FROM lab GROUP BY 1, 2")
def label_counts(spark, sf_dir):
    return facets.label_counts(labelled(spark, sf_dir).select("parent_id", F.array("label").alias("labels")))


@query(f"WITH {LABELS_SQL}, b AS (SELECT 'sale' AS badge, 2 AS p UNION ALL SELECT 'red', 1 UNION ALL SELECT 'pick', 3) SELECT sku, badge, CAST(ROW_NUMBER() OVER (PARTITION BY sku ORDER BY p, badge) AS INT) AS place FROM lab JOIN b ON label = 'badge:' || badge QUALIFY place <= 2")
def add_badges(spark, sf_dir):
    badges = spark.createDataFrame([("sale", 2, True), ("red", 1, True), ("pick", 3, True), ("off", 0, False)], "slug string, priority int, enabled boolean")
    return rules.add_badges(labelled(spark, sf_dir), badges)


SITES = ["main", "trade"]


def query_log(spark, sf_dir):
    """The shoppers' queries, asked at both sites."""
    sites = F.explode(F.array(*[F.lit(s) for s in SITES])).alias("site_id")
    return shopper_events(spark, sf_dir).where("normalised_query is not null").select(sites, F.col("normalised_query").alias("query"))


LOG_SQL = f"{EVENTS_SQL}, q AS (SELECT DISTINCT s.site_id, normalised_query AS query FROM shopper_events, (VALUES ('main'), ('trade')) s(site_id) WHERE normalised_query IS NOT NULL)"


@query(f"""WITH {LOG_SQL}, r AS (SELECT * FROM (VALUES ('main', 1, 'exact', 'red bolt', '/red', 5), ('main', 2, 'starts_with', 'blue', '/blue', 3), ('main', 3, 'contains', 'widget', '/w', 4), ('main', 4, 'regex', '^(cold|hot) g', '/g', 3), ('main', 5, 'starts_with', 'blue g', '/bg', 3),
  ('trade', 1, 'contains', 'd b', '/boards', 2), ('trade', 2, 'exact', 'red gear', '/gear', 7), ('trade', 3, 'starts_with', '', '/all', 0), ('trade', 4, 'contains', 'idge', '/idge', 2)) t(site_id, rule_id, kind, pattern, target, priority))
SELECT q.site_id, query, rule_id, target FROM q JOIN r ON q.site_id = r.site_id AND CASE kind WHEN 'exact' THEN query = pattern WHEN 'starts_with' THEN starts_with(query, pattern) WHEN 'contains' THEN contains(query, pattern) ELSE regexp_matches(query, pattern) END QUALIFY ROW_NUMBER() OVER (PARTITION BY q.site_id, query ORDER BY priority DESC, rule_id) = 1""")
def match_redirects(spark, sf_dir):
    table_ = [("main", 1, "exact", "Red  Bolt", "/red", 5, True), ("main", 2, "starts_with", "blue", "/blue", 3, True), ("main", 3, "contains", "widget", "/w", 4, True), ("main", 4, "regex", "^(cold|hot) g", "/g", 3, True), ("main", 5, "starts_with", "blue g", "/bg", 3, True), ("main", 6, "contains", "e", "/off", 9, False),
              ("trade", 1, "contains", "d b", "/boards", 2, True), ("trade", 2, "exact", "red gear", "/gear", 7, True), ("trade", 3, "starts_with", " ", "/all", 0, True), ("trade", 4, "contains", "idge", "/idge", 2, True), ("trade", 5, "regex", "(red", "/broken", 9, True)]
    return rules.match_redirects(query_log(spark, sf_dir), spark.createDataFrame(table_, "site_id string, rule_id int, kind string, pattern string, target string, priority int, enabled boolean"), ["site_id"])


TRIGGERS = [("main", 1, "exact", "red bolt", 1), ("main", 2, "phrase", "bolt", 1), ("main", 3, "contains", "ol", 1), ("main", 4, "contains", "gear", 2), ("main", 5, "phrase", "red", 1), ("trade", 1, "phrase", "blue gear", 3), ("trade", 2, "phrase", "ear", 9), ("trade", 3, "contains", "ear", 1)]
TRIGGERS_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(str(t) for t in TRIGGERS) + ") t(site_id, rule_id, m, trigger, priority))"
FIRED_SQL = "CASE m WHEN 'exact' THEN query = trigger WHEN 'phrase' THEN contains(' ' || query || ' ', ' ' || trigger || ' ') ELSE contains(query, trigger) END"
FIRST_SQL = "priority DESC, CASE m WHEN 'exact' THEN 0 WHEN 'phrase' THEN 1 ELSE 2 END, length(trigger) DESC, rule_id"


@query(f"WITH {LOG_SQL}, {TRIGGERS_SQL} SELECT q.site_id, query, rule_id FROM q JOIN r ON q.site_id = r.site_id AND {FIRED_SQL} QUALIFY ROW_NUMBER() OVER (PARTITION BY q.site_id, query ORDER BY {FIRST_SQL}) = 1")
def match_query_rules(spark, sf_dir):
    return rules.match_query_rules(query_log(spark, sf_dir), spark.createDataFrame(TRIGGERS, "site_id string, rule_id int, match string, trigger string, priority int"), ["site_id"])


@query(f"""WITH {TRIGGERS_SQL}, q AS (SELECT s.site_id, p_partkey AS k, CASE WHEN p_partkey % 3 = 1 THEN '' ELSE p_name END AS query, CASE WHEN p_partkey % 5 <> 0 THEN lower(p_type) END AS category_id FROM part, (VALUES ('main'), ('trade')) s(site_id)),
w AS (SELECT q.site_id, k, rule_id FROM q JOIN r ON q.site_id = r.site_id AND query <> '' AND {FIRED_SQL} QUALIFY ROW_NUMBER() OVER (PARTITION BY q.site_id, k ORDER BY {FIRST_SQL}) = 1),
c AS (SELECT * FROM (VALUES ('main', 'promo', 22), ('trade', 'promo', 21), ('trade', 'economy', 23)) t(site_id, category_id, of_category))
SELECT q.site_id || '|' || k AS request_id, COALESCE(rule_id, of_category) AS rule_id, rule_id IS NULL AS from_category FROM q LEFT JOIN w USING (site_id, k) LEFT JOIN c USING (site_id, category_id) WHERE COALESCE(rule_id, of_category) IS NOT NULL""")
def rule_of_request(spark, sf_dir):
    kinds = "site_id string, rule_id int, match string, trigger string, priority int, category_id string"
    of_categories = [("main", 21, None, None, 1, "promo"), ("main", 22, None, None, 5, "promo"), ("trade", 21, None, None, 1, "promo"), ("trade", 22, None, None, 1, "promo"), ("trade", 23, None, None, 0, "economy")]
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    asked = p.select(F.explode(F.array(*[F.lit(s) for s in SITES])).alias("site_id"), key, F.when(key % 3 == 1, "").otherwise(F.col("p_name")).alias("query"), F.when(key % 5 != 0, F.lower("p_type")).alias("category_id"))
    asked = asked.withColumn("request_id", F.concat_ws("|", "site_id", key.cast("string")))
    return rules.rule_of_request(asked, spark.createDataFrame([(*t, None) for t in TRIGGERS] + of_categories, kinds), ["site_id"])


@query("""WITH q AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT p_name AS query_id, CASE WHEN p_name = 'red bolt' THEN 'red|bolt|crimson|fastener' WHEN b = 'bolt' THEN a || '|bolt|screw|pin' WHEN a = 'blue' THEN 'blue|' || b || '|azure' ELSE a || '|' || b END AS terms,
CASE WHEN p_name = 'red bolt' THEN '1' WHEN a = 'blue' AND b = 'bolt' THEN '3|2' WHEN b = 'bolt' THEN '2' WHEN a = 'blue' THEN '3' ELSE '' END AS rule_ids FROM q WHERE p_name <> 'blue bolt' UNION ALL SELECT p_name, 'blue|bolt|azure|screw|pin', '3|2' FROM q WHERE p_name = 'blue bolt'""")
def expand_synonyms(spark, sf_dir):
    table_ = [(1, "Red Bolts", ["crimson fastener"]), (2, "bolt", ["screw", "pin"]), (3, "blue", ["azure", "blue"])]
    log = table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), text.tokenise(F.col("p_name")).alias("terms")).distinct()
    out = rules.expand_synonyms(log, spark.createDataFrame(table_, "rule_id int, trigger string, alternatives array<string>"))
    return out.select("query_id", F.array_join("terms", "|").alias("terms"), F.array_join(F.transform("rule_ids", lambda r: r.cast("string")), "|").alias("rule_ids"))


@query(f"""WITH {RANKED_SQL}, {CARDS_SQL}, a AS (SELECT query_id, parent_id, CASE WHEN card = 1 THEN 'hide' WHEN card = 2 THEN 'bury' WHEN card = 6 THEN 'pin' END AS action FROM cards WHERE card IN (1, 2, 6)),
k AS (SELECT c.query_id, c.parent_id, c.card, a.action FROM cards c LEFT JOIN a USING (query_id, parent_id) WHERE a.action IS DISTINCT FROM 'hide')
SELECT query_id, parent_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY CASE WHEN action = 'pin' THEN 0 WHEN action = 'bury' THEN 2 ELSE 1 END, card) AS INT) AS card, COALESCE(action = 'pin', FALSE) AS pinned FROM k""")
def apply_query_rule(spark, sf_dir):
    from ..operators import rank
    from .search import ranked

    cards = rank.group_by_parent(ranked(spark, sf_dir)).select("query_id", "parent_id", "card").persist()
    action = F.when(F.col("card") == 1, "hide").when(F.col("card") == 2, "bury").when(F.col("card") == 6, "pin")
    actions = cards.select("query_id", "parent_id", action.alias("action"), F.lit(1).alias("slot")).where("action is not null")
    return rules.apply_query_rule(cards, actions, docs(spark, sf_dir))


def titled(docs_):
    """docs with a title of finish and size."""
    return docs_.select("site_id", "sku", "brand", F.concat_ws(" / ", "finish", F.concat(F.col("size_in").cast("int").cast("string"), F.lit(" in"))).alias("variant_title"))


SIZE_SQL = "CAST(CAST(size_in AS INT) AS VARCHAR) || ' in'"


@query(f"""WITH {EVENTS_SQL}, {VARIANTS_SQL}, c AS (SELECT e.site_id, session_id, occurred_at, sku, unnest([finish, {SIZE_SQL}, brand]) AS word, unnest([0, 1, 2]) AS i FROM shopper_events e JOIN variants v USING (sku) WHERE type = 'click'),
l AS (SELECT * FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id, session_id, word ORDER BY occurred_at DESC, sku DESC, i) = 1)
SELECT site_id, session_id, word, CAST(ROW_NUMBER() OVER (PARTITION BY site_id, session_id ORDER BY occurred_at DESC, sku DESC, i, word) AS INT) AS place FROM l QUALIFY place <= 8""")
def session_affinity(spark, sf_dir):
    return rules.session_affinity(shopper_events(spark, sf_dir), titled(variants(spark, sf_dir)), by=["site_id"])


SCORE_SQL = f"CASE WHEN n < 2 OR starts_with(query_id, 'blue') THEN 0 ELSE (lower(finish) IN ('red', 'large'))::INT + ({SIZE_SQL} = '12 in')::INT + (brand = 'Brand#12')::INT END"


@query(f"""WITH {RANKED_SQL}, {CARDS_SQL}, p AS (SELECT *, COUNT(*) OVER (PARTITION BY query_id) AS n FROM cards JOIN (SELECT sku, finish, size_in, brand FROM docs) d USING (sku) WHERE card <= 24)
SELECT query_id, card, sku, CAST({SCORE_SQL} AS INT) AS score, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY {SCORE_SQL} DESC, card) AS INT) AS place FROM p""")
def personalise(spark, sf_dir):
    page = search(spark, sf_dir).join(titled(docs(spark, sf_dir)).hint("merge"), "sku")
    words = F.array(*[F.lit(w) for w in ("Red", " LARGE", "brand#12", "12 In")])
    return rules.personalise(page, words, F.col("query_id").startswith("blue")).select("query_id", "card", "sku", "score", "place")


def messy_queries(spark, sf_dir):
    """A log with sizes, part numbers and questions, made from parts."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(F.when(key % 5 == 0, F.concat_ws("", F.lit("  4x6 "), "p_name", F.lit(" 12ft"))).when(key % 5 == 1, F.concat(F.lit("PN"), key.cast("string"), F.lit("XZ"))).when(key % 5 == 2, F.concat(F.lit("What goes with the "), "p_name", F.lit("s"))).when(key % 5 == 3, F.concat(F.col("p_size").cast("string"), F.lit("-1/2 in tall "), "p_name")).otherwise(F.col("p_name")).alias("query"))


@query("""WITH q AS (SELECT DISTINCT p_partkey % 5 AS k, p_name, p_size, p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), z AS (SELECT *, CASE WHEN b LIKE '%s' AND b NOT LIKE '%ss' AND length(b) > 3 THEN left(b, length(b) - 1) ELSE b END AS b1, CASE WHEN a LIKE '%ss' OR a NOT LIKE '%s' OR length(a) <= 3 THEN a ELSE left(a, length(a) - 1) END AS a1 FROM q),
r AS (SELECT CASE k WHEN 0 THEN '  4x6 ' || p_name || ' 12ft' WHEN 1 THEN 'PN' || p_partkey || 'XZ' WHEN 2 THEN 'What goes with the ' || p_name || 's' WHEN 3 THEN p_size || '-1/2 in tall ' || p_name ELSE p_name END AS query,
  CASE k WHEN 0 THEN 'dimensional' WHEN 1 THEN 'sku' WHEN 2 THEN 'natural_language' WHEN 3 THEN 'dimensional' ELSE 'keyword' END AS type, CASE k WHEN 1 THEN 'pn' || p_partkey || 'xz' WHEN 2 THEN 'goe|' || a1 || '|' || b ELSE a1 || '|' || b1 END AS terms,
  CASE k WHEN 0 THEN 'width_in=4.0|height_in=6.0|length_in=144.0' WHEN 3 THEN 'height_in=' || p_size || '.5' ELSE '' END AS dimensions, CASE WHEN k = 1 THEN 'PN' || p_partkey || 'XZ' END AS sku FROM z) SELECT DISTINCT * FROM r""")
def analyse_queries(spark, sf_dir):
    rows = analyse.analyse_queries(messy_queries(spark, sf_dir))
    named = F.transform("dimensions", lambda d: F.concat_ws("=", d["field"], d["inches"].cast("string")))
    return rows.select("query", "type", F.array_join("terms", "|").alias("terms"), F.array_join(named, "|").alias("dimensions"), "sku")


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part), w AS (SELECT DISTINCT replace(p_name, ' ', '') AS word FROM part) SELECT word, x.t AS "left", y.t AS "right" FROM w JOIN v x ON starts_with(word, x.t) JOIN v y ON word = x.t || y.t
WHERE length(word) >= 8 AND length(x.t) >= 3 AND length(y.t) >= 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY word ORDER BY length(x.t)) = 1""")
def split_compounds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return analyse.split_compounds(p.select(F.regexp_replace("p_name", " ", "").alias("word")), p.select(F.explode(F.split("p_name", " ")).alias("token")))


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part), t AS (SELECT DISTINCT substr(w, 1, 1) || substr(w, 3) AS term FROM (SELECT split_part(p_name, ' ', 2) AS w FROM part)), b AS (SELECT term, CASE WHEN length(term) >= 8 THEN 2 WHEN length(term) >= 4 THEN 1 ELSE 0 END AS budget FROM t WHERE term NOT IN (SELECT token FROM v))
SELECT term, token AS correction, CAST(levenshtein(term, token) AS INT) AS distance FROM b JOIN v ON substr(token, 1, 1) = substr(term, 1, 1) AND levenshtein(term, token) <= budget AND budget > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY term ORDER BY distance, length(token), token) = 1""")
def suggest_corrections(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    leaf = F.get(F.split("p_name", " "), 1)
    terms = p.select(F.concat(F.substring(leaf, 1, 1), F.substring(leaf, F.lit(3), F.length(leaf))).alias("term"))
    return analyse.suggest_corrections(terms, p.select(F.explode(F.split("p_name", " ")).alias("token")).distinct())


@query("WITH q AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT p_name AS query_id, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS terms FROM q")
def relax_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_name").distinct()
    return rows.select(F.col("p_name").alias("query_id"), F.array_join(analyse.relax_terms(F.split("p_name", " ")), "|").alias("terms"))


CASES_SQL = f"""{DOCS_SQL}, cs AS (SELECT 'category:' || category_ids[2] AS case_id, lower(category_leaf) AS query, category_ids[2] AS category_id, CAST(NULL AS VARCHAR) AS finish, COUNT(DISTINCT parent_id) AS expected FROM docs GROUP BY category_ids[2], category_leaf HAVING COUNT(DISTINCT parent_id) >= 3
UNION ALL (SELECT 'finish:' || finish, lower(finish || ' ' || category_leaf), category_ids[2], finish, COUNT(DISTINCT parent_id) AS e FROM docs GROUP BY finish, category_ids[2], category_leaf QUALIFY ROW_NUMBER() OVER (PARTITION BY finish ORDER BY e DESC, category_ids[2]) = 1 AND e >= 3))"""


@query(f"WITH {CASES_SQL} SELECT * FROM cs")
def coverage_cases(spark, sf_dir):
    return relevance.coverage_cases(docs(spark, sf_dir))


def judged(spark, sf_dir):
    """The finish cases against the search results of the queries with their words."""
    cases = relevance.coverage_cases(docs(spark, sf_dir), least=1).where("finish is not null")
    hits = search(spark, sf_dir).join(cases.select("case_id", F.col("query").alias("query_id")), "query_id").select("case_id", "card", "sku")
    totals = query_totals(spark, sf_dir).join(cases.select("case_id", F.col("query").alias("query_id")), "query_id").select("case_id", F.col("products").alias("total"))
    return relevance.judge_hits(cases, hits, totals, docs(spark, sf_dir))


JUDGED_SQL = f"""{RANKED_SQL}, {CARDS_SQL}, cs AS (SELECT 'finish:' || finish AS case_id, lower(finish || ' ' || category_leaf) AS query, category_ids[2] AS category_id, finish, COUNT(DISTINCT parent_id) AS expected FROM docs GROUP BY finish, category_ids[2], category_leaf QUALIFY ROW_NUMBER() OVER (PARTITION BY finish ORDER BY expected DESC, category_ids[2]) = 1),
ju AS (SELECT cs.case_id, COALESCE(AVG((list_contains(d.category_ids, cs.category_id) AND d.finish = cs.finish)::INT), 0) AS p, ANY_VALUE(expected) AS e FROM cs LEFT JOIN (SELECT * FROM cards WHERE card <= 10) c ON c.query_id = cs.query LEFT JOIN docs d ON d.sku = c.sku GROUP BY 1),
tt AS (SELECT cs.case_id, COUNT(DISTINCT h.parent_id) AS t FROM cs LEFT JOIN hits h ON h.query_id = cs.query GROUP BY 1),
jd AS (SELECT case_id, ROUND(p, 6) AS precision, ROUND(LEAST(1.0, t / e::DOUBLE), 6) AS coverage, ROUND(LEAST(1.0, e / GREATEST(t, e)::DOUBLE), 6) AS focus, p >= 0.8 AS passed FROM ju JOIN tt USING (case_id))"""


@query(f"WITH {JUDGED_SQL} SELECT * FROM jd")
def judge_hits(spark, sf_dir):
    return judged(spark, sf_dir)


@query(f"WITH {JUDGED_SQL} SELECT COUNT(*) AS cases, COUNT(*) FILTER (passed) AS passed, ROUND(AVG(precision), 6) AS precision, ROUND(AVG(coverage), 6) AS coverage, ROUND(AVG(focus), 6) AS focus FROM jd")
def suite_summary(spark, sf_dir):
    return relevance.suite_summary(judged(spark, sf_dir))


@query(f"WITH {JUDGED_SQL} SELECT case_id, CASE WHEN focus < 0.5 THEN 'improvement' ELSE 'same' END AS drift FROM jd")
def baseline_drift(spark, sf_dir):
    now = judged(spark, sf_dir).persist()
    return relevance.baseline_drift(now, now.withColumn("focus", F.when(F.col("focus") < 0.5, F.col("focus") - 0.1).otherwise(F.col("focus"))))


@query(f"""WITH {DOCS_SQL} SELECT DISTINCT '/c/' || category_ids[1] AS path, category_top AS title, 1.0 AS priority, 'category' AS source FROM docs UNION ALL SELECT DISTINCT '/c/' || category_ids[2], category_top || ' > ' || category_leaf, 0.8, 'category' FROM docs UNION ALL SELECT '/collections/cheap', 'Cheap', 0.8, 'collection'""")
def landing_pages(spark, sf_dir):
    collections = spark.createDataFrame([("cheap", "Cheap")], "slug string, title string")
    return relevance.landing_pages(catalogue.category_directory(docs(spark, sf_dir)), collections)


@query("""SELECT p_partkey, CAST(p_size + 0.5 AS DOUBLE) AS mixed, FLOOR(p_size * 16 / 25.4 + 0.5) / 16 AS mm, p_size * 12.0 AS feet FROM part""")
def measurements(spark, sf_dir):
    size = F.col("p_size").cast("string")
    inches = lambda suffix: measure.attribute_inches(F.lit("width"), F.concat(size, F.lit(suffix)))
    return table(spark, sf_dir, "part").select("p_partkey", inches('-1/2"').alias("mixed"), inches(" mm").alias("mm"), inches("ft").alias("feet"))


#: Each query pins the product of the part after its own.
PINS_SQL = f"{HITS_SQL}, pins AS (SELECT DISTINCT a.p_name AS query_id, b.p_name || '/' || b.p_type AS parent_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@query(f"""WITH {PINS_SQL} SELECT query_id, parent_id, 'P' || MIN(CAST(substr(sku, 2) AS BIGINT)) AS sku FROM (SELECT * FROM pins EXCEPT SELECT query_id, parent_id FROM hits) JOIN (SELECT sku, parent_id FROM docs) USING (parent_id) GROUP BY 1, 2""")
def absent_pins(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    after = p.select((F.col("p_partkey") - 1).alias("k"), F.concat_ws("/", "p_name", "p_type").alias("parent_id"))
    pins = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("query_id")).join(after.hint("merge"), "k").select("query_id", "parent_id")
    index, queries, expanded = prepared(spark, sf_dir)
    rows = docs(spark, sf_dir).withColumn("ordinal", F.substring("sku", 2, 20).cast("bigint"))
    return rules.absent_pins(pins, retrieve.match_terms(queries, index, expanded), rows)


#: Leaf categories as collections: discounted products are included by hand, places for the cheap ones; sold out ones are excluded.
PLAN_SQL = f"""{DOCS_SQL}, vals AS (SELECT DISTINCT 'collection:' || category_leaf AS label FROM docs UNION SELECT 'collection:' || category_top FROM docs),
asg AS (SELECT 'collection:' || category_leaf AS label, parent_id, CASE WHEN in_stock THEN 'include' ELSE 'exclude' END AS mode, CASE WHEN in_stock AND price < 1200 THEN CAST(inventory AS INT) END AS position FROM docs WHERE discount_pct > 0 OR NOT in_stock),
one AS (SELECT label, parent_id, CASE WHEN bool_or(mode = 'exclude') THEN 'exclude' ELSE 'include' END AS mode, CASE WHEN NOT bool_or(mode = 'exclude') THEN MIN(position) END AS position FROM asg GROUP BY 1, 2),
plan AS (SELECT 'main' AS site_id, label, parent_id, mode, position FROM vals LEFT JOIN one USING (label))"""


def plan_of(spark, sf_dir):
    rows = docs(spark, sf_dir)
    label = lambda c: F.concat(F.lit("collection:"), F.col(c)).alias("label")
    values = rows.select("site_id", label("category_leaf")).union(rows.select("site_id", label("category_top"))).distinct().withColumn("selector", F.lit("{}"))
    members = rows.where("discount_pct > 0 or not in_stock").select("site_id", label("category_leaf"), "parent_id", F.when(F.col("in_stock"), "include").otherwise("exclude").alias("mode"), F.when(F.col("in_stock") & (F.col("price") < 1200), F.col("inventory").cast("int")).alias("position"))
    return selectors.label_plan(values, members)


@query(f"WITH {PLAN_SQL} SELECT * FROM plan")
def load_label_plan(spark, sf_dir):
    return plan_of(spark, sf_dir).drop("selector")


@query(f"WITH {PLAN_SQL} SELECT d.sku, COALESCE(string_agg(p.label || '=' || p.position, '|' ORDER BY p.label), '') AS positions FROM docs d LEFT JOIN (SELECT * FROM plan WHERE mode = 'include' AND position IS NOT NULL) p USING (parent_id) GROUP BY 1")
def category_position_order(spark, sf_dir):
    rows = selectors.curated_positions(docs(spark, sf_dir), plan_of(spark, sf_dir))
    return rows.select("sku", F.array_join(F.transform("positions", lambda p: F.concat_ws("=", p["label"], p["position"].cast("string"))), "|").alias("positions"))


@query(f"WITH {PRODUCTS_SQL}, m AS (SELECT site_id, parent_id, {TREE_SQL} AS hit FROM prod) SELECT site_id, COUNT(*) FILTER (hit) AS matched, COUNT(*) AS total, COUNT(*) AS sampled, TRUE AS exact, (SELECT string_agg(parent_id, '|' ORDER BY parent_id) FROM (SELECT parent_id FROM m WHERE hit ORDER BY parent_id LIMIT 8)) AS examples FROM m GROUP BY 1")
def preview_selector(spark, sf_dir):
    return selectors.preview_selector(selectors.products(variants(spark, sf_dir)), TREE).withColumn("examples", F.array_join("examples", "|"))


@query(f"WITH {CASES_SQL} SELECT case_id, query, category_id, expected FROM cs UNION ALL SELECT DISTINCT 'written:' || finish, finish, NULL, NULL FROM docs")
def union_cases(spark, sf_dir):
    rows = docs(spark, sf_dir)
    written = rows.select(F.concat_ws(":", F.lit("written"), "finish").alias("case_id"), F.col("finish").alias("query")).distinct()
    return relevance.union_cases(written, relevance.coverage_cases(rows)).select("case_id", "query", "category_id", "expected")
