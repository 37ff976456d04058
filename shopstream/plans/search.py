"""Queries over the catalogue and a query log: documents, retrieval, ranking, facets, directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue, facets, learn, rank, recommend, retrieve, signals
from .analytics import CTR, PRODUCT_DAY, product_day
from .registry import Registry
from .views import AS_OF, EVENTS_SQL, VARIANTS_SQL, as_of, shopper_events, table, variants

REGISTRY = Registry()
QUERIES, ORACLE, query = REGISTRY.queries, REGISTRY.oracle, REGISTRY.query


def docs(spark, sf_dir):
    return catalogue.variant_docs(variants(spark, sf_dir))


def fields():
    return {"title": F.col("title"), "sku": F.col("sku"), "brand": F.col("brand"), "categoryPath": F.array_join("category_path", " "), "attributes": F.col("finish")}


def requests(spark, sf_dir):
    """A query log: each product name, and once more with a letter missing in its second word."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    words = F.split("p_name", " ")
    leaf = F.get(words, 1)
    typo = F.concat(F.substring(leaf, 1, 1), F.substring(leaf, F.lit(3), F.length(leaf)))
    return names.select(F.col("p_name").alias("query_id"), words.alias("terms")).union(names.select(F.concat(F.lit("typo "), "p_name"), F.array(F.get(words, 0), typo)))


def terms_of(queries):
    return retrieve.query_terms(queries).select("term").distinct()


def vocabulary_of(index):
    return index.select("token").where(F.length("token") >= 3).distinct()


DOCS_SQL = f"""{VARIANTS_SQL}, docs AS (SELECT *, CASE WHEN sale_price > 0 THEN sale_price ELSE price END AS effective_price,
  CASE WHEN sale_price > 0 AND price > 0 AND sale_price < price THEN FLOOR((price - sale_price) / price * 100 + 0.5) ELSE 0.0 END AS discount_pct, inventory > 0 AS in_stock,
  [regexp_replace(lower(category_top), '[^a-z0-9]+', '-', 'g'), regexp_replace(lower(category_top), '[^a-z0-9]+', '-', 'g') || '/' || regexp_replace(lower(category_leaf), '[^a-z0-9]+', '-', 'g')] AS category_ids FROM variants)"""
POSTS_SQL = f"""{DOCS_SQL}, posts AS (SELECT sku, parent_id, field, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS position FROM (
  SELECT sku, parent_id, f.field AS field, list_filter(string_split_regex(lower(f.text), '[^a-z0-9]+'), lambda t: t <> '') AS toks FROM (
    SELECT sku, parent_id, unnest([{{'field': 'title', 'text': title}}, {{'field': 'sku', 'text': sku}}, {{'field': 'brand', 'text': brand}}, {{'field': 'categoryPath', 'text': category_top || ' ' || category_leaf}}, {{'field': 'attributes', 'text': finish}}]) AS f FROM docs)))"""
GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substr({0}, i, 2)))"
REQUESTS_SQL = """rq AS (SELECT DISTINCT p_name AS query_id, string_split(p_name, ' ') AS terms FROM part UNION SELECT DISTINCT 'typo ' || p_name, [split_part(p_name, ' ', 1), substr(split_part(p_name, ' ', 2), 1, 1) || substr(split_part(p_name, ' ', 2), 3)] FROM part)"""
EXPAND_SQL = f"""{POSTS_SQL}, {REQUESTS_SQL},
qt AS (SELECT query_id, unnest(list_distinct(terms)) AS term, len(list_distinct(terms)) AS n_terms FROM rq), terms AS (SELECT DISTINCT term FROM qt), vocab AS (SELECT DISTINCT token FROM posts WHERE length(token) >= 3),
tb AS (SELECT term, CASE WHEN regexp_matches(term, '[0-9]') THEN 0 WHEN length(term) >= 8 THEN 2 WHEN length(term) >= 4 THEN 1 ELSE 0 END AS budget, {GRAMS.format('term')} AS g FROM terms),
fuzzy AS (SELECT term, token, CAST(levenshtein(term, token) AS INT) AS distance FROM tb JOIN (SELECT token, {GRAMS.format('token')} AS h FROM vocab) ON len(list_intersect(g, h)) >= greatest(len(g) - 2 * budget, 1)
  WHERE budget > 0 AND abs(length(term) - length(token)) <= budget AND levenshtein(term, token) BETWEEN 1 AND budget
  QUALIFY ROW_NUMBER() OVER (PARTITION BY term ORDER BY distance, length(token), token) <= 12),
prefix AS (SELECT term, token FROM terms JOIN vocab ON starts_with(token, term) AND token <> term AND length(term) >= 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY term ORDER BY token) <= 8),
ex0 AS (SELECT term, term AS token, 0 AS distance, 0 AS kind FROM terms UNION ALL SELECT term, token, distance, 1 FROM fuzzy UNION ALL SELECT term, token, 0, 2 FROM prefix),
ex AS (SELECT term, token, kind, distance FROM ex0 QUALIFY ROW_NUMBER() OVER (PARTITION BY term, token ORDER BY kind, distance) = 1)"""
HITS_SQL = f"""{EXPAND_SQL}, h0 AS (SELECT qt.query_id, p.sku, p.parent_id, qt.term, qt.n_terms, ex.token, p.field, p.position, ex.distance, ex.kind FROM qt JOIN ex USING (term) JOIN posts p USING (token)),
ok AS (SELECT query_id, sku FROM h0 GROUP BY query_id, sku HAVING COUNT(DISTINCT term) = MAX(n_terms)), hits AS (SELECT h0.* FROM h0 JOIN ok USING (query_id, sku))"""
WEIGHT = "CASE field WHEN 'title' THEN 10 WHEN 'sku' THEN 9 WHEN 'brand' THEN 7 WHEN 'categoryPath' THEN 6 WHEN 'attributes' THEN 5 ELSE 0 END"
BUSINESS_SQL = f"""{PRODUCT_DAY}, {CTR}, ci AS (SELECT * FROM c WHERE impressions > 0), cm AS (SELECT site_id, SUM(clicks) / CAST(SUM(impressions) AS DOUBLE) AS mean FROM ci GROUP BY 1),
ctr AS (SELECT sku, mean, (clicks + 50 * mean) / (impressions + 50) AS ctr FROM ci JOIN cm USING (site_id)),
biz AS (SELECT sku, FLOOR(10000 * ((3 * CASE WHEN sales_velocity > 0 THEN LEAST(LN(1 + sales_velocity) / LN(1001), 1) ELSE 0 END + 2 * LEAST(GREATEST(margin / 100, 0), 1) + CASE WHEN inventory > 0 THEN LEAST(LN(1 + inventory) / LN(501), 1) ELSE 0 END
  + CASE WHEN date_added IS NULL THEN 0 ELSE POW(0.5, GREATEST((FLOOR(epoch(TIMESTAMP '{AS_OF}')) - FLOOR(epoch(date_added))) / 86400.0, 0) / 180) END + 2 * CASE WHEN mean > 0 AND ctr IS NOT NULL THEN LEAST(0.5 * ctr / mean, 1) ELSE 0.5 END)
  / 11 * CASE WHEN inventory > 0 THEN 1 ELSE 0.35 END) + 0.5) / 10000 AS business FROM docs LEFT JOIN ctr USING (sku))"""
SIGNALS_SQL = f"""{HITS_SQL}, be AS (SELECT query_id, sku, term, token, kind, distance FROM hits QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, sku, term ORDER BY kind, distance, token) = 1),
w AS (SELECT query_id, sku, CAST(SUM(distance) AS BIGINT) AS typos, COUNT(*) AS words_matched FROM be GROUP BY 1, 2),
pl AS (SELECT h.query_id, h.sku, h.field, h.term, h.kind, MIN(h.position) AS position FROM hits h JOIN be USING (query_id, sku, term, token) GROUP BY 1, 2, 3, 4, 5),
fs AS (SELECT query_id, sku, field, MAX(position) - MIN(position) + 1 - COUNT(*) AS proximity, CASE WHEN COUNT(*) FILTER (kind = 1) > 0 THEN 0 WHEN COUNT(*) FILTER (kind = 2) > 0 THEN 1 ELSE 2 END AS exactness, {WEIGHT} AS weight FROM pl GROUP BY query_id, sku, field),
bf AS (SELECT * FROM fs QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, sku ORDER BY weight DESC, proximity, exactness DESC) = 1),
rs AS (SELECT query_id, sku, CAST(SUM({WEIGHT}) AS BIGINT) AS retrieval FROM (SELECT DISTINCT query_id, sku, term, field FROM hits) GROUP BY 1, 2),
sig AS (SELECT w.query_id, w.sku, typos, words_matched, CAST(bf.weight AS INT) AS best_field_weight, CAST(bf.proximity AS BIGINT) AS proximity, CAST(bf.exactness AS INT) AS exactness FROM w JOIN bf USING (query_id, sku))"""
RANKED_SQL = f"""{EVENTS_SQL}, {SIGNALS_SQL}, {BUSINESS_SQL}, cand AS (SELECT sig.*, rs.retrieval, biz.business, docs.parent_id FROM sig JOIN rs USING (query_id, sku) JOIN biz USING (sku) JOIN docs USING (sku)),
wp AS (SELECT query_id, parent_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY MAX(retrieval) DESC, parent_id) AS INT) AS place FROM cand GROUP BY 1, 2 QUALIFY place <= 240),
win AS (SELECT cand.*, wp.place FROM cand JOIN wp USING (query_id, parent_id) QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY place, retrieval DESC, sku) <= 1920),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY typos, words_matched DESC, best_field_weight DESC, proximity, exactness DESC, business DESC, retrieval DESC, sku) AS INT) AS rank, COUNT(*) OVER (PARTITION BY query_id) AS n FROM win)"""


@query(f"WITH {DOCS_SQL} SELECT site_id, sku, parent_id, effective_price, discount_pct, in_stock, array_to_string(category_ids, '|') AS category_ids, finish || ' finish:' || finish AS attribute_text FROM docs")
def to_variant_docs(spark, sf_dir):
    return docs(spark, sf_dir).select("site_id", "sku", "parent_id", "effective_price", "discount_pct", "in_stock", F.array_join("category_ids", "|").alias("category_ids"), "attribute_text")


@query(f"WITH {POSTS_SQL} SELECT sku, parent_id, field, token, CAST(position AS INT) AS position FROM posts")
def build_postings(spark, sf_dir):
    return retrieve.postings(docs(spark, sf_dir), fields()).drop("site_id")


@query(f"WITH {POSTS_SQL} SELECT DISTINCT 'main' AS site_id, token FROM posts WHERE length(token) >= 3 AND field IN ('title', 'brand', 'categoryPath', 'attributes')")
def vocabulary(spark, sf_dir):
    return catalogue.vocabulary(docs(spark, sf_dir).withColumn("path", F.array_join("category_path", " ")), ["title", "brand", "path", "finish"])


def prepared(spark, sf_dir):
    index, queries = retrieve.postings(docs(spark, sf_dir), fields()).persist(), requests(spark, sf_dir)
    return index, queries, retrieve.expansions(terms_of(queries), vocabulary_of(index))


@query(f"WITH {EXPAND_SQL} SELECT * FROM fuzzy")
def fuzzy_terms(spark, sf_dir):
    return retrieve.fuzzy_terms(terms_of(requests(spark, sf_dir)), vocabulary_of(retrieve.postings(docs(spark, sf_dir), fields())))


@query(r"""WITH v AS (SELECT DISTINCT t AS token FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS t FROM documents) WHERE length(t) >= 3), q AS (SELECT DISTINCT substr(t, 1, 5) AS term FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS t FROM benchmark) WHERE length(t) >= 3)
SELECT term, token FROM q JOIN v ON starts_with(token, term) AND token <> term QUALIFY ROW_NUMBER() OVER (PARTITION BY term ORDER BY token) <= 8""")
def prefix_terms(spark, sf_dir):
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)).alias("token")).distinct()
    return retrieve.prefix_terms(words("benchmark").select(F.substring("token", 1, 5).alias("term")), words("documents"))


@query(f"WITH {HITS_SQL} SELECT query_id, sku, parent_id, term, token, field, CAST(position AS INT) AS position, CAST(distance AS INT) AS distance, CAST(kind AS INT) AS kind FROM hits")
def match_terms(spark, sf_dir):
    index, queries, expanded = prepared(spark, sf_dir)
    return retrieve.match_terms(queries, index, expanded).select("query_id", "sku", "parent_id", "term", "token", "field", "position", "distance", "kind")


@query(f"WITH {SIGNALS_SQL} SELECT * FROM rs")
def retrieval_score(spark, sf_dir):
    index, queries, expanded = prepared(spark, sf_dir)
    return retrieve.retrieval_score(retrieve.match_terms(queries, index, expanded))


def n_terms(queries):
    return retrieve.query_terms(queries).select("query_id", "n_terms").distinct()


@query(f"WITH {SIGNALS_SQL} SELECT * FROM sig")
def text_signals(spark, sf_dir):
    index, queries, expanded = prepared(spark, sf_dir)
    return rank.text_signals(retrieve.match_terms(queries, index, expanded), n_terms(queries))


def scored_docs(spark, sf_dir):
    ctr = signals.product_ctr(product_day(spark, sf_dir), as_of()).select("sku", "ctr", "mean")
    rows = docs(spark, sf_dir).join(ctr, "sku", "left").withColumn("review_score", F.lit(None).cast("double")).withColumn("discontinued", F.lit(False))
    return rank.business_score(rows, as_of())


@query(f"WITH {EVENTS_SQL}, {DOCS_SQL}, {BUSINESS_SQL} SELECT sku, business FROM biz")
def business_score(spark, sf_dir):
    return scored_docs(spark, sf_dir).select("sku", "business")


def ranked(spark, sf_dir):
    index, queries, expanded = prepared(spark, sf_dir)
    matches = retrieve.match_terms(queries, index, expanded).persist()  # signals, scores and the window all read it
    return ranked_matches(matches, queries, scored_docs(spark, sf_dir))


def ranked_matches(matches, queries, scored_rows):
    scored = retrieve.retrieval_score(matches).join(scored_rows.select("sku", "parent_id", "business").hint("merge"), "sku")
    window = retrieve.window_parents(scored)
    return rank.rank_cascade(window.join(rank.text_signals(matches, n_terms(queries)), ["query_id", "sku"]))


@query(f"WITH {RANKED_SQL} SELECT query_id, parent_id, sku, retrieval, place FROM win")
def window_parents(spark, sf_dir):
    index, queries, expanded = prepared(spark, sf_dir)
    scored = retrieve.retrieval_score(retrieve.match_terms(queries, index, expanded)).join(docs(spark, sf_dir).select("sku", "parent_id").hint("merge"), "sku")
    return retrieve.window_parents(scored).select("query_id", "parent_id", "sku", "retrieval", "place")


@query(f"WITH {RANKED_SQL} SELECT query_id, sku, rank, FLOOR((1 - (rank - 1) / CAST(n AS DOUBLE)) * 10000 + 0.5) / 10000 AS final_score, concat_ws('|', typos, words_matched, best_field_weight, proximity, exactness) AS band FROM ranked")
def rank_cascade(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "sku", "rank", "final_score", rank.band_key().alias("band"))


CARDS_SQL = """ip AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS k FROM ranked),
cards AS (SELECT query_id, parent_id, MIN(rank) AS first_rank, MIN(sku) FILTER (k = 1) AS sku, string_agg(sku, '|' ORDER BY rank) FILTER (k <= 8) AS variants, COUNT(*) AS matching, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY MIN(rank)) AS INT) AS card FROM ip GROUP BY 1, 2)"""


@query(f"WITH {RANKED_SQL}, {CARDS_SQL} SELECT * FROM cards")
def group_by_parent(spark, sf_dir):
    return rank.group_by_parent(ranked(spark, sf_dir)).withColumn("variants", F.array_join("variants", "|"))


@query(f"WITH {RANKED_SQL}, {CARDS_SQL} SELECT query_id, card, parent_id, sku, matching FROM cards WHERE card <= 24")
def search(spark, sf_dir):
    return rank.paginate(rank.group_by_parent(ranked(spark, sf_dir)), 1, 24).select("query_id", "card", "parent_id", "sku", "matching")


@query(f"WITH {RANKED_SQL}, {CARDS_SQL} SELECT query_id, card, parent_id FROM cards WHERE card BETWEEN 6 AND 10")
def paginate(spark, sf_dir):
    return rank.paginate(rank.group_by_parent(ranked(spark, sf_dir)), 2, 5).select("query_id", "card", "parent_id")


@query(f"WITH {HITS_SQL} SELECT query_id, COUNT(DISTINCT parent_id) AS products, COUNT(DISTINCT sku) AS variants FROM hits GROUP BY 1")
def query_totals(spark, sf_dir):
    index, queries, expanded = prepared(spark, sf_dir)
    return facets.query_totals(retrieve.match_terms(queries, index, expanded))


@query(f"WITH {HITS_SQL}, t AS (SELECT query_id, COUNT(DISTINCT parent_id) AS total FROM hits GROUP BY 1) SELECT query_id, total, LEAST(total, 12) AS reachable, GREATEST(CAST(CEIL(LEAST(total, 12) / 5.0) AS BIGINT), 1) AS pages FROM t")
def page_counts(spark, sf_dir):
    totals = query_totals(spark, sf_dir).select("query_id", F.col("products").alias("total"))
    return rank.page_counts(totals, 5, 12)


SELECTED = {"finish": ["red", "blue"], "category_leaf": ["bolt", "gear", "widget"]}


def facet_columns():
    return {"brand": F.col("brand"), "finish": F.col("finish"), "category_leaf": F.col("category_leaf"), "category_top": F.col("category_top"), "in_stock": F.col("in_stock").cast("int")}


FACETS_SQL = f"""{DOCS_SQL}, f AS (SELECT *, finish NOT IN ('red', 'blue') AS m1, category_leaf NOT IN ('bolt', 'gear', 'widget') AS m2 FROM docs),
fc AS (SELECT facet, value, COUNT(DISTINCT parent_id) AS products FROM (
  SELECT 'brand' AS facet, brand AS value, parent_id FROM f WHERE NOT m1 AND NOT m2 UNION ALL SELECT 'finish', finish, parent_id FROM f WHERE NOT m2 UNION ALL SELECT 'category_leaf', category_leaf, parent_id FROM f WHERE NOT m1
  UNION ALL SELECT 'category_top', category_top, parent_id FROM f WHERE NOT m1 AND NOT m2 UNION ALL SELECT 'in_stock', CAST(CAST(in_stock AS INT) AS VARCHAR), parent_id FROM f WHERE NOT m1 AND NOT m2) GROUP BY 1, 2)"""


@query(f"WITH {FACETS_SQL} SELECT * FROM fc")
def facet_counts(spark, sf_dir):
    return facets.facet_counts(docs(spark, sf_dir), facet_columns(), SELECTED)


@query(f"""WITH {FACETS_SQL}, cfg AS (SELECT 'brand' AS facet, 'count' AS sort_by, 8 AS n UNION ALL SELECT 'finish', 'custom', 4 UNION ALL SELECT 'category_leaf', 'alpha', 3),
o AS (SELECT fc.*, n, CAST(ROW_NUMBER() OVER (PARTITION BY facet ORDER BY CASE sort_by WHEN 'count' THEN -products WHEN 'custom' THEN CASE value WHEN 'small' THEN 1 WHEN 'large' THEN 2 ELSE 999 END ELSE 0 END, CASE WHEN sort_by = 'custom' THEN -products END, value) AS INT) AS place,
  (facet = 'finish' AND value = 'red') AS chosen FROM fc JOIN cfg USING (facet)) SELECT facet, value, products, place, chosen FROM o WHERE place <= n OR chosen""")
def sort_facet_values(spark, sf_dir):
    config = spark.createDataFrame([("brand", "count", 8, []), ("finish", "custom", 4, ["small", "large"]), ("category_leaf", "alpha", 3, [])], "facet string, sort_by string, truncate_at int, custom array<string>")
    chosen = spark.createDataFrame([("finish", "red")], "facet string, value string")
    return facets.sort_facet_values(facets.facet_counts(docs(spark, sf_dir), facet_columns(), SELECTED), config, chosen)


@query(f"""WITH {FACETS_SQL}, cfg AS (SELECT * FROM (VALUES (1, 'brand', 'Brand', 'checkbox', false, 'count', 8), (2, 'finish', 'Finish', 'checkbox', false, 'custom', 4), (3, 'category_leaf', 'Category', 'checkbox', false, 'alpha', 3), (5, 'in_stock', 'Availability', 'checkbox', false, 'alpha', 0), (6, 'category_top', 'Line', 'checkbox', true, 'alpha', 2)) t(position, facet, label, display, attribute, sort_by, n)),
lab AS (SELECT fc.*, CASE WHEN facet = 'in_stock' THEN CASE value WHEN '1' THEN 'In Stock' ELSE 'Out of Stock' END ELSE value END AS value_label FROM fc),
o AS (SELECT position, facet, label, display, attribute, n, value, value_label, products, (facet = 'finish' AND value = 'red') AS chosen, CAST(ROW_NUMBER() OVER (PARTITION BY facet ORDER BY
  CASE WHEN attribute OR sort_by = 'count' THEN 0 WHEN sort_by = 'custom' THEN CASE value WHEN 'small' THEN 1 WHEN 'large' THEN 2 ELSE 999 END ELSE 0 END,
  CASE WHEN sort_by = 'alpha' AND NOT attribute THEN value_label END, products DESC, value) AS INT) AS place FROM cfg JOIN lab USING (facet))
SELECT position, facet, label, display, attribute, place, value, value_label, products, chosen, CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most FROM o WHERE attribute OR n = 0 OR place <= n OR chosen
UNION ALL SELECT 4, 'price', 'Price', 'slider', false, NULL, NULL, NULL, NULL, NULL, MIN(effective_price), MAX(effective_price) FROM f WHERE NOT m1 AND NOT m2""")
def build_facets(spark, sf_dir):
    rows = docs(spark, sf_dir)
    config = [(1, "brand", "Brand", "checkbox", False, "count", 8, []), (2, "finish", "Finish", "checkbox", False, "custom", 4, ["small", "large"]), (3, "category_leaf", "Category", "checkbox", False, "alpha", 3, []),
              (4, "price", "Price", "slider", False, "count", 0, []), (5, "in_stock", "Availability", "checkbox", False, "alpha", 0, []), (6, "category_top", "Line", "checkbox", True, "alpha", 2, [])]
    config = spark.createDataFrame(config, "position int, facet string, label string, display string, attribute boolean, sort_by string, truncate_at int, custom array<string>")
    chosen = spark.createDataFrame([("finish", "red")], "facet string, value string")
    return facets.build_facets(facets.facet_counts(rows, facet_columns(), SELECTED), facets.facet_stats(rows, {"price": F.col("effective_price")}, facet_columns(), SELECTED), config, chosen)


#: Each variant as a product of its own, asked for by its title inside its deepest category.
SIMILAR_REQUESTS = """sr AS (SELECT 'main|' || array_to_string(list_sort(list_distinct(list_transform(string_split(title, ' '), lambda w: lower(w)))), ' ') || '|' || category_ids[2] AS query_id, parent_id AS anchor, string_split(lower(title), ' ') AS terms, category_ids[2] AS category_id FROM docs),
rq AS (SELECT DISTINCT query_id, list_sort(terms) AS terms FROM sr)"""
SIMILAR_SQL = RANKED_SQL.replace(REQUESTS_SQL, SIMILAR_REQUESTS).replace("p_name || '/' || p_type AS parent_id", "'P' || p_partkey AS parent_id").replace(
    "JOIN posts p USING (token))", "JOIN posts p USING (token) WHERE list_contains((SELECT d.category_ids FROM docs d WHERE d.sku = p.sku), split_part(qt.query_id, '|', 3)))")


@query(f"""WITH {SIMILAR_SQL}, {CARDS_SQL} SELECT 'main' AS site_id, anchor, parent_id, CAST(ROW_NUMBER() OVER (PARTITION BY anchor ORDER BY card) AS INT) AS rank FROM (SELECT DISTINCT anchor, query_id FROM sr) JOIN cards USING (query_id)
WHERE card <= 12 AND anchor <> parent_id QUALIFY rank <= 8""")
def similar(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("parent_id", F.col("sku"))
    asked = recommend.similar_requests(rows, ["finish"])
    queries = asked.select("query_id", "terms", "category_id").distinct()
    held = rows.withColumn("category_id", F.explode("category_ids")).join(queries.select("category_id").distinct(), "category_id", "left_semi")
    index = retrieve.postings(held, fields(), ["category_id"]).persist()
    matches = retrieve.match_terms(queries, index, retrieve.expansions(terms_of(queries), vocabulary_of(index)), ["category_id"]).persist()
    scored = scored_docs(spark, sf_dir).withColumn("parent_id", F.col("sku"))
    return recommend.similar(asked, rank.group_by_parent(ranked_matches(matches, queries, scored)))


@query(f"WITH {DOCS_SQL} SELECT site_id, MIN(effective_price) AS least, MAX(effective_price) AS most FROM docs GROUP BY 1")
def price_range(spark, sf_dir):
    return facets.price_range(docs(spark, sf_dir))


@query(f"""WITH {DOCS_SQL} SELECT sku FROM docs WHERE (finish IN ('red', 'blue')) AND in_stock AND effective_price BETWEEN 500 AND 1500 AND size_in >= 10 AND list_contains(category_ids, lower(category_top) || '/' || lower(category_leaf)) AND upper(sku) LIKE 'P1%'""")
def filters(spark, sf_dir):
    rows = docs(spark, sf_dir)
    own_leaf = F.array_contains("category_ids", F.concat_ws("/", F.lower("category_top"), F.lower("category_leaf")))
    test = retrieve.facet_filter({"finish": ["red", "blue"], "in_stock": ["true"]}, {"finish": F.col("finish"), "in_stock": F.col("in_stock")})
    test = test & retrieve.range_filter([("price", 500, 1500), ("size_in", 10, None), ("unknown", 1, 2)], {"price": F.col("effective_price"), "size_in": F.col("size_in")})
    return rows.where(test & own_leaf & retrieve.part_number_filter(F.lit("p1"))).select("sku")


@query(f"WITH {DOCS_SQL} SELECT sku FROM docs WHERE ABS(size_in - 12) < 0.03")
def dimension_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(retrieve.dimension_filter("width_in", 12.0, {"size_in": F.col("size_in")})).select("sku")


@query(f"""WITH {DOCS_SQL} SELECT site_id, unnest(['x']) AS k, category_ids[1] AS category_id, 1 AS depth, category_top AS path, COUNT(DISTINCT parent_id) AS products FROM docs GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT site_id, 'x', category_ids[2], 2, category_top || ' > ' || category_leaf, COUNT(DISTINCT parent_id) FROM docs GROUP BY 1, 2, 3, 4, 5""")
def category_directory(spark, sf_dir):
    return catalogue.category_directory(docs(spark, sf_dir)).withColumn("k", F.lit("x"))


@query(f"WITH {DOCS_SQL} SELECT site_id, brand, COUNT(DISTINCT parent_id) AS products FROM docs GROUP BY 1, 2")
def brand_directory(spark, sf_dir):
    return catalogue.brand_directory(docs(spark, sf_dir))


@query(f"WITH {DOCS_SQL} SELECT site_id, COUNT(*) AS documents FROM docs GROUP BY 1")
def document_count(spark, sf_dir):
    return catalogue.document_count(docs(spark, sf_dir))


def price_updates(spark, sf_dir):
    """Updates from lineitem: each shipped line changes a SKU's inventory, returned ones its price."""
    return table(spark, sf_dir, "lineitem").select(F.lit("main").alias("site_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("sku"), F.when(F.col("l_returnflag") == "R", F.round(F.col("l_extendedprice") / F.col("l_quantity") * 0.9, 2)).alias("price"), F.lit(None).cast("double").alias("sale_price"), F.col("l_quantity").cast("bigint").alias("inventory"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))


@query(f"""WITH {DOCS_SQL}, u AS (SELECT 'P' || l_partkey AS sku, arg_max(CASE WHEN l_returnflag = 'R' THEN ROUND(l_extendedprice / l_quantity * 0.9, 2) END, (l_shipdate, l_orderkey, l_linenumber)) AS p0,
  (list(CASE WHEN l_returnflag = 'R' THEN ROUND(l_extendedprice / l_quantity * 0.9, 2) END ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC))[1] AS p, (list(CAST(l_quantity AS BIGINT) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC))[1] AS inv FROM lineitem GROUP BY 1)
SELECT d.sku, COALESCE(u.p, d.price) AS price, COALESCE(u.inv, d.inventory) AS inventory, CASE WHEN d.sale_price > 0 THEN d.sale_price ELSE COALESCE(u.p, d.price) END AS effective_price, COALESCE(u.inv, d.inventory) > 0 AS in_stock, d.discount_pct FROM docs d LEFT JOIN u USING (sku)""")
def apply_price_deltas(spark, sf_dir):
    return catalogue.apply_price_deltas(docs(spark, sf_dir), price_updates(spark, sf_dir)).select("sku", "price", "inventory", "effective_price", "in_stock", "discount_pct")


@query(f"WITH {DOCS_SQL} SELECT sku, title FROM docs WHERE inventory > 0 UNION ALL SELECT sku, upper(title) FROM docs WHERE inventory = 0")
def upsert_docs(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return catalogue.upsert_docs(rows, rows.where("inventory = 0").withColumn("title", F.upper("title"))).select("sku", "title")


@query(f"WITH {DOCS_SQL} SELECT sku FROM docs WHERE in_stock")
def delete_by_sku(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return catalogue.delete_by_sku(rows, rows.where("not in_stock").select("site_id", "sku")).select("sku")


@query(f"""WITH {EVENTS_SQL}, {DOCS_SQL}, w AS (SELECT e.site_id, shopper_id, parent_id, CAST(ROW_NUMBER() OVER (PARTITION BY e.site_id, shopper_id ORDER BY MAX(occurred_at) DESC, parent_id) AS INT) AS place
FROM shopper_events e JOIN (SELECT sku, parent_id FROM docs) v USING (sku) WHERE type IN ('product_view', 'click') AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2, 3 QUALIFY place <= 8)
SELECT w.site_id, w.shopper_id, w.parent_id, w.place, 'P' || MIN(CAST(substr(d.sku, 2) AS BIGINT)) AS sku FROM w JOIN docs d USING (parent_id) GROUP BY 1, 2, 3, 4""")
def get_by_parent_ids(spark, sf_dir):
    """Each shopper's page of products seen last is a request."""
    rows = docs(spark, sf_dir).withColumn("ordinal", F.substring("sku", 2, 20).cast("bigint"))
    seen = recommend.recently_viewed(shopper_events(spark, sf_dir), rows.select("sku", "parent_id"), as_of())
    return catalogue.get_by_parent_ids(rows, seen.select("site_id", "shopper_id", "parent_id", F.col("rank").alias("place")))


@query(f"WITH {DOCS_SQL}, p AS (SELECT parent_id, CAST(ROW_NUMBER() OVER (ORDER BY parent_id) AS INT) AS place, COUNT(*) OVER () AS total_products FROM (SELECT DISTINCT parent_id FROM docs)) SELECT sku, place, total_products FROM docs JOIN p USING (parent_id) WHERE place <= 50")
def sample_products(spark, sf_dir):
    return catalogue.sample_products(docs(spark, sf_dir), 50).select("sku", "place", "total_products")


@query(f"WITH {DOCS_SQL} SELECT sku, CAST(ROW_NUMBER() OVER (ORDER BY discount_pct DESC, sku) AS INT) AS place FROM docs QUALIFY place <= 100")
def sort_hits(spark, sf_dir):
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("site_id").orderBy(*catalogue.sort_key("discount")))
    return docs(spark, sf_dir).withColumn("place", place).where("place <= 100").select("sku", "place")


@query(f"WITH {EVENTS_SQL}, {DOCS_SQL} SELECT sku FROM docs WHERE sku NOT IN (SELECT sku FROM shopper_events WHERE type = 'purchase' AND sku IS NOT NULL)")
def exclude_skus(spark, sf_dir):
    bought = shopper_events(spark, sf_dir).where("type = 'purchase'").select("site_id", "sku").distinct()
    return retrieve.exclude_skus(docs(spark, sf_dir), bought).select("sku")


@query(f"""WITH {SIGNALS_SQL}, pw AS (SELECT query_id, parent_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY MAX(retrieval) DESC, parent_id) AS INT) AS place FROM rs JOIN (SELECT sku, parent_id FROM docs) USING (sku) GROUP BY 1, 2 QUALIFY place <= 10)
SELECT query_id, parent_id, sku, place FROM rs JOIN (SELECT sku, parent_id FROM docs WHERE in_stock AND effective_price < 1200) USING (sku) JOIN pw USING (query_id, parent_id)""")
def filter_to_candidates(spark, sf_dir):
    index, queries, expanded = prepared(spark, sf_dir)
    rows, scored = docs(spark, sf_dir), retrieve.retrieval_score(retrieve.match_terms(queries, index, expanded))
    parents = retrieve.window_parents(scored.join(rows.select("sku", "parent_id").hint("merge"), "sku"), window=10).select("query_id", "parent_id", "place").distinct()
    test = F.col("in_stock") & retrieve.range_filter([("price", None, 1199.999)], {"price": F.col("effective_price")})
    return retrieve.filter_to_candidates(rows, parents, scored, test)


@query("""SELECT p_partkey AS row_ix, k.key AS key, CASE k.key WHEN 'finish' THEN split_part(p_name, ' ', 1) WHEN 'size' THEN CAST(p_size AS VARCHAR) || ' in' ELSE p_type || '; sold by the piece' END AS value,
  CASE k.key WHEN 'pack_2' THEN 'details' ELSE 'title' END AS source FROM part CROSS JOIN (SELECT unnest(['finish', 'size', 'pack_2']) AS key) k""")
def labelled_pairs(spark, sf_dir):
    part, name = table(spark, sf_dir, "part"), F.split("p_name", " ")
    rare = F.when(F.col("p_partkey") % 500 == 0, " RARE: once").otherwise("")
    title = F.concat(F.col("p_name"), F.lit(" FINISH: "), F.get(name, 0), F.lit(" SIZE (IN): "), F.col("p_size").cast("string"), F.lit("  in  BRAND: "), F.col("p_brand"), rare)
    details = F.concat(F.lit("FINISH: other PACK_2: "), F.col("p_type"), F.lit("; sold by the piece NOTE: __"))
    return learn.labelled_pairs(part.select(F.col("p_partkey").alias("row_ix"), title.alias("title"), details.alias("details")), ["title", "details"], taken=["brand"])


@query(f"WITH {DOCS_SQL} SELECT site_id, COUNT(*) AS deleted FROM docs WHERE inventory = 0 GROUP BY 1")
def deleted_count(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return catalogue.deleted_count(rows, rows.where("inventory = 0").select("site_id", "sku"))
