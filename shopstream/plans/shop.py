"""Queries over a shop of two sites and a table of requests: reading, search, facets, rescue. The trade site carries the lines ECONOMY, STANDARD and PROMO of the main site's catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators import analyse, catalogue, discover, entities, labelling, rank, relevance, reports, requests, selectors, signals
from .analytics import CTR, PRODUCT_DAY, product_day
from .registry import Registry
from .views import AS_OF, EVENTS_SQL, VARIANTS_SQL, as_of, shopper_events, table, variants

REGISTRY = Registry()
QUERIES, ORACLE, query = REGISTRY.queries, REGISTRY.oracle, REGISTRY.query

TRADE = ["ECONOMY", "STANDARD", "PROMO"]
COLORS = ["Hunter Green", "Colonial Red", "Primed White", "Brushed Steel", "Western Red Cedar"]
PER_PAGE = 24


def shop_docs(spark, sf_dir):
    """Variant documents of both sites, with their business score."""
    rows = variants(spark, sf_dir)
    rows = rows.unionByName(rows.where(F.col("category_top").isin(TRADE)).withColumn("site_id", F.lit("trade")))
    text = table(spark, sf_dir, "documents").select(F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("sku"), F.get(F.split("text", "\n"), 0).alias("description"))
    rows = catalogue.variant_docs(rows).join(text, "sku", "left")
    color = F.get(F.array(*[F.lit(c) for c in COLORS]), (F.col("size_in") % 5).cast("int"))
    size = F.col("size_in").cast("int").cast("string")
    rows = rows.withColumns({
        "ordinal": F.substring("sku", 2, 20).cast("bigint"), "mpn": F.concat(F.lit("MX-"), F.lpad(F.substring("sku", 2, 20), 5, "0")), "color": color, "variant_title": F.concat_ws(" / ", "finish", color, F.concat(size, F.lit(" in"))),
        "labels": F.concat(F.array(F.when(F.col("size_in") > 25, "use:outdoor").otherwise("use:indoor")), F.when(F.col("sale_price") > 0, F.array(F.lit("collection:clearance"))).otherwise(F.array().cast("array<string>"))),
        "review_score": F.lit(None).cast("double"), "discontinued": F.lit(False),
    })
    ctr = signals.product_ctr(product_day(spark, sf_dir), as_of()).select("site_id", "sku", "ctr", "mean")
    return rank.business_score(rows.join(ctr, ["site_id", "sku"], "left"), as_of())


def shop_index(docs):
    fields = {"title": "title", "variantTitle": "variant_title", "sku": "sku", "mpn": "mpn", "brand": "brand", "attributes": "attribute_text", "description": "description"}
    fields = {name: F.col(c) for name, c in fields.items()} | {"categoryPath": F.array_join("category_path", " ")}
    facets = {"brand": F.col("brand"), "finish": F.col("finish"), "color": F.col("color"), "in_stock": F.col("in_stock").cast("int")}
    return requests.document_index(docs, fields, facets)


def directories(docs):
    """(site_id, category_id, path, products), (site_id, brand, products), (site_id, field, value, products)."""
    levels = docs.select("site_id", "parent_id", "category_path", F.posexplode("category_ids").alias("i", "category_id")).withColumn("path", F.slice("category_path", F.lit(1), F.col("i") + 1))
    categories = levels.groupBy("site_id", "category_id", "path").agg(F.count_distinct("parent_id").alias("products"))
    values = docs.select("site_id", "parent_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("finish", "color")])).alias("f"))
    return categories, catalogue.brand_directory(docs), values.groupBy("site_id", "f.field", "f.value").agg(F.count_distinct("parent_id").alias("products"))


MAP = "map<string,array<string>>"
RANGES = "array<struct<field:string,least:double,most:double>>"


def combinations(docs):
    """For each site and product name what requests are made of."""
    word = F.get(F.filter(F.split(F.lower(F.coalesce("description", F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 6) & ~w.endswith("s")), 0)
    return docs.withColumn("word", word).groupBy("site_id", "title").agg(F.min("finish").alias("x"), F.min("category_leaf").alias("y"), F.min("brand").alias("brand"), F.min("size_in").cast("int").alias("size"), F.min("mpn").alias("mpn"), F.min("category_top").alias("top"), F.min("word").alias("word"), F.min(F.get("category_ids", 1)).alias("category"))


def request_log(docs):
    """A table of requests: names, brands, typos, half a colour, part numbers, sizes, a shopper's own filters, two categories, nonsense, browsing, more than there is, and words of the descriptions."""
    c, lit = F.col, F.lit
    types = ["string", MAP, MAP, RANGES, "string", "string", "string"]
    none = dict.fromkeys(["query", "filters", "labels", "ranges", "category_id", "collection", "sort"], lit(None))
    typo = F.concat(F.substring("y", 1, 1), F.substring("y", lit(3), F.length("y")))
    words = lambda *parts: F.concat_ws(" ", *parts)
    array = lambda *vs: F.array(*[lit(v) for v in vs])
    shopper = {"query": c("y"), "filters": F.create_map(lit("finish"), array("red", "blue"), lit("in_stock"), array("true")), "labels": F.create_map(lit("use"), array("indoor")), "ranges": F.array(F.struct(lit("price").alias("field"), lit(800.0).alias("least"), lit(1000.0).alias("most"))).cast(RANGES), "sort": lit("price_asc")}
    kinds = {
        "plain": {"query": words("x", "y")}, "brand": {"query": words(F.lower("brand"), F.concat("y", lit("s")))}, "typo": {"query": words("x", typo)}, "partial": {"query": words(lit("green"), "y")}, "part": {"query": F.lower("mpn")},
        "family": {"query": F.substring(F.lower("mpn"), 1, 7)}, "size": {"query": words("y", c("size").cast("string"), lit("in"))}, "shopper": shopper, "two": {"query": words(F.lower("top"), "y")}, "nonsense": {"query": words(lit("zzqx"), "y")}, "nothing": {"query": lit("qqzzv wwkkj")},
        "browse": {"category_id": c("category"), "sort": lit("discount")}, "clearance": {"query": c("x"), "collection": lit("clearance"), "sort": lit("best_selling")}, "narrow": {"query": words(F.lower("brand"), lit("green"), "x", "y")}, "word": {"query": F.when(c("word").isNotNull(), words("word", "x"))},
        "colour": {"filters": F.create_map(lit("color"), array("Hunter Green", "Brushed Steel")), "sort": lit("newest")},
    }
    rows = [F.struct(lit(kind).alias("kind"), *[v.cast(t).alias(k) for (k, v), t in zip((none | given).items(), types, strict=True)]) for kind, given in kinds.items()]
    out = combinations(docs).select("site_id", "title", F.explode(F.array(*rows)).alias("r")).select(F.concat_ws("|", "site_id", "r.kind", "title").alias("query_id"), "site_id", "r.*").drop("kind")
    return out.where(F.col("query").isNotNull() | F.col("category_id").isNotNull() | F.col("filters").isNotNull())


def synonym_rules(spark):
    return spark.createDataFrame([("main", 1, "economy", ["bolt"]), ("trade", 2, "zzqx", ["ring"])], "site_id string, rule_id int, trigger string, alternatives array<string>")


def shop(spark, sf_dir):
    """docs, index, vocabulary, directory of categories, names, plans."""
    docs = stored(shop_docs(spark, sf_dir), "shop_docs")
    index = stored(shop_index(docs), "shop_index")
    vocabulary = requests.vocabulary_of(index)
    categories, brands, values = directories(docs)
    names = entities.entity_names(categories, brands, values)
    asked = stored(request_log(docs), "requests")
    read = stored(entities.read_queries(asked.select("site_id", "query"), vocabulary, stored(names, "names")), "read")
    return docs, index, vocabulary, categories, names, requests.planned(asked, read, synonym_rules(spark))


def searched(spark, sf_dir):
    docs, index, vocabulary, categories, _, plans = shop(spark, sf_dir)
    plans = stored(plans, "read_plans")
    unknown = plans.where("sku is null").select("site_id", F.explode("terms").alias("term")).distinct()
    corrections = analyse.suggest_corrections(unknown, vocabulary, by=["site_id"])
    return docs, plans, *requests.search(plans, index, vocabulary, corrections, categories.select("site_id", "category_id", "path"))


def for_requests(answers, rows):
    """Rows of plans as rows of the requests that they answer."""
    return answers.select("query_id", "plan_id").join(rows.withColumnRenamed("query_id", "plan_id"), "plan_id").drop("plan_id")


DOCS_SQL = f"""{EVENTS_SQL}, {VARIANTS_SQL}, {PRODUCT_DAY}, {CTR}, ci AS (SELECT * FROM c WHERE impressions > 0), cm AS (SELECT site_id, SUM(clicks) / CAST(SUM(impressions) AS DOUBLE) AS mean FROM ci GROUP BY 1),
ctr AS (SELECT site_id, sku, mean, (clicks + 50 * mean) / (impressions + 50) AS ctr FROM ci JOIN cm USING (site_id)),
two AS (SELECT * FROM variants UNION ALL SELECT 'trade' AS site_id, * EXCLUDE (site_id) FROM variants WHERE category_top IN ('ECONOMY', 'STANDARD', 'PROMO')),
sd AS (SELECT t.*, CASE WHEN sale_price > 0 THEN sale_price ELSE price END AS effective_price, CASE WHEN sale_price > 0 AND price > 0 AND sale_price < price THEN FLOOR((price - sale_price) / price * 100 + 0.5) ELSE 0.0 END AS discount_pct, CASE WHEN inventory > 0 THEN '1' ELSE '0' END AS in_stock,
  [lower(category_top), lower(category_top) || '/' || lower(category_leaf)] AS category_ids, split_part(d.text, chr(10), 1) AS description, 'MX-' || lpad(substr(t.sku, 2), 5, '0') AS mpn,
  ['Hunter Green', 'Colonial Red', 'Primed White', 'Brushed Steel', 'Western Red Cedar'][CAST(size_in AS INT) % 5 + 1] AS color, CASE WHEN size_in > 25 THEN 'outdoor' ELSE 'indoor' END AS use_, sale_price > 0 AS clearance, epoch(date_added) AS day_,
  FLOOR(10000 * ((3 * CASE WHEN sales_velocity > 0 THEN LEAST(LN(1 + sales_velocity) / LN(1001), 1) ELSE 0 END + 2 * LEAST(GREATEST(margin / 100, 0), 1) + CASE WHEN inventory > 0 THEN LEAST(LN(1 + inventory) / LN(501), 1) ELSE 0 END
    + CASE WHEN date_added IS NULL THEN 0 ELSE POW(0.5, GREATEST((FLOOR(epoch(TIMESTAMP '{AS_OF}')) - FLOOR(epoch(date_added))) / 86400.0, 0) / 180) END + 2 * CASE WHEN ctr.mean > 0 AND ctr.ctr IS NOT NULL THEN LEAST(0.5 * ctr.ctr / ctr.mean, 1) ELSE 0.5 END)
    / 11 * CASE WHEN inventory > 0 THEN 1 ELSE 0.35 END) + 0.5) / 10000 AS business
  FROM two t LEFT JOIN documents d ON t.sku = 'P' || d.doc_id LEFT JOIN ctr ON ctr.site_id = t.site_id AND ctr.sku = t.sku),
fw AS (SELECT site_id, sku, f.field AS field, f.weight AS weight, list_filter(string_split_regex(lower(coalesce(f.text, '')), '[^a-z0-9]+'), lambda t: t <> '') AS toks FROM (SELECT site_id, sku, unnest([
  {{'field': 'title', 'weight': 10, 'text': title}}, {{'field': 'variantTitle', 'weight': 4, 'text': finish || ' / ' || color || ' / ' || CAST(CAST(size_in AS INT) AS VARCHAR) || ' in'}}, {{'field': 'sku', 'weight': 9, 'text': sku}}, {{'field': 'mpn', 'weight': 9, 'text': mpn}},
  {{'field': 'brand', 'weight': 7, 'text': brand}}, {{'field': 'attributes', 'weight': 5, 'text': finish || ' finish:' || finish}}, {{'field': 'description', 'weight': 2, 'text': description}}, {{'field': 'categoryPath', 'weight': 6, 'text': category_top || ' ' || category_leaf}}]) AS f FROM sd)),
posts AS (SELECT site_id, sku, field, weight, len(toks) AS field_words, unnest(toks) AS token, generate_subscripts(toks, 1) AS position FROM fw),
vocab AS (SELECT DISTINCT site_id, token FROM posts WHERE length(token) >= 3),
cats AS (SELECT site_id, category_id, path, COUNT(DISTINCT parent_id) AS products FROM (SELECT site_id, parent_id, unnest(category_ids) AS category_id, unnest([category_top, category_top || ' ' || category_leaf]) AS path FROM sd) GROUP BY 1, 2, 3),
leafcat AS (SELECT site_id, y, MIN(category_id) AS category_id FROM (SELECT site_id, split_part(category_id, '/', 2) AS y, category_id, products, MAX(products) OVER (PARTITION BY site_id, split_part(category_id, '/', 2)) AS m FROM cats WHERE contains(category_id, '/')) WHERE products = m GROUP BY 1, 2),
tops AS (SELECT DISTINCT site_id, lower(category_top) AS top FROM sd),
combo AS (SELECT site_id, title, MIN(finish) AS x, MIN(category_leaf) AS y, MIN(brand) AS brand, CAST(MIN(size_in) AS INT) AS size, MIN(mpn) AS mpn, MIN(category_top) AS top,
  MIN(list_filter(string_split_regex(lower(coalesce(description, '')), '[^a-z0-9]+'), lambda w: length(w) >= 6 AND NOT ends_with(w, 's'))[1]) AS word, MIN(category_ids[2]) AS category FROM sd GROUP BY 1, 2)"""
#: What each kind of request means, written down by kind: the columns of a plan.
COLUMNS = ["kind", "query", "type", "terms", "brand", "finish", "color", "stock", "use_", "category_id", "coll", "least", "most", "inches", "part", "sort"]
TYPO = "substr(y, 1, 1) || substr(y, 3)"
#: small and large are categories of the main site as well, which is how they are read there: as a category that loses against the last.
OWN_X = "CASE WHEN istop THEN NULL ELSE [x] END"
X_TERM = "CASE WHEN istop THEN [x] ELSE [] END"
KINDS = {
    "plain": ("x || ' ' || y", "'entity'", X_TERM, {"finish": OWN_X, "category_id": "cy"}),
    "brand": ("lower(brand) || ' ' || y || 's'", "'entity'", "[]", {"brand": "[brand]", "category_id": "cy"}),
    "typo": (f"x || ' ' || {TYPO}", "'entity'", f"[{TYPO}]", {"finish": OWN_X, "category_id": "CASE WHEN istop THEN x END"}),
    "partial": ("'green ' || y", "'entity'", "[]", {"color": "['Hunter Green']", "category_id": "cy"}),
    "part": ("lower(mpn)", "'sku'", "[lower(mpn)]", {"part": "mpn"}),
    "family": ("lower(substr(mpn, 1, 7))", "'sku'", "[lower(substr(mpn, 1, 7))]", {"part": "substr(mpn, 1, 7)"}),
    "size": ("y || ' ' || size || ' in'", "'dimensional'", "[]", {"category_id": "cy", "inches": "CAST(size AS DOUBLE)"}),
    "shopper": ("y", "'entity'", "[]", {"finish": "['red', 'blue']", "stock": "['1']", "use_": "['indoor']", "category_id": "cy", "least": "800.0", "most": "1000.0", "sort": "'price_asc'"}),
    "two": ("lower(top) || ' ' || y", "'entity'", "CASE WHEN site_id = 'main' AND top = 'ECONOMY' THEN [lower(top), 'bolt'] ELSE [lower(top)] END", {"category_id": "cy"}),
    "nonsense": ("'zzqx ' || y", "'entity'", "CASE WHEN site_id = 'trade' THEN ['zzqx', 'ring'] ELSE ['zzqx'] END", {"category_id": "cy"}),
    "nothing": ("'qqzzv wwkkj'", "'keyword'", "['qqzzv', 'wwkkj']", {}),
    "browse": ("''", "'empty'", "[]", {"category_id": "category", "sort": "'discount'"}),
    "clearance": ("x", "'entity'", "[]", {"finish": OWN_X, "coll": "true", "sort": "'best_selling'"}),
    "narrow": ("lower(brand) || ' green ' || x || ' ' || y", "'entity'", X_TERM, {"brand": "[brand]", "color": "['Hunter Green']", "finish": OWN_X, "category_id": "cy"}),
    "word": ("word || ' ' || x", "'entity'", "[word]", {"finish": OWN_X, "category_id": "CASE WHEN istop THEN x END"}),
    "colour": ("''", "'empty'", "[]", {"color": "['Hunter Green', 'Brushed Steel']", "sort": "'newest'"}),
}
LISTS = {"brand", "finish", "color", "stock", "use_"}
EMPTY = {c: "CAST(NULL AS VARCHAR[])" for c in LISTS} | {"category_id": "CAST(NULL AS VARCHAR)", "coll": "false", "least": "CAST(NULL AS DOUBLE)", "most": "CAST(NULL AS DOUBLE)", "inches": "CAST(NULL AS DOUBLE)", "part": "CAST(NULL AS VARCHAR)", "sort": "'relevance'"}
ROWS_SQL = " UNION ALL ".join(
    f"SELECT site_id || '|{kind}|' || title AS query_id, site_id, '{kind}' AS kind, {q} AS query, {t} AS type, CAST({terms} AS VARCHAR[]) AS terms, " + ", ".join(f"{(EMPTY | given)[c]} AS {c}" for c in COLUMNS[4:]) + " FROM co" + (" WHERE word IS NOT NULL" if kind == "word" else "")
    for kind, (q, t, terms, given) in KINDS.items()
)
#: The category that x alone names, where it does: its own top.
READ_SQL = f"""{DOCS_SQL}, co AS (SELECT combo.*, leafcat.category_id AS cy, tops.top IS NOT NULL AS istop FROM combo JOIN leafcat ON leafcat.site_id = combo.site_id AND leafcat.y = combo.y LEFT JOIN tops ON tops.site_id = combo.site_id AND tops.top = combo.x),
rq0 AS ({ROWS_SQL}),
rq AS (SELECT rq0.*, CASE WHEN kind IN ('shopper', 'colour') THEN NULL ELSE rq0.brand END AS ebrand, CASE kind WHEN 'clearance' THEN CASE WHEN istop THEN x END WHEN 'browse' THEN NULL ELSE rq0.category_id END AS ecat,
  CASE WHEN kind IN ('shopper', 'colour') THEN CAST([] AS VARCHAR[]) ELSE list_filter([CASE WHEN color IS NOT NULL THEN 'color=' || color[1] END, CASE WHEN finish IS NOT NULL THEN 'finish=' || finish[1] END], lambda a: a IS NOT NULL) END AS attrs
  FROM rq0 JOIN co ON co.site_id = rq0.site_id AND co.title = split_part(query_id, '|', 3))"""


@query(f"""WITH {READ_SQL} SELECT query_id, type, array_to_string(terms, '|') AS terms, ebrand[1] AS brand, array_to_string(attrs, '|') AS attributes, ecat AS category, array_to_string(brand, '|') AS by_brand, array_to_string(finish, '|') AS by_finish,
array_to_string(color, '|') AS by_color, category_id, inches, part FROM rq""")
def read_requests(spark, sf_dir):
    """What each request's query means, and the filters it becomes."""
    *_, plans = shop(spark, sf_dir)
    of = lambda kind: F.filter("constraints", lambda c: c["kind"] == kind)
    by = lambda field: F.array_join(F.try_element_at("filters", F.lit(field)), "|")
    return plans.select(
        "query_id", "type", F.array_join("terms", "|").alias("terms"), F.get(of("brand"), 0)["value"].alias("brand"), F.array_join(F.transform(of("attribute"), lambda c: F.concat_ws("=", c["field"], c["value"])), "|").alias("attributes"),
        F.get(of("category"), 0)["value"].alias("category"), by("brand").alias("by_brand"), by("finish").alias("by_finish"), by("color").alias("by_color"), "category_id", F.get("dimensions", 0)["inches"].alias("inches"), F.col("sku").alias("part"),
    )


GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substr({0}, i, 2)))"
EXPAND_SQL = f"""tl AS (SELECT DISTINCT site_id, unnest(terms) AS term FROM rq WHERE part IS NULL),
tb AS (SELECT site_id, term, CASE WHEN regexp_matches(term, '[0-9]') THEN 0 WHEN length(term) >= 8 THEN 2 WHEN length(term) >= 4 THEN 1 ELSE 0 END AS budget FROM tl),
fuzzy AS (SELECT site_id, term, token, levenshtein(term, token) AS distance FROM tb JOIN vocab USING (site_id) WHERE budget > 0 AND abs(length(term) - length(token)) <= budget AND levenshtein(term, token) BETWEEN 1 AND budget
  AND len(list_intersect({GRAMS.format('term')}, {GRAMS.format('token')})) >= greatest(len({GRAMS.format('term')}) - 2 * budget, 1) QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id, term ORDER BY distance, length(token), token) <= 12),
prefix AS (SELECT site_id, term, token, ROW_NUMBER() OVER (PARTITION BY site_id, term ORDER BY token) AS n FROM tl JOIN vocab USING (site_id) WHERE starts_with(token, term) AND token <> term AND length(term) >= 3),
ex0 AS (SELECT site_id, term, term AS token, 0 AS distance, 0 AS kind FROM tl UNION ALL SELECT site_id, term, token, distance, 1 FROM fuzzy UNION ALL SELECT site_id, term, token, 0, CASE WHEN n <= 8 THEN 2 ELSE 3 END FROM prefix),
ex AS (SELECT site_id, term, token, kind, distance FROM ex0 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id, term, token ORDER BY kind, distance) = 1)"""


def match_sql(name: str, requests_: str) -> str:
    """Documents of each request by comparing it with every document of its site: {name} has those that miss one selection at most."""
    miss = ", ".join(f"CASE WHEN r.{c} IS NOT NULL AND NOT list_contains(r.{c}, d.{d}) THEN '{label}' END" for c, d, label in (("brand", "brand", "brand"), ("finish", "finish", "finish"), ("color", "color", "color"), ("stock", "in_stock", "in_stock"), ("use_", "use_", "label:use")))
    return f"""{name}t AS (SELECT query_id, site_id, unnest(list_distinct(terms)) AS term FROM {requests_} WHERE part IS NULL),
{name}n AS (SELECT query_id, sku, COUNT(DISTINCT term) AS found FROM {name}t JOIN ex USING (site_id, term) JOIN posts USING (site_id, token) GROUP BY 1, 2),
{name} AS (SELECT r.query_id, r.sort, r.terms, r.part, d.*, list_filter([{miss}], lambda m: m IS NOT NULL) AS misses FROM {requests_} r JOIN sd d ON d.site_id = r.site_id LEFT JOIN {name}n n ON n.query_id = r.query_id AND n.sku = d.sku
  WHERE (r.part IS NOT NULL OR COALESCE(n.found, 0) = len(list_distinct(r.terms))) AND (r.category_id IS NULL OR list_contains(d.category_ids, r.category_id)) AND (NOT r.coll OR d.clearance) AND (r.least IS NULL OR d.effective_price BETWEEN r.least AND r.most)
  AND (r.inches IS NULL OR abs(d.size_in - r.inches) < 0.03) AND (r.part IS NULL OR starts_with(d.sku, r.part) OR starts_with(d.mpn, r.part)) AND len(misses) <= 1)"""


FALLBACK = "CASE WHEN sort = 'relevance' THEN 'best_selling' ELSE sort END"
NOTHING = "CAST([] AS VARCHAR[]) AS terms, {brand} AS brand, {finish} AS finish, {color} AS color, CAST(NULL AS VARCHAR[]) AS stock, CAST(NULL AS VARCHAR[]) AS use_, {cat} AS category_id, false AS coll, CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most, CAST(NULL AS DOUBLE) AS inches, CAST(NULL AS VARCHAR) AS part"


def attempt_sql(attempt: str, strategy: str, source: str, brand: str = "CAST(NULL AS VARCHAR[])", attrs: str = "CAST([] AS VARCHAR[])", cat: str = "CAST(NULL AS VARCHAR)") -> str:
    value = lambda f: f"(CASE WHEN len(list_filter({attrs}, lambda a: starts_with(a, '{f}='))) > 0 THEN [split_part(list_filter({attrs}, lambda a: starts_with(a, '{f}='))[1], '=', 2)] END)"
    return f"SELECT query_id, site_id, {attempt} AS attempt, '{strategy}' AS strategy, {FALLBACK} AS sort, {NOTHING.format(brand=brand, finish=value('finish'), color=value('color'), cat=cat)} FROM {source}"


ATTEMPTS_SQL = f"""em AS (SELECT * FROM rq WHERE type <> 'empty' AND query_id NOT IN (SELECT query_id FROM p1 WHERE len(misses) = 0)),
near AS (SELECT query_id, category_id FROM (SELECT query_id, cats.category_id, SUM(length(term)) AS letters FROM (SELECT query_id, site_id, unnest(terms) AS term FROM em WHERE ecat IS NULL) JOIN cats USING (site_id) WHERE contains(lower(cats.path), term) GROUP BY 1, 2)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY letters DESC, category_id) = 1),
ef AS (SELECT em.*, unnest(range(1, len(attrs))) AS keep FROM em), eb AS (SELECT * FROM em WHERE ebrand IS NOT NULL AND ecat IS NOT NULL),
en AS (SELECT em.* EXCLUDE (ecat), COALESCE(ecat, near.category_id) AS ecat FROM em LEFT JOIN near USING (query_id) WHERE COALESCE(ecat, near.category_id) IS NOT NULL),
es AS (SELECT em.*, unnest(range(1, len(terms))) AS gone FROM em WHERE part IS NULL),
att AS ({attempt_sql("200", "drop_entity", "em WHERE len(terms) > 0 AND (ebrand IS NOT NULL OR ecat IS NOT NULL OR len(attrs) > 0)", "ebrand", "attrs", "ecat")}
UNION ALL {attempt_sql("220 - keep", "drop_entity", "ef", "ebrand", "attrs[1:keep]", "ecat")} UNION ALL {attempt_sql("230", "drop_entity", "eb", cat="ecat")} UNION ALL {attempt_sql("231", "drop_entity", "eb", "ebrand")}
UNION ALL SELECT query_id, site_id, 300 + gone, 'relax_query', sort, list_transform(list_sort(list_transform(list_sort(list_transform(range(1, len(terms) + 1), lambda i: {{'n': length(terms[i]), 'i': i}}))[gone + 1:], lambda s: s.i)), lambda i: terms[i]), brand, finish, color, stock, use_, category_id, coll, least, most, inches, part FROM es
UNION ALL {attempt_sql("400", "category_fallback", "en", cat="ecat")} UNION ALL {attempt_sql("500", "best_sellers", "em")}),
atm AS (SELECT * EXCLUDE (query_id), query_id || '#' || attempt AS query_id FROM att)"""
#: Tables that several others read: DuckDB is told to compute them once.
SHARED = ["sd", "posts", "vocab", "ex", "p1", "p2", "rq2", "pt", "p", "m", "ph", "rt", "be", "pl", "fe"]
VALUE = "COALESCE(CASE sort WHEN 'best_selling' THEN sales_velocity WHEN 'newest' THEN day_ WHEN 'price_asc' THEN -effective_price WHEN 'discount' THEN discount_pct ELSE CASE WHEN len(terms) > 0 AND part IS NULL THEN CAST(rt.retrieval AS DOUBLE) ELSE sales_velocity END END, '-infinity'::DOUBLE)"
PLAN_COLUMNS = "query_id, site_id, sort, terms, brand, finish, color, stock, use_, category_id, coll, least, most, inches, part"
SEARCH_SQL = f"""{READ_SQL}, {EXPAND_SQL}, {match_sql("p1", "rq")}, {ATTEMPTS_SQL}, {match_sql("p2", "atm")},
win_ AS (SELECT split_part(query_id, '#', 1) AS query_id, MIN(CAST(split_part(query_id, '#', 2) AS INT)) AS attempt FROM (SELECT DISTINCT query_id FROM p2 WHERE len(misses) = 0) GROUP BY 1),
rq2 AS (SELECT {PLAN_COLUMNS}, CAST(NULL AS VARCHAR) AS strategy FROM rq WHERE query_id NOT IN (SELECT query_id FROM win_) UNION ALL SELECT {PLAN_COLUMNS}, strategy FROM att JOIN win_ USING (query_id, attempt)),
{match_sql("p", "rq2")}, m AS (SELECT * FROM p WHERE len(misses) = 0),
ph AS (SELECT DISTINCT m.query_id, m.sku, t.term, ex.token, ex.kind, ex.distance FROM m JOIN pt t ON t.query_id = m.query_id JOIN ex ON ex.site_id = t.site_id AND ex.term = t.term JOIN posts o ON o.site_id = t.site_id AND o.sku = m.sku AND o.token = ex.token),
rt AS (SELECT query_id, sku, SUM(weight) AS retrieval FROM (SELECT DISTINCT ph.query_id, ph.sku, ph.term, o.field, o.weight FROM ph JOIN rq2 USING (query_id) JOIN posts o ON o.site_id = rq2.site_id AND o.sku = ph.sku AND o.token = ph.token) GROUP BY 1, 2),
be AS (SELECT * FROM ph WHERE kind < 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, sku, term ORDER BY distance, kind, CASE WHEN kind = 1 THEN length(token) ELSE 0 END, token) = 1),
bw AS (SELECT query_id, sku, SUM(distance) AS typos, COUNT(*) AS words, BOOL_OR(kind = 2) AS prefixed FROM be GROUP BY 1, 2),
nt AS (SELECT query_id, COUNT(*) AS n_terms FROM pt GROUP BY 1),
pl AS (SELECT be.query_id, rq2.site_id, be.sku, o.field, o.weight, o.field_words, be.term, MIN(o.position) AS pos_ FROM be JOIN rq2 USING (query_id) JOIN posts o ON o.site_id = rq2.site_id AND o.sku = be.sku AND o.token = be.token GROUP BY ALL),
fe AS (SELECT pt.query_id, o.sku, o.field, COUNT(DISTINCT pt.term) AS own FROM pt JOIN posts o ON o.site_id = pt.site_id AND o.token = pt.term GROUP BY 1, 2, 3),
fs AS (SELECT query_id, sku, field, weight, MAX(pos_) - MIN(pos_) - (COUNT(*) - 1) AS spread, CASE WHEN COALESCE(ANY_VALUE(own), 0) = ANY_VALUE(n_terms) AND ANY_VALUE(field_words) = ANY_VALUE(n_terms) THEN 3 WHEN COALESCE(ANY_VALUE(own), 0) = ANY_VALUE(n_terms) AND ANY_VALUE(typos) = 0 THEN 2 WHEN ANY_VALUE(typos) > 0 THEN 0 WHEN ANY_VALUE(prefixed) THEN 1 ELSE 2 END AS exact
  FROM pl JOIN bw USING (query_id, sku) JOIN nt USING (query_id) LEFT JOIN fe USING (query_id, sku, field) GROUP BY 1, 2, 3, 4),
bf AS (SELECT * FROM fs QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, sku ORDER BY weight DESC, spread, exact DESC) = 1),
sc AS (SELECT m.*, COALESCE(bw.typos, 0) AS typos, COALESCE(bw.words, 0) AS words, COALESCE(bf.weight, 0) AS bfw, COALESCE(bf.spread, 0) AS spread, COALESCE(bf.exact, 0) AS exact, {VALUE} AS value
  FROM m LEFT JOIN rt USING (query_id, sku) LEFT JOIN bw USING (query_id, sku) LEFT JOIN bf USING (query_id, sku)),
pw AS (SELECT query_id, parent_id, COUNT(*) AS matching, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY MAX(value) DESC, parent_id) AS place FROM sc GROUP BY 1, 2),
wr AS (SELECT sc.*, matching, place, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY place, value DESC, sku) AS n FROM sc JOIN pw USING (query_id, parent_id) WHERE place <= 240 QUALIFY n <= 1920),
rk AS (SELECT *, CASE WHEN sort = 'relevance' THEN ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY typos, words DESC, bfw DESC, spread, exact DESC, business DESC, value DESC, sku) ELSE n END AS rank FROM wr),
ik AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS k FROM rk),
cards AS (SELECT query_id, parent_id, MIN(sku) FILTER (k = 1) AS sku, COALESCE(string_agg(sku, '|' ORDER BY rank) FILTER (k BETWEEN 2 AND 9), '') AS siblings, ANY_VALUE(matching) AS matching, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY MIN(rank)) AS card FROM ik GROUP BY 1, 2),
tot AS (SELECT query_id, COUNT(DISTINCT parent_id) AS products, COUNT(*) AS variants, MIN(effective_price) AS least, MAX(effective_price) AS most FROM m GROUP BY 1)"""

for _name in SHARED:
    SEARCH_SQL = SEARCH_SQL.replace(f" {_name} AS (SELECT", f" {_name} AS MATERIALIZED (SELECT", 1).replace(f"\n{_name} AS (SELECT", f"\n{_name} AS MATERIALIZED (SELECT", 1)


def rule_actions(spark, plans):
    """Query rules of the shop as actions on the requests they hold for: searches for green things show red rings of the economy line second, hide small gizmos and put blue ones last, at both sites."""
    actions = spark.createDataFrame([("red ring/ECONOMY", "pin", 2, 1), ("small gizmo/ECONOMY", "hide", None, 2), ("blue gizmo/ECONOMY", "bury", None, 3)], "parent_id string, action string, slot int, ordinal int")
    return plans.where(F.col("query").startswith("green ")).select("query_id", "site_id").join(F.broadcast(actions), how="cross")


RULES_SQL = """ra AS (SELECT query_id, site_id FROM rq WHERE kind = 'partial'),
pin AS (SELECT ra.query_id, 'red ring/ECONOMY' AS parent_id, 'P' || MIN(CAST(substr(sd.sku, 2) AS BIGINT)) AS sku FROM ra JOIN sd ON sd.site_id = ra.site_id AND sd.parent_id = 'red ring/ECONOMY' GROUP BY 1, 2),
left_ AS (SELECT cards.*, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY CASE WHEN parent_id = 'blue gizmo/ECONOMY' THEN 1 ELSE 0 END, card) AS k FROM cards SEMI JOIN ra USING (query_id) WHERE parent_id <> 'small gizmo/ECONOMY' AND NOT (parent_id = 'red ring/ECONOMY' AND query_id IN (SELECT query_id FROM pin))),
moved AS (SELECT query_id, parent_id, sku, siblings, matching, CASE WHEN k >= 2 AND query_id IN (SELECT query_id FROM pin) THEN k + 1 ELSE k END AS pos_, false AS pinned FROM left_
  UNION ALL SELECT pin.query_id, pin.parent_id, COALESCE(cards.sku, pin.sku), COALESCE(cards.siblings, ''), COALESCE(cards.matching, 0), 2, true FROM pin LEFT JOIN cards USING (query_id, parent_id)),
fin AS (SELECT query_id, parent_id, sku, siblings, matching, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY pos_) AS card, pinned FROM moved UNION ALL SELECT query_id, parent_id, sku, siblings, matching, card, false FROM cards ANTI JOIN ra USING (query_id)),
shift AS (SELECT query_id, COUNT(*) AS after FROM fin GROUP BY 1), ranked_ AS (SELECT query_id, COUNT(*) AS before FROM cards GROUP BY 1)"""


@query(f"""WITH {SEARCH_SQL}, {RULES_SQL} SELECT query_id, CAST(card AS INT) AS card, parent_id, sku, siblings, CAST(matching AS BIGINT) AS matching, pinned, strategy, products + after - before AS products, CAST(GREATEST(CEIL(LEAST(products + after - before, 240) / 24.0), 1) AS INT) AS pages
FROM fin JOIN rq2 USING (query_id) JOIN tot USING (query_id) JOIN shift USING (query_id) JOIN ranked_ USING (query_id) WHERE card <= 24""")
def search_requests(spark, sf_dir):
    """R5 over the whole request table: first pages after rescue and query rules."""
    docs, asked, answers, plans, found, parents = searched(spark, sf_dir)
    cards = stored(requests.ranked_cards(found, parents, plans), "cards")
    actions = stored(rule_actions(spark, asked), "actions")
    ruled = actions.select("query_id").distinct()
    before = stored(for_requests(answers.join(ruled, "query_id", "left_semi"), cards), "ruled_cards")
    after = stored(requests.merchandised(before, actions, docs.select("site_id", "sku", "parent_id", "ordinal")), "merchandised")
    others = for_requests(answers.join(ruled, "query_id", "left_anti"), cards.where(F.col("card") <= PER_PAGE)).withColumn("pinned", F.lit(False))
    more = after.groupBy("query_id").agg(F.count("*").alias("n")).unionByName(before.groupBy("query_id").agg((-F.count("*")).alias("n"))).groupBy("query_id").agg(F.sum("n").alias("more"))
    products = F.col("products") + F.coalesce("more", F.lit(0))
    total = for_requests(answers, requests.totals(parents)).join(more, "query_id", "left").select("query_id", products.alias("products"))
    page = after.where(F.col("card") <= PER_PAGE).unionByName(others).join(answers.select("query_id", "strategy"), "query_id").join(total, "query_id")
    return page.select("query_id", "card", "parent_id", "sku", F.array_join("siblings", "|").alias("siblings"), F.col("matching").cast("bigint").alias("matching"), "pinned", "strategy", "products", requests.page_numbers(F.col("products"), PER_PAGE).alias("pages"))


FACETS_SQL = """fv AS (SELECT query_id, site_id, parent_id, effective_price, misses, unnest([{'facet': 'brand', 'value': brand}, {'facet': 'finish', 'value': finish}, {'facet': 'color', 'value': color}, {'facet': 'in_stock', 'value': in_stock}, {'facet': 'label:use', 'value': use_}, {'facet': 'label:collection', 'value': CASE WHEN clearance THEN 'clearance' END}]) AS f FROM p),
fc AS (SELECT query_id, f.facet AS facet, f.value AS value, COUNT(DISTINCT parent_id) AS products, CAST(ROW_NUMBER() OVER (PARTITION BY query_id, f.facet ORDER BY COUNT(DISTINCT parent_id) DESC, f.value) AS INT) AS place FROM fv WHERE f.value IS NOT NULL AND (len(misses) = 0 OR misses[1] = f.facet) GROUP BY 1, 2, 3)"""


@query(f"WITH {SEARCH_SQL}, {FACETS_SQL} SELECT * FROM fc")
def request_facets(spark, sf_dir):
    """A16 and A17 for every request of the table, each with selections of its own."""
    _, _, answers, _, _, parents = searched(spark, sf_dir)
    return for_requests(answers, requests.request_facets(parents))


CONFIG = [("brand", "Brand", "checkbox", 1, "count", 8, []), ("finish", "Finish", "checkbox", 2, "alpha", 3, []), ("color", "Colour", "swatch", 3, "custom", 0, ["Primed White", "Hunter Green"]), ("price", "Price", "slider", 4, "count", 0, []), ("in_stock", "Availability", "checkbox", 5, "count", 0, []), ("label:use", "Use", "checkbox", 6, "alpha", 1, [])]


@query(f"""WITH {SEARCH_SQL}, {FACETS_SQL}, cfg AS (SELECT * FROM (VALUES (1, 'brand', 'Brand', 'checkbox', 'count', 8), (2, 'finish', 'Finish', 'checkbox', 'alpha', 3), (3, 'color', 'Colour', 'swatch', 'custom', 0), (5, 'in_stock', 'Availability', 'checkbox', 'count', 0), (6, 'label:use', 'Use', 'checkbox', 'own', 0)) t(position, facet, label, display, sort_by, n)),
fl AS (SELECT position, facet, label, display, n, fc.query_id, value, CASE WHEN facet = 'in_stock' THEN CASE value WHEN '1' THEN 'In Stock' ELSE 'Out of Stock' END ELSE value END AS value_label, products, COALESCE(list_contains(CASE facet WHEN 'brand' THEN rq2.brand WHEN 'finish' THEN rq2.finish WHEN 'color' THEN rq2.color WHEN 'in_stock' THEN list_transform(rq2.stock, lambda s: 'true') ELSE rq2.use_ END, value), false) AS chosen,
  CAST(ROW_NUMBER() OVER (PARTITION BY fc.query_id, facet ORDER BY CASE WHEN sort_by = 'custom' THEN CASE value WHEN 'Primed White' THEN 1 WHEN 'Hunter Green' THEN 2 ELSE 999 END ELSE 0 END, CASE WHEN sort_by = 'alpha' THEN value END, place) AS INT) AS place FROM cfg JOIN fc USING (facet) JOIN rq2 USING (query_id))
SELECT query_id, position, facet, label, display, place, value, value_label, products, chosen, CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most FROM fl WHERE n = 0 OR place <= n OR chosen
UNION ALL SELECT query_id, 4, 'price', 'Price', 'slider', NULL, NULL, NULL, NULL, NULL, least, most FROM tot""")
def facet_panels(spark, sf_dir):
    """R9 for every request: sorted, cut and labelled as each site configures it."""
    _, _, answers, plans, _, parents = searched(spark, sf_dir)
    config = spark.createDataFrame([(s, *c) for s in ("main", "trade") for c in CONFIG], "site_id string, facet string, label string, display string, position int, sort_by string, truncate_at int, custom array<string>")
    return for_requests(answers, requests.facet_panels(requests.request_facets(parents), requests.totals(parents), plans, config))


@query(f"""WITH {READ_SQL}, {EXPAND_SQL}, {match_sql("p", "rq")}, dl AS (SELECT site_id, sku, SUM(len(toks)) AS length FROM fw GROUP BY 1, 2), sn AS (SELECT site_id, COUNT(*) AS docs, AVG(length) AS mean FROM dl GROUP BY 1),
tf AS (SELECT site_id, sku, token, SUM(weight) AS f FROM posts GROUP BY 1, 2, 3), df AS (SELECT site_id, token, COUNT(*) AS n FROM tf GROUP BY 1, 2),
im AS (SELECT site_id, sku, token, GREATEST(LN((docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) AS impact FROM tf JOIN df USING (site_id, token) JOIN dl USING (site_id, sku) JOIN sn USING (site_id))
SELECT p.query_id, p.sku, ROUND(SUM(impact), 6) AS bm25 FROM p JOIN pt t ON t.query_id = p.query_id JOIN ex ON ex.site_id = t.site_id AND ex.term = t.term JOIN im ON im.site_id = t.site_id AND im.sku = p.sku AND im.token = ex.token WHERE len(p.misses) = 0 GROUP BY 1, 2""")
def bm25_scores(spark, sf_dir):
    """R2's other form: BM25 of what the requests' terms find, from impacts stored with the postings."""
    _, index, vocabulary, *_, plans = shop(spark, sf_dir)
    answers, plans, found, _ = requests.search(plans, index, vocabulary)
    kept = stored(requests.impacts(index), "impacts")
    return for_requests(answers, requests.bm25_scores(found, plans, kept).withColumn("bm25", F.round("bm25", 6)))


def typed(docs):
    """What shoppers have typed so far: nothing, one to three letters of a title, its second word, all of it."""
    t = F.col("title")
    return docs.select("site_id", F.explode(F.array(F.lit(""), F.substring(t, 1, 1), F.substring(t, 2, 2), F.substring(t, 1, 3), F.get(F.split(t, " "), 1), t, F.lower("brand"))).alias("prefix")).distinct()


def box_sql(source: str, texts: str, text: str, order: str, n: int, value: str, detail: str) -> str:
    return f"SELECT site_id, prefix, '{source}' AS source, CAST(ROW_NUMBER() OVER (PARTITION BY site_id, prefix ORDER BY {order}) AS INT) AS place, CAST({value} AS VARCHAR) AS value, CAST({detail} AS VARCHAR) AS detail FROM px JOIN {texts} USING (site_id) WHERE prefix <> '' AND contains({text}, prefix) AND {text} <> prefix QUALIFY place <= {n}"


@query(f"""WITH {DOCS_SQL}, px AS (SELECT DISTINCT site_id, unnest(['', substr(title, 1, 1), substr(title, 2, 2), substr(title, 1, 3), split_part(title, ' ', 2), title, lower(brand)]) AS prefix FROM sd),
pop AS (SELECT site_id, normalised_query AS query, COUNT(*) AS searches FROM shopper_events WHERE type = 'search' AND result_count > 0 AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY COUNT(*) DESC, normalised_query) <= 200
  UNION ALL SELECT site_id, title, COUNT(*) FROM sd WHERE site_id = 'trade' GROUP BY 1, 2),
cl AS (SELECT *, lower(path) AS low, replace(path, ' ', ' / ') AS label FROM cats), br AS (SELECT site_id, brand, lower(brand) AS low, COUNT(DISTINCT parent_id) AS products FROM sd GROUP BY 1, 2, 3),
rd AS (SELECT site_id, prefix FROM px WHERE prefix = 'ring')
{box_sql("query", "pop", "query", "CASE WHEN starts_with(query, prefix) THEN 0 ELSE 1 END, searches DESC, query", 6, "query", "searches")}
UNION ALL {box_sql("category", "cl", "low", "products DESC, category_id", 4, "category_id", "label").replace("AND low <> prefix", "")} UNION ALL {box_sql("brand", "br", "low", "products DESC, brand", 3, "brand", "products").replace("AND low <> prefix", "")}
UNION ALL SELECT site_id, prefix, 'redirect', 1, '/rings', NULL FROM rd
UNION ALL SELECT site_id, '', 'trending', CAST(ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY searches DESC, query) AS INT) AS place, query, CAST(searches AS VARCHAR) FROM pop QUALIFY place <= 6
UNION ALL SELECT site_id, '', 'category', CAST(ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY category_id) AS INT) AS place, category_id, label FROM cl WHERE contains(category_id, '/') QUALIFY place <= 6""")
def complete(spark, sf_dir):
    """R14 for every prefix of both sites, one letter and nothing included. The trade site has no log of its own; its titles stand for popular queries."""
    docs = stored(shop_docs(spark, sf_dir), "shop_docs")
    popular = reports.popular_queries(shopper_events(spark, sf_dir), as_of()).select("site_id", F.col("normalised_query").alias("query"), "searches")
    popular = popular.unionByName(docs.where("site_id = 'trade'").groupBy("site_id", F.col("title").alias("query")).agg(F.count("*").alias("searches")))
    categories, brands, _ = directories(docs)
    prefixes = typed(docs)
    redirects = prefixes.where("prefix = 'ring'").withColumn("target", F.lit("/rings"))
    return discover.complete(prefixes, popular, categories, brands, redirects=redirects)


#: Checks of the judged suite: each holds in one of its cases and fails in another.
CHECKS = ["none", "expect", "brand", "least", "many", "forbid", "allowed", "few", "enough", "unread", "read", "rescued", "outright", "attr", "title", "any", "stock", "absent"]


def suite(docs):
    """For each site and leaf a case of every check, its hits (the first ten documents of the leaf by SKU) and its answer."""
    c, lit = F.col, F.lit
    leaf = F.element_at("category_ids", -1)
    rows = docs.select("site_id", "sku", "ordinal", "parent_id", leaf.alias("leaf"), "category_leaf", "brand", "finish")
    leaves = rows.groupBy("site_id", "leaf", "category_leaf").agg(F.count_distinct("parent_id").alias("total"), F.min("brand").alias("brand"), F.min("finish").alias("finish"))
    j = lambda **given: F.struct(*[(given[k] if k in given else lit(None)).alias(k) for k in ("category", "brand", "in_stock", "title", "attrs", "any_of")]).cast(relevance.JUDGMENT)
    flat = lambda **given: F.struct(*[(given[k] if k in given else lit(None)).alias(k) for k in ("category", "brand", "in_stock", "title", "attrs")])
    own, other = j(category=c("category_leaf")), j(category=lit("zzz"))
    given = {
        "none": {}, "expect": {"expect": own}, "brand": {"expect": j(brand=c("brand")), "partial": lit(True)}, "least": {"at_least": F.struct(lit(1).alias("n"), own.alias("of"))}, "many": {"at_least": F.struct(lit(11).alias("n"), own.alias("of"))},
        "forbid": {"forbid": own}, "allowed": {"forbid": other}, "few": {"min_results": lit(10**6)}, "enough": {"min_results": lit(1)}, "unread": {"understands": F.array(lit("Nowhere"))}, "read": {"understands": F.array(F.upper("category_leaf"))},
        "rescued": {"rescued": lit(True)}, "outright": {"rescued": lit(False)}, "attr": {"expect": j(attrs=F.create_map(lit("finish"), F.array(F.upper("finish"), lit("red")))), "partial": lit(True)}, "title": {"expect": j(title=F.concat(lit("^[a-z]+ "), F.upper("category_leaf"))), "partial": lit(True)},
        "any": {"expect": j(any_of=F.array(flat(brand=lit("no such")), flat(category=c("category_leaf"))))}, "stock": {"expect": j(in_stock=lit(True), category=c("category_leaf"))}, "absent": {"expect": other},
    }
    types = {"expect": relevance.JUDGMENT, "at_least": f"struct<n:int,of:{relevance.JUDGMENT}>", "forbid": relevance.JUDGMENT, "partial": "boolean", "min_results": "bigint", "understands": "array<string>", "rescued": "boolean"}
    structs = [F.struct(lit(name).alias("check"), *[g.get(k, lit(None)).cast(t).alias(k) for k, t in types.items()]) for name, g in given.items()]
    cases = leaves.select("*", F.explode(F.array(*structs)).alias("x")).select(F.concat_ws("|", "site_id", "leaf", "x.check").alias("case_id"), "site_id", "leaf", "category_leaf", "total", "x.*", lit(None).cast("int").alias("k"))
    from pyspark.sql.window import Window as W

    ten = rows.withColumn("card", F.row_number().over(W.partitionBy("site_id", "leaf").orderBy("ordinal"))).where("card <= 12").select("site_id", "leaf", "card", "sku")
    hits = cases.select("case_id", "site_id", "leaf").join(ten, ["site_id", "leaf"]).select("case_id", "card", "sku")
    answers = cases.select("case_id", "total", F.array("category_leaf").alias("understood"), lit(None).cast("string").alias("strategy"))
    judged_docs = docs.select("site_id", "sku", "parent_id", "category_path", "brand", "in_stock", F.concat_ws(" ", "title", "variant_title").alias("title"), "attrs")
    return cases.drop("check", "leaf", "category_leaf", "total"), hits, answers, judged_docs


@query(f"""WITH {DOCS_SQL}, lf AS (SELECT site_id, category_ids[2] AS leaf, category_leaf, COUNT(DISTINCT parent_id) AS total, MIN(brand) AS brand0, MIN(finish) AS finish0 FROM sd GROUP BY 1, 2, 3),
tn AS (SELECT site_id, category_ids[2] AS leaf, brand, finish, in_stock FROM sd QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id, category_ids[2] ORDER BY CAST(substr(sku, 2) AS BIGINT)) <= 10),
ag AS (SELECT lf.*, COUNT(*) AS judged, COUNT(*) FILTER (tn.brand = brand0) AS b, COUNT(*) FILTER (finish IN (finish0, 'red')) AS f, COUNT(*) FILTER (in_stock = '1') AS s FROM lf JOIN tn USING (site_id, leaf) GROUP BY ALL),
wide AS (SELECT site_id, category_leaf, COUNT(DISTINCT parent_id) AS n, COUNT(DISTINCT parent_id) FILTER (in_stock = '1') AS stocked FROM sd GROUP BY 1, 2),
ck AS (SELECT ag.*, n, stocked, unnest({CHECKS}) AS ck FROM ag JOIN wide USING (site_id, category_leaf)),
m AS (SELECT *, CASE ck WHEN 'brand' THEN b WHEN 'attr' THEN f WHEN 'stock' THEN s WHEN 'absent' THEN 0 ELSE judged END AS matched, CASE WHEN ck IN ('expect', 'any') THEN n WHEN ck = 'stock' THEN NULLIF(stocked, 0) END AS expected FROM ck),
r AS (SELECT *, list_filter([CASE WHEN matched < judged THEN 'expect' END, CASE WHEN ck = 'many' THEN 'at_least' END, CASE WHEN ck = 'forbid' THEN 'forbid' END, CASE WHEN ck = 'few' THEN 'min_results' END, CASE WHEN ck = 'unread' THEN 'understands' END,
  CASE WHEN ck = 'rescued' THEN 'rescued' END, CASE WHEN LEAST(1.0, total / CAST(expected AS DOUBLE)) < 0.999 THEN 'coverage' END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT site_id || '|' || leaf || '|' || ck AS case_id, ROUND(matched / CAST(judged AS DOUBLE), 3) AS precision, CASE WHEN expected IS NOT NULL THEN ROUND(LEAST(1.0, total / CAST(expected AS DOUBLE)), 3) END AS coverage, CASE WHEN expected IS NOT NULL THEN ROUND(LEAST(1.0, expected / CAST(GREATEST(total, expected) AS DOUBLE)), 3) END AS focus,
  expected, matched, judged, total, len(failed) = 0 AS passed, array_to_string(failed, '|') AS failures FROM r""")
def judge_cases(spark, sf_dir):
    """D13 with every check failing and passing, at both sites."""
    docs = stored(shop_docs(spark, sf_dir), "shop_docs")
    return relevance.judge_cases(*suite(docs)).withColumn("failures", F.array_join("failures", "|"))


@query(f"""WITH {DOCS_SQL}, ru AS (SELECT DISTINCT site_id, category_leaf AS leaf, brand FROM sd), vr AS (SELECT sd.*, ru.leaf, ru.brand AS b, (sd.brand = ru.brand OR finish = 'red') AND inventory < 300 AS alone FROM sd JOIN ru ON ru.site_id = sd.site_id AND ru.leaf = sd.category_leaf),
wh AS (SELECT site_id, parent_id, leaf, b FROM vr GROUP BY 1, 2, 3, 4 HAVING BOOL_OR(brand = b OR finish = 'red') AND NOT BOOL_OR(inventory >= 300)),
ex AS (SELECT site_id, parent_id FROM sd GROUP BY 1, 2 HAVING MIN(size_in) > 40), inc AS (SELECT site_id, parent_id FROM sd GROUP BY 1, 2 HAVING MAX(size_in) < 10)
SELECT site_id, sku, parent_id, 'shelf:' || leaf || ':' || b AS label FROM vr SEMI JOIN wh USING (site_id, parent_id, leaf, b) ANTI JOIN ex USING (site_id, parent_id) WHERE alone
UNION SELECT sd.site_id, sku, sd.parent_id, 'shelf:' || ru.leaf || ':' || ru.brand FROM sd SEMI JOIN inc ON inc.site_id = sd.site_id AND inc.parent_id = sd.parent_id JOIN ru ON ru.site_id = sd.site_id AND ru.leaf = sd.category_leaf
UNION SELECT site_id, sku, parent_id, 'rest' FROM sd WHERE NOT contains(lower(title), 'ring') AND parent_id NOT IN (SELECT parent_id FROM sd s2 WHERE s2.site_id = sd.site_id GROUP BY 1 HAVING MIN(s2.price) >= 950)""")
def apply_label_rules(spark, sf_dir):
    """I10 with a rule for each leaf and brand of each site, and one made of exclusions alone."""
    docs = stored(shop_docs(spark, sf_dir), "shop_docs")
    condition = lambda field, op, value: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), value.alias("value"))
    leaf_is, brand_is = condition("category_path", "equals", F.col("category_leaf")), condition("variant.brand", "equals", F.col("brand"))
    red, stocked = condition("variant.attrs.finish", "in", F.array(F.lit("Red "), F.lit("crimson"))), condition("variant.inventory", "gte", F.lit(300))
    group = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(p) for p in parts]), F.lit("]"))
    selector = F.concat(F.lit('{"all":['), F.to_json(leaf_is), F.lit(',{"any":'), group(brand_is, red), F.lit('},{"none":'), group(stocked), F.lit("}]}"))
    label = F.concat_ws(":", F.lit("shelf"), "category_leaf", "brand")
    rules = docs.select("site_id", label.alias("label"), selector.alias("selector")).distinct()
    rest = docs.select("site_id").distinct().select("site_id", F.lit("rest").alias("label"), F.lit('{"none":[{"field":"title","op":"contains","value":"ring"},{"field":"minListPrice","op":"gte","value":"950"}]}').alias("selector"))
    sizes = docs.groupBy("site_id", "parent_id", "category_leaf").agg(F.min("size_in").alias("least"), F.max("size_in").alias("most"), F.min("price").alias("price"))
    leaves = docs.select("site_id", "category_leaf", "brand").distinct()
    members = sizes.where("least > 40 or most < 10").join(leaves, ["site_id", "category_leaf"]).select("site_id", label.alias("label"), "parent_id", F.when(F.col("least") > 40, "exclude").otherwise("include").alias("mode"))
    products = selectors.products(docs).join(sizes.select("site_id", "parent_id", F.col("price").alias("minListPrice")), ["site_id", "parent_id"])
    return labelling.apply_label_rules(products, rules.unionByName(rest), members)
