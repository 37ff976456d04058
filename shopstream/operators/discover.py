"""Entities in queries (Q3-Q6), browsing (R6), autocomplete (R14), rescue of empty results (R8), similar products (C1), feed housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.measure import quantise
from ..functions.text import edit_distance, name_keys, normalise, typo_budget

#: Precedence of entity fields, and how many of each a query may have.
PRECEDENCE = {"brand": 0, "category": 1, "attribute": 2}
MOST = {"brand": 1, "category": 1, "attribute": 3}


def entity_index(directory: DataFrame, values: DataFrame) -> DataFrame:
    """(key, field, value, n): the names under which brands, categories and attribute values are found. Of several claims to a key the field that goes first, then the one with most products. directory: (field, value, products) of brands and categories; values: (field, value, products) of attributes. Values of digits alone are left out."""
    rows = directory.unionByName(values).where(~F.col("value").rlike(r"^[\d\s./-]+$"))
    kind = F.when(F.col("field").isin("brand", "category"), F.col("field")).otherwise("attribute")
    place = F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), kind)
    rows = rows.select("field", "value", "products", place.alias("place"), F.explode(name_keys(F.col("value"))).alias("key"))
    best = F.min(F.struct("place", (-F.col("products")).alias("less"), "field", "value")).alias("b")
    return rows.groupBy("key").agg(best).select("key", "b.field", "b.value", F.size(F.split("key", " ")).alias("n"))


def lift_entities(queries: DataFrame, index: DataFrame, longest: int = 4) -> DataFrame:
    """(query_id, entities: array<struct<field, value>>, rest: array<string>). queries: (query_id, terms).

    Spans of up to `longest` terms are looked up; the widest go first, then from the left, each term once;
    a field has one value, and there are at most three attributes.
    """
    n = F.size("terms")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct(i.alias("at"), k.alias("k"), F.array_join(F.slice("terms", i, k), " ").alias("key")))))
    rows = queries.where(n > 0).select("query_id", F.explode(F.filter(spans, lambda s: s["at"] + s["k"] - 1 <= n)).alias("s")).select("query_id", "s.at", "s.k", "s.key").join(index, "key")
    found = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("narrow"), "at", "k", "field", "value"))).alias("hits"))  # spans of one query
    none = F.array().cast("array<struct<at:int,k:int,field:string,value:string>>")
    attribute = lambda f: ~f.isin("brand", "category")

    def take(s: Column, h: Column) -> Column:
        apart = ~F.exists(s, lambda t: (t["at"] < h["at"] + h["k"]) & (h["at"] < t["at"] + t["k"]))
        new = ~F.exists(s, lambda t: t["field"] == h["field"])
        room = ~attribute(h["field"]) | (F.size(F.filter(s, lambda t: attribute(t["field"]))) < MOST["attribute"])
        return F.when(apart & new & room, F.concat(s, F.array(F.struct(h["at"].alias("at"), h["k"].alias("k"), h["field"].alias("field"), h["value"].alias("value"))))).otherwise(s)

    found = found.withColumn("taken", F.aggregate("hits", none, take))
    rows = queries.join(found.drop("hits"), "query_id", "left").withColumn("taken", F.coalesce("taken", none))
    rest = F.filter("terms", lambda t, i: ~F.exists("taken", lambda s: (s["at"] <= i + 1) & (i + 1 < s["at"] + s["k"])))
    return rows.select("query_id", F.transform(F.array_sort("taken"), lambda t: F.struct(t["field"].alias("field"), t["value"].alias("value"))).alias("entities"), rest.alias("rest"))


def constraints_to_filters(lifted: DataFrame) -> DataFrame:
    """(query_id, filters: map<string,string>, category): entities as filters; the category apart."""
    own = F.filter("entities", lambda e: e["field"] != "category")
    category = F.get(F.filter("entities", lambda e: e["field"] == "category"), 0)["value"]
    return lifted.select("query_id", F.map_from_entries(own).alias("filters"), category.alias("category"))


def browse(docs: DataFrame, limit: int = 24) -> DataFrame:
    """(category_id, place, parent_id, velocity): the best sellers of every category at every depth."""
    rows = docs.select("parent_id", "sales_velocity", F.explode("category_ids").alias("category_id"))
    rows = rows.groupBy("category_id", "parent_id").agg(F.max("sales_velocity").alias("velocity"))
    place = F.row_number().over(W.partitionBy("category_id").orderBy(F.desc("velocity"), "parent_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("category_id", "place", "parent_id", "velocity")


def autocomplete(prefixes: DataFrame, popular: DataFrame, limit: int = 6, gram: int = 3) -> DataFrame:
    """(prefix, query, place): popular queries that contain each prefix and are not it; those that begin with it first, then by searches. prefixes: (prefix) of `gram` letters or more; popular: (query, searches).

    A prefix meets the queries that have its first letters anywhere, by an equi-join.
    """
    wanted = prefixes.distinct().where(F.length("prefix") >= gram).withColumn("head", F.substring("prefix", 1, gram))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("query") - (gram - 1), F.lit(1))), lambda i: F.substring("query", i, F.lit(gram))))
    found = wanted.join(popular.select("query", "searches", F.explode(heads).alias("head")), "head").where(F.col("query").contains(F.col("prefix")) & (F.col("query") != F.col("prefix")))
    place = F.row_number().over(W.partitionBy("prefix").orderBy(F.when(F.col("query").startswith(F.col("prefix")), 0).otherwise(1), F.desc("searches"), "query"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("prefix", "query", "place")


def infixes(text: Column) -> Column:
    """All different pieces of one, two and three letters of a text."""
    pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.filter(F.flatten(F.array(pieces(1), pieces(2), pieces(3))), lambda g: g != ""))


def containing(prefixes: DataFrame, texts: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """(site_id, prefix, place and the columns of texts): for each prefix the first n texts of its site that contain it, by `order`, columns of both. prefixes: (site_id, prefix), not empty; texts: (site_id, text, ...).

    Texts are indexed by their pieces of up to three letters. A prefix of three letters or less is such a
    piece: of each piece only the first n texts are kept, once, however many shoppers ask. A longer prefix
    meets the texts that have its first three letters and is then looked for in them.
    """
    own = [c for c in texts.columns if c != "site_id"]
    w = W.partitionBy("site_id", "prefix").orderBy(*order)
    pieces = texts.select("*", F.explode(infixes(F.col("text"))).alias("piece"))
    wanted = prefixes.distinct()
    short = pieces.withColumnRenamed("piece", "prefix").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    short = wanted.where(F.length("prefix") <= 3).join(short, ["site_id", "prefix"])
    long = wanted.where(F.length("prefix") > 3).withColumn("piece", F.substring("prefix", 1, 3)).join(pieces, ["site_id", "piece"]).where(F.col("text").contains(F.col("prefix")))
    long = long.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return short.select("site_id", "prefix", "place", *own).unionByName(long.select("site_id", "prefix", "place", *own))


def complete(prefixes: DataFrame, popular: DataFrame, categories: DataFrame, brands: DataFrame, products: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(site_id, prefix, source, place, value, detail): all that is shown for what a shopper has typed so far.

    query: the first 6 popular queries that contain it and are not it, those that begin with it first, then
    by searches. category: the 4 with most products whose path contains it. brand: the first 3, by products.
    product: the search's own cards, if given. redirect: where a rule sends it. An empty box has 6 trending
    queries (source trending) and the first 6 nested categories. prefixes: (site_id, prefix), compared
    normalised; null is empty. popular: (site_id, query, searches); categories: (site_id, category_id, path:
    array<string>, products); brands: (site_id, brand, products); products: (site_id, prefix, place, sku,
    title); redirects: (site_id, prefix, target). Prefixes and results are in lower case.
    """
    asked = prefixes.select("site_id", normalise(F.coalesce("prefix", F.lit(""))).alias("prefix")).distinct()
    typed = asked.where("prefix <> ''")
    begins = F.when(F.col("text").startswith(F.col("prefix")), 0).otherwise(1)
    # One more than is shown: the prefix itself may be among them.
    queries = containing(typed, popular.select("site_id", F.col("query").alias("text"), "searches"), 7, [begins, F.desc("searches"), F.asc("text")])
    queries = queries.where("text <> prefix").withColumn("place", F.row_number().over(W.partitionBy("site_id", "prefix").orderBy("place"))).where("place <= 6")
    shelf = categories.select("site_id", F.lower(F.array_join("path", " ")).alias("text"), "category_id", F.array_join("path", " / ").alias("label"), "products")
    shelves = containing(typed, shelf, 4, [F.desc("products"), F.asc("category_id")])
    makes = containing(typed, brands.select("site_id", F.lower("brand").alias("text"), "brand", "products"), 3, [F.desc("products"), F.asc("brand")])
    row = lambda rows, source, value, detail: rows.select("site_id", "prefix", F.lit(source).alias("source"), "place", value.cast("string").alias("value"), detail.cast("string").alias("detail"))
    out = row(queries, "query", F.col("text"), F.col("searches")).unionByName(row(shelves, "category", F.col("category_id"), F.col("label"))).unionByName(row(makes, "brand", F.col("brand"), F.col("products")))
    if products is not None:
        out = out.unionByName(row(products, "product", F.col("sku"), F.col("title")))
    if redirects is not None:
        out = out.unionByName(row(redirects.withColumn("place", F.lit(1)), "redirect", F.col("target"), F.lit(None)))
    first = lambda rows, *order: rows.withColumn("place", F.row_number().over(W.partitionBy("site_id").orderBy(*order))).where("place <= 6")
    trending = row(asked.where("prefix = ''").join(first(popular, F.desc("searches"), F.asc("query")), "site_id"), "trending", F.col("query"), F.col("searches"))
    nested = row(asked.where("prefix = ''").join(first(categories.where("category_id like '%/%'"), F.asc("category_id")), "site_id"), "category", F.col("category_id"), F.array_join("path", " / "))
    return out.unionByName(trending).unionByName(nested)


def rescue(empty: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, strategy, terms) for queries that find nothing. empty: (query_id, terms); vocabulary: (token).

    spell_correct: every unknown term has a correction; else relax_terms: the known terms, if there are
    any; else best_sellers. Each stage looks only at what is left over by the one before.
    """
    terms = empty.select("query_id", F.posexplode("terms").alias("i", "term"))
    known = vocabulary.select(F.col("token").alias("term"), F.lit(True).alias("known")).distinct()
    unknown = terms.select("term").distinct().join(known, "term", "left_anti").withColumn("budget", typo_budget(F.col("term"))).where("budget > 0").withColumn("head", F.substring("term", 1, 1))
    near = unknown.join(vocabulary.distinct().withColumn("head", F.substring("token", 1, 1)), "head").withColumn("d", edit_distance(F.col("term"), F.col("token"), 2)).where("d <= budget")
    fixed = near.groupBy("term").agg(F.min(F.struct("d", F.length("token").alias("n"), "token")).alias("b")).select("term", F.col("b.token").alias("fixed"))
    rows = terms.join(known, "term", "left").join(fixed, "term", "left").withColumn("word", F.when(F.col("known"), F.col("term")).otherwise(F.col("fixed")))
    ordered = lambda c, test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("i", F.col(c).alias("w"))))), lambda s: s["w"])
    rows = rows.groupBy("query_id").agg(ordered("word", F.col("word").isNotNull()).alias("corrected"), ordered("term", F.col("known")).alias("kept"), F.count_if(F.col("word").isNull()).alias("lost"), F.count_if(F.col("known").isNull()).alias("wrong"))
    strategy = F.when((F.col("lost") == 0) & (F.col("wrong") > 0), "spell_correct").when(F.size("kept") > 0, "relax_terms").otherwise("best_sellers")
    return rows.select("query_id", strategy.alias("strategy"), F.when(strategy == "spell_correct", F.col("corrected")).otherwise(F.col("kept")).alias("terms"))


def learn_dimensions(rows: DataFrame, title: str = "title") -> DataFrame:
    """(row_ix, width_in, height_in) named in titles as 4"W x 6"H."""
    part = r'(\d+(?:\.\d+)?)(?:-(\d+)/(\d+))?\s*"\s*'
    pattern = rf"(?i){part}w\s*x\s*{part}h"
    get = lambda k: F.nullif(F.regexp_extract(title, pattern, k), F.lit("")).try_cast("double")
    size = lambda k: quantise(get(k) + F.coalesce(F.try_divide(get(k + 1), get(k + 2)), F.lit(0.0)))
    return rows.where(F.col(title).rlike(pattern)).select("row_ix", size(1).alias("width_in"), size(4).alias("height_in"))


def adopt_facets(configured: DataFrame, facetable: DataFrame) -> DataFrame:
    """(site_id, facet, label, display, place, collapsed, truncate_at, sort_by): facetable attributes that a site has not configured, after its last. configured: (site_id, facet, place); facetable: (site_id, facet, seen), in the order seen."""
    last = configured.groupBy("site_id").agg(F.max("place").alias("last"))
    new = facetable.groupBy("site_id", "facet").agg(F.min("seen").alias("seen")).join(configured, ["site_id", "facet"], "left_anti").join(last, "site_id", "left")
    place = F.greatest(F.coalesce("last", F.lit(0)), F.lit(0)) + F.row_number().over(W.partitionBy("site_id").orderBy("seen", "facet"))
    label = F.initcap(F.regexp_replace("facet", "[_-]+", " "))
    return new.select("site_id", "facet", label.alias("label"), F.lit("checkbox").alias("display"), place.alias("place"), F.lit(True).alias("collapsed"), F.lit(8).alias("truncate_at"), F.lit("count").alias("sort_by"))


def log_ingest_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs with the new ones added; a run that is there already (site_id, run_id) is replaced, so that a repeated write counts once."""
    return runs.join(new, ["site_id", "run_id"], "left_anti").unionByName(new)


def ingest_status(runs: DataFrame, n: int = 10) -> DataFrame:
    """The last n runs of each site, newest first."""
    place = F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    return runs.withColumn("place", place).where(F.col("place") <= n)
