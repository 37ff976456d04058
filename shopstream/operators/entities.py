"""Entities in queries, for each site: the names under which brands, categories and attribute values are found (Q3), which of them a query means (Q4), the filters that follow (Q5), and the whole reading of a query (Q1, Q6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_sku, normalise, singularise, tokenise, without_stopwords
from .analyse import MARKERS, lift_dimensions, split_compounds

#: Attributes that a query may name.
MOST_ATTRIBUTES = 3
# Spellings of one word.
SPELLINGS = [("gray", "grey"), ("grey", "gray")]
CONSTRAINT = "struct<kind:string,field:string,value:string,source:string>"
TAKEN = "array<struct<at:int,k:int,kind:string,field:string,value:string>>"


def entity_key(name: Column) -> Column:
    """Lower case letters and digits, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def key_forms(key: Column) -> Column:
    """The key, its singular and the singular with s."""
    singular = F.regexp_replace(F.regexp_replace(key, "ies$", "y"), "([^s])s$", "$1")
    return F.filter(F.array_distinct(F.array(key, singular, F.concat(singular, F.lit("s")))), lambda k: F.trim(k) != "")


def entity_names(categories: DataFrame, brands: DataFrame, values: DataFrame) -> DataFrame:
    """(site_id, key, kind, field, value): one row for each name and kind (brand, category, attribute) of a site.

    categories: (site_id, category_id, path: array<string>, products); brands: (site_id, brand, products);
    values: (site_id, field, value, products) of the facets. A category is found by its last path segment.
    Of several claims to a name the one with most products counts, then the first by field and value.
    Values need two letters in a row. A word of more than two letters of a value of several words names it
    too, if no category uses the word, no other value of the field has it and no whole value is called so;
    of several fields the one whose value ends in the word goes first, then the one with more products.
    gray and grey are the same. Null names and values give none.
    """
    best = lambda rows, kind, field, value, *order: rows.groupBy("site_id", "key").agg(F.min(F.struct(*order, field.alias("f"), value.alias("v"))).alias("b")).select("site_id", "key", F.lit(kind).alias("kind"), F.col("b.f").alias("field"), F.col("b.v").alias("value"))
    fewer = (-F.col("products")).alias("fewer")
    forms = lambda rows, name: rows.withColumn("key", F.explode(key_forms(entity_key(name))))

    by_brand = best(forms(brands, F.col("brand")), "brand", F.lit("brand"), F.col("brand"), fewer)
    by_category = best(forms(categories, F.element_at("path", -1)), "category", F.lit("category_id"), F.col("category_id"), fewer)
    worded = values.where(F.col("value").rlike("(?i)[a-z]{2,}"))
    whole = best(forms(worded, F.col("value")), "attribute", F.col("field"), F.col("value"), fewer)

    long_words = lambda text: F.filter(F.split(entity_key(text), " "), lambda w: F.length(w) > 2)
    taken = categories.select("site_id", F.explode("path").alias("segment")).select("site_id", F.explode(long_words(F.col("segment"))).alias("w"))
    taken = taken.select("site_id", F.explode(key_forms(F.col("w"))).alias("word")).distinct()
    parts = worded.withColumn("words", long_words(F.col("value"))).where(F.size("words") > 1)
    claims = parts.select("site_id", "field", "value", "products", F.explode(F.array_distinct("words")).alias("word"), F.element_at("words", -1).alias("last"))
    claims = claims.join(taken, ["site_id", "word"], "left_anti").groupBy("site_id", "word", "field").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("products").alias("products"), F.first("last").alias("last")).where("n = 1")
    swapped = [F.regexp_replace("word", a, b) for a, b in SPELLINGS]
    other = F.filter(F.array(*[F.when(F.col("word").contains(a), s) for (a, _), s in zip(SPELLINGS, swapped, strict=True)]), lambda s: s.isNotNull())
    order = [(F.col("last") != F.col("word")).cast("int").alias("not_head"), fewer]
    own = claims.groupBy("site_id", "word").agg(F.min(F.struct(*order, "field", "value", "products")).alias("b")).select("site_id", "word", "b.not_head", "b.field", "b.value", "b.products")
    keyed = own.select("*", F.posexplode(F.array_distinct(F.concat(key_forms(F.col("word")), other))).alias("form", "key"))
    partial = best(keyed, "attribute", F.col("field"), F.col("value"), "form", "not_head", fewer, "word").join(whole.select("site_id", "key"), ["site_id", "key"], "left_anti")
    return by_brand.unionByName(by_category).unionByName(whole).unionByName(partial)


def longest_name(names: DataFrame) -> int:
    """Words of the longest name."""
    return names.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1


def lift_entities(queries: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    """queries (site_id, query, tokens) with `constraints` (array of kind, field, value, source) and `rest`, the tokens left over.

    The widest spans go first, then those further left; a token is used once. A span is the query's brand if
    it has none yet, else a category, else an attribute (three at most, one for each field). Of all
    categories found the widest, then the last, is meant; the words of the others go back to the rest.
    Brand and attributes come in the order found, the category last. Queries without tokens have neither.
    """
    n = F.size("tokens")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct(i.alias("at"), k.alias("k")))))
    rows = queries.where(n > 0).select("site_id", "query", "tokens", F.explode(F.filter(spans, lambda s: s["at"] + s["k"] - 1 <= n)).alias("s"))
    rows = rows.select("site_id", "query", F.col("s.at").alias("at"), F.col("s.k").alias("k"), entity_key(F.array_join(F.slice("tokens", F.col("s.at"), F.col("s.k")), " ")).alias("key"))
    found = rows.join(names, ["site_id", "key"])
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("field", "value"))).alias(kind)
    found = found.groupBy("site_id", "query", "at", "k").agg(one("brand"), one("category"), one("attribute"))
    found = found.groupBy("site_id", "query").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("narrow"), "at", "k", "brand", "category", "attribute"))).alias("hits"))  # the spans of one query

    def take(s: Column, h: Column) -> Column:
        apart = ~F.exists(s, lambda t: (t["at"] < h["at"] + h["k"]) & (h["at"] < t["at"] + t["k"]))
        brand = h["brand"].isNotNull() & ~F.exists(s, lambda t: t["kind"] == "brand")
        attributes = F.filter(s, lambda t: t["kind"] == "attribute")
        own = h["attribute"].isNotNull() & (F.size(attributes) < MOST_ATTRIBUTES) & ~F.exists(s, lambda t: (t["kind"] != "category") & (t["field"] == h["attribute"]["field"]))
        row = lambda kind: F.array(F.struct(h["at"].alias("at"), h["k"].alias("k"), F.lit(kind).alias("kind"), h[kind]["field"].alias("field"), h[kind]["value"].alias("value")))
        return F.when(~apart, s).when(brand, F.concat(s, row("brand"))).when(h["category"].isNotNull(), F.concat(s, row("category"))).when(own, F.concat(s, row("attribute"))).otherwise(s)

    found = found.withColumn("taken", F.aggregate("hits", F.array().cast(TAKEN), take))
    chosen = F.array_max(F.transform(F.filter("taken", lambda t: t["kind"] == "category"), lambda t: F.struct(t["k"].alias("k"), t["at"].alias("at"))))
    kept = F.filter("taken", lambda t: (t["kind"] != "category") | ((t["k"] == F.col("chosen.k")) & (t["at"] == F.col("chosen.at"))))
    ordered = F.concat(F.filter("kept", lambda t: t["kind"] != "category"), F.filter("kept", lambda t: t["kind"] == "category"))
    found = found.withColumn("chosen", chosen).withColumn("kept", kept).select("site_id", "query", ordered.alias("kept"))
    out = queries.join(found, ["site_id", "query"], "left").withColumn("kept", F.coalesce("kept", F.array().cast(TAKEN)))
    source = lambda t: F.array_join(F.slice("tokens", t["at"], t["k"]), " ")
    constraints = F.transform("kept", lambda t: F.struct(t["kind"].alias("kind"), t["field"].alias("field"), t["value"].alias("value"), source(t).alias("source")))
    rest = F.filter("tokens", lambda t, i: ~F.exists("kept", lambda s: (s["at"] <= i + 1) & (i + 1 < s["at"] + s["k"])))
    return out.select(*queries.columns, constraints.cast(f"array<{CONSTRAINT}>").alias("constraints"), rest.alias("rest"))


def read_queries(queries: DataFrame, vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """(site_id, query, type, terms, constraints, dimensions, sku) of the different queries of each site (Q1).

    One token that looks like a part number is `sku`. Else measurements are lifted, stopwords dropped, words
    joined by mistake cut in two known ones, entities lifted, and what is left is singularised. Types:
    empty, sku, natural_language, dimensional, entity, keyword. queries: (site_id, query), null is like
    empty; vocabulary: (site_id, token).
    """
    q = queries.select("site_id", "query").distinct().withColumn("text", normalise(F.coalesce("query", F.lit("")))).withColumn("raw", tokenise(F.col("text")))
    q = q.withColumn("is_sku", (F.size("raw") == 1) & F.coalesce(looks_like_sku(F.get("raw", 0)), F.lit(False)))
    q = q.withColumn("lifted", lift_dimensions(F.when(F.col("is_sku"), F.lit("")).otherwise(F.col("text"))))
    q = q.withColumn("words", without_stopwords(tokenise(F.col("lifted.rest"))))
    cuts = split_compounds(q.select("site_id", F.explode("words").alias("word")), vocabulary, ["site_id"])
    words = q.select("site_id", "query", F.posexplode("words").alias("i", "word")).join(cuts, ["site_id", "word"], "left")
    words = words.groupBy("site_id", "query").agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("left").isNull(), F.array("word")).otherwise(F.array("left", "right")).alias("w")))).alias("ws"))
    q = q.join(words.select("site_id", "query", F.flatten(F.transform("ws", lambda x: x["w"])).alias("cut")), ["site_id", "query"], "left").withColumn("tokens", F.coalesce("cut", F.array().cast("array<string>")))
    q = lift_entities(q, names, longest_name(names))
    n, dimensions, entities = F.size("raw"), F.size("lifted.dimensions") > 0, F.size("constraints") > 0
    spoken = (n >= 6) | ((n >= 4) & F.arrays_overlap("raw", F.array(*[F.lit(w) for w in MARKERS])))
    kind = F.when(F.col("text") == "", "empty").when(F.col("is_sku"), "sku").when(~dimensions & ~entities & spoken, "natural_language").when(dimensions, "dimensional").when(entities, "entity").otherwise("keyword")
    terms = F.when(F.col("is_sku"), F.col("raw")).otherwise(F.transform("rest", singularise))
    return q.select("site_id", "query", kind.alias("type"), terms.alias("terms"), "constraints", F.col("lifted.dimensions").alias("dimensions"), F.when(F.col("is_sku"), F.upper(F.get("raw", 0))).alias("sku"))


def of_kind(constraints: Column, kind: str) -> Column:
    return F.filter(constraints, lambda c: c["kind"] == kind)


def understand(read: DataFrame) -> DataFrame:
    """(site_id, query, brand, category): what each query names (Q6)."""
    return read.select("site_id", "query", F.get(of_kind(F.col("constraints"), "brand"), 0)["value"].alias("brand"), F.get(of_kind(F.col("constraints"), "category"), 0)["value"].alias("category"))


def with_constraints(filters: Column, category_id: Column, collection: Column, constraints: Column) -> tuple[Column, Column]:
    """A request's filters (map<string, array<string>>) and category after its query's entities (Q5): brand and attributes filter unless the shopper filters that field already, the category holds unless there is a category or collection."""
    own = F.coalesce(filters, F.create_map().cast("map<string,array<string>>"))
    new = F.filter(constraints, lambda c: c["kind"].isin("brand", "attribute") & (F.size(F.coalesce(F.try_element_at(own, c["field"]), F.array().cast("array<string>"))) == 0))
    kept = F.map_filter(own, lambda k, v: F.size(v) > 0)
    filled = F.map_concat(kept, F.map_from_entries(F.transform(new, lambda c: F.struct(c["field"].alias("k"), F.array(c["value"]).alias("v")))))
    category = F.coalesce(category_id, F.when(collection.isNull(), F.get(of_kind(constraints, "category"), 0)["value"]))
    return filled, category
