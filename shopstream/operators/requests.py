"""Search over a table of requests (R5): every request is a conjunction of groups, a group a disjunction of keys, and a document is found through the shortest lists of its keys.

Each document has `words` and `tags` (facet values, categories, labels, part numbers, lengths). The sizes of
all lists are known from one count. For each request the list to start from is chosen: of its groups the
one with the fewest documents, so documents are only looked at if they hold the request's rarest group,
and requests x documents never forms. A facet is counted over documents that miss no selection but the
facet's own; such a document misses one group at most, so it is in one of the two shortest lists: these two
are read where a request has selections. Whatever else a request asks is tested on the document itself,
with its score and text signals, in the same step. What passes is stored once; pages, totals and facets
are sums over its parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.store import stored
from .entities import with_constraints
from .retrieve import PARTS, TOKENS, WEIGHTS, expansions, prefix_terms
from .rules import absent_pins, apply_query_rule, expand_synonyms

#: Parents that are ranked, rows of them, siblings on a card.
WINDOW, ROWS, SIBLINGS = 240, 1920, 8
#: Length of the head of part numbers that is looked up; shorter tokens are no part numbers.
PART = 5
#: Inches that a length may be off; lengths are looked up by sixteenths.
WITHIN = 0.03
AXES = ["width_in", "height_in", "length_in", "size_in"]
#: Values of a facet that are given.
VALUES = 200
STRINGS, MAP = "array<string>", "map<string,array<string>>"
GROUP = "array<struct<name:string,word:boolean,own:boolean,keys:array<string>>>"


def sort_value(sort: Column, retrieval: Column, has_terms: Column) -> Column:
    """A number that is higher for documents which come first. Without terms relevance is sales."""
    day = F.unix_timestamp(F.col("date_added").cast("timestamp")).cast("double")
    return (
        F.when(sort == "best_selling", F.col("sales_velocity")).when(sort == "newest", day).when(sort == "price_asc", -F.col("effective_price")).when(sort == "price_desc", F.col("effective_price"))
        .when(sort == "discount", F.col("discount_pct")).when(sort == "top_rated", F.col("review_score")).when(has_terms, retrieval.cast("double")).otherwise(F.col("sales_velocity"))
    )


def sixteenths(inches: Column) -> Column:
    return F.floor(inches * 16 + 0.5).cast("string")


def document_index(docs: DataFrame, fields: dict[str, Column], facets: dict[str, Column]) -> DataFrame:
    """docs as they are searched: (site_id, sku, parent_id, words, tags, texts, facets, and what ranges, sorts and ranking read).

    docs: (site_id, sku, mpn, parent_id, category_ids, labels: array of key:value, effective_price,
    discount_pct, in_stock, sales_velocity, date_added, review_score, business, and width_in, height_in,
    length_in, size_in as far as there are). fields: texts that are searched, by name; facets: values that
    are counted and filtered, by name. Nulls are not found.
    """
    tokens = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKENS), lambda t: t != "")
    texts = F.array(*[F.struct(F.lit(name).alias("field"), F.lit(WEIGHTS.get(name, 1)).alias("weight"), tokens(c).alias("tokens")) for name, c in fields.items()])
    values = F.filter(F.array(*[F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value")) for name, c in facets.items()]), lambda f: f["value"].isNotNull())
    labels = F.transform(F.filter(F.coalesce("labels", F.array().cast(STRINGS)), lambda x: x.contains(":")), lambda x: F.struct(F.concat(F.lit("label:"), F.substring_index(x, ":", 1)).alias("facet"), F.regexp_replace(x, "^[^:]*:", "").alias("value")))
    length = {a: (F.col(a).cast("double") if a in docs.columns else F.lit(None).cast("double")) for a in AXES}
    axis = {a: F.coalesce(c, length["size_in"]) if a in ("width_in", "height_in") else c for a, c in length.items()}
    sizes = [F.concat(F.lit(f"d:{a}:"), sixteenths(c)) for a, c in axis.items()] + [F.concat(F.lit("d:any_dimension_in:"), sixteenths(c)) for c in length.values()]
    part = [F.concat(F.lit("p:"), F.substring(F.upper(c), 1, PART)) for c in ("sku", "mpn")]
    tags = F.concat(
        F.transform(F.concat(values, labels), lambda f: F.concat(F.lit("f:"), f["facet"], F.lit("="), f["value"])), F.transform("category_ids", lambda c: F.concat(F.lit("c:"), c)), F.filter(F.array(*part, *sizes), lambda k: k.isNotNull()), F.array(F.lit("s:"))
    )
    lengths = F.map_from_arrays(F.array(*[F.lit(a) for a in axis]), F.array(*axis.values()))
    rows = docs.select("*", texts.alias("texts"), F.concat(values, labels).alias("facets"), tags.alias("all_tags"), lengths.alias("lengths"), F.array(*length.values()).alias("any_length"))
    keep = ["effective_price", "discount_pct", "sales_velocity", "date_added", "review_score", "business", "in_stock"]
    return rows.select("site_id", "sku", "mpn", "parent_id", F.array_distinct(F.flatten(F.transform("texts", lambda t: t["tokens"]))).alias("words"), F.array_distinct("all_tags").alias("tags"), "texts", "facets", "lengths", "any_length", *keep)


def vocabulary_of(index: DataFrame, least: int = 3) -> DataFrame:
    """(site_id, token): words of the documents of each site."""
    return index.select("site_id", F.explode("words").alias("token")).where(F.length("token") >= least).distinct()


def planned(requests: DataFrame, read: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Requests with what their query means: (query_id, site_id, type, terms, rule_ids, constraints, filters, labels, ranges, category_id, collection, dimensions, sku, sort).

    requests: (query_id, site_id, query, filters and labels: map<string, array<string>>, ranges:
    array<struct<field, least, most>>, category_id, collection, sort), all but the first two may be null.
    read: see read_queries. synonyms: (site_id, rule_id, trigger, alternatives); alternatives are added to the terms.
    """
    # An own name for the query: entities, and so the reading, are those of the site.
    rows = requests.withColumn("query", F.coalesce("query", F.lit(""))).join(read.withColumn("query", F.coalesce("query", F.lit(""))), ["site_id", "query"])
    filters, category = with_constraints(F.col("filters"), F.col("category_id"), F.col("collection"), F.col("constraints"))
    rows = rows.withColumns({"filters": filters, "category_id": category, "labels": F.coalesce("labels", F.create_map().cast(MAP)), "sort": F.coalesce("sort", F.lit("relevance"))})
    if synonyms is None:
        return rows.withColumn("rule_ids", F.array().cast("array<int>"))
    distinct = rows.where(F.size("terms") > 0).select("site_id", "terms").distinct().withColumn("query_id", F.struct("site_id", "terms"))
    wider = expand_synonyms(distinct, synonyms, by=["site_id"]).select(F.col("query_id.site_id").alias("site_id"), F.col("query_id.terms").alias("terms"), F.col("terms").alias("wider"), "rule_ids")
    rows = rows.join(wider, ["site_id", "terms"], "left")
    return rows.withColumn("terms", F.coalesce("wider", "terms")).withColumn("rule_ids", F.coalesce("rule_ids", F.array().cast("array<int>"))).drop("wider")


def with_surfaces(plans: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """plans with `surfaces`: for each term the words that stand for it (token, distance, kind 0 exact, 1 fuzzy, 2 prefix, 3 a further word that begins with it: it matches but is not counted as found)."""
    terms = plans.where(F.col("sku").isNull()).select("site_id", F.explode("terms").alias("term")).distinct()
    named = expansions(terms, vocabulary, by=["site_id"])
    further = prefix_terms(terms, vocabulary, limit=None, by=["site_id"]).join(named.select("site_id", "term", "token"), ["site_id", "term", "token"], "left_anti")
    every = named.unionByName(further.select("site_id", "term", "token", F.lit(0).alias("distance"), F.lit(3).alias("kind")))
    # A term's words: fuzzy and prefix words are few, further ones as many as the site's words begin with it.
    listed = every.groupBy("site_id", "term").agg(F.collect_list(F.struct("token", "distance", "kind")).alias("words"))
    rows = plans.where(F.col("sku").isNull()).select("query_id", "site_id", F.posexplode(F.array_distinct("terms")).alias("i", "term")).join(listed, ["site_id", "term"])
    rows = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "term", "words"))), lambda s: F.struct(s["term"].alias("term"), s["words"].alias("words"))).alias("surfaces"))
    return plans.join(rows, "query_id", "left").withColumn("surfaces", F.coalesce("surfaces", F.array().cast("array<struct<term:string,words:array<struct<token:string,distance:int,kind:int>>>>")))


def groups_of(selected: bool) -> Column:
    """The groups of a plan. own: a facet selection, which its own facet does not obey."""
    names = lambda m, head: F.transform(F.filter(F.map_entries(m), lambda e: F.size(e["value"]) > 0), lambda e: F.struct(F.concat(F.lit(head), e["key"]).alias("name"), F.lit(False).alias("word"), F.lit(selected).alias("own"), F.transform(e["value"], lambda v: F.concat(F.lit(f"f:{head}"), e["key"], F.lit("="), F.when(e["key"] == "in_stock", F.when(F.lower(v).isin("1", "true"), "1").otherwise("0")).otherwise(v))).alias("keys")))
    terms = F.transform("surfaces", lambda s: F.struct(F.concat(F.lit("term:"), s["term"]).alias("name"), F.lit(True).alias("word"), F.lit(False).alias("own"), F.transform(s["words"], lambda w: w["token"]).alias("keys")))
    lengths = F.transform("dimensions", lambda d: F.struct(F.concat(F.lit("length:"), d["field"]).alias("name"), F.lit(False).alias("word"), F.lit(False).alias("own"), F.array(F.concat(F.lit("d:"), d["field"], F.lit(":"), sixteenths(d["inches"]))).alias("keys")))
    single = lambda name, key: F.when(key.isNotNull(), F.array(F.struct(F.lit(name).alias("name"), F.lit(False).alias("word"), F.lit(False).alias("own"), F.array(key).alias("keys")))).otherwise(F.array().cast(GROUP))
    return F.concat(
        terms, names(F.col("filters"), ""), names(F.col("labels"), "label:"), lengths, single("category", F.concat(F.lit("c:"), F.col("category_id"))), single("collection", F.concat(F.lit("f:label:collection="), F.col("collection"))),
        single("sku", F.concat(F.lit("p:"), F.substring("sku", 1, PART))),
    ).cast(GROUP)


def list_sizes(index: DataFrame) -> DataFrame:
    """(site_id, word, key, n): documents with each word and tag."""
    keys = F.concat(F.transform("words", lambda w: F.struct(F.lit(True).alias("word"), w.alias("key"))), F.transform("tags", lambda t: F.struct(F.lit(False).alias("word"), t.alias("key"))))
    return index.select("site_id", F.explode(keys).alias("k")).groupBy("site_id", "k.word", "k.key").agg(F.count("*").alias("n"))


def starting_lists(plans: DataFrame, sizes: DataFrame, facets: bool) -> DataFrame:
    """(query_id, site_id, word, key): the keys whose lists are read for each plan. The group with the fewest documents; if facets are counted and it is a selection, it and the next, or the shortest group that is no selection, whichever is less. A plan without groups, or with one selection alone, starts from all documents of its site."""
    every = F.array(F.struct(F.lit("all").alias("name"), F.lit(False).alias("word"), F.lit(False).alias("own"), F.array(F.lit("s:")).alias("keys"))).cast(GROUP)
    lonely = (F.size("groups") == 1) & F.get("groups", 0)["own"]  # what misses its only selection may be anything
    groups = F.when(F.size("groups") == 0, every).when(lonely, F.concat("groups", every)).otherwise(F.col("groups"))
    rows = plans.select("query_id", "site_id", F.posexplode(groups).alias("i", "g"))
    keys = rows.select("query_id", "site_id", "i", F.col("g.own").alias("own"), F.col("g.word").alias("word"), F.explode(F.array_distinct("g.keys")).alias("key"))
    counted = keys.join(sizes.hint("merge"), ["site_id", "word", "key"], "left").groupBy("query_id", "i", "own").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    w = W.partitionBy("query_id").orderBy("n", "i")
    counted = counted.withColumns({"place": F.row_number().over(w), "both": F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)), "fixed": F.min(F.when(~F.col("own"), F.struct("n", "i"))).over(W.partitionBy("query_id"))})
    if facets:
        two = F.max(F.when(F.col("place") <= 2, F.col("both"))).over(W.partitionBy("query_id"))
        counted = counted.withColumn("two", two)
        chosen = F.when(F.col("fixed").isNotNull() & (F.col("fixed.n") <= F.col("two")), F.col("i") == F.col("fixed.i")).otherwise(F.col("place") <= 2)
    else:
        chosen = F.col("place") == 1
    return keys.join(counted.where(chosen).select("query_id", "i"), ["query_id", "i"]).select("query_id", "site_id", "word", "key")


SCORE = ["retrieval", "typos", "words_matched", "best_field_weight", "proximity", "exactness"]


def text_score(surfaces: Column, texts: Column, words: Column) -> Column:
    """(retrieval, typos, words_matched, best_field_weight, proximity, exactness) of a document for the terms of a plan, from the document's own words.

    retrieval: for each term and field that holds one of its words the field's weight. A term is found as
    itself, else as the word with the least distance, then fuzzy before prefix, then the shorter fuzzy word,
    then by name. For each field: how far the first places of the found words spread beyond their number;
    exactness 3 if the field is the terms and nothing else, 2 if it holds all terms as they are and no term
    has typos, 0 with typos, 1 with prefixes, else 2. The best field has the largest weight, then the least
    spread, then the highest exactness.
    """
    order = lambda w: F.struct(w["distance"].alias("distance"), w["kind"].alias("kind"), F.when(w["kind"] == 1, F.length(w["token"])).otherwise(0).alias("n"), w["token"].alias("token"))
    present = F.transform(surfaces, lambda s: F.struct(s["term"].alias("term"), F.filter(s["words"], lambda w: F.array_contains(words, w["token"])).alias("here")))
    best = F.filter(F.transform(present, lambda s: F.array_min(F.transform(F.filter(s["here"], lambda w: w["kind"] < 3), order))), lambda b: b.isNotNull())
    retrieval = F.aggregate(texts, F.lit(0), lambda n, t: n + t["weight"] * F.size(F.filter(present, lambda s: F.exists(s["here"], lambda w: F.array_contains(t["tokens"], w["token"])))))
    found = F.struct(best.alias("best"), retrieval.alias("retrieval"))
    terms = F.transform(surfaces, lambda s: s["term"])

    def scored(f: Column) -> Column:
        typos = F.aggregate(f["best"], F.lit(0), lambda n, b: n + b["distance"])
        prefixed = F.exists(f["best"], lambda b: b["kind"] == 2)

        def field(t: Column) -> Column:
            at = F.filter(F.transform(f["best"], lambda b: F.array_position(t["tokens"], b["token"]).cast("int")), lambda p: p > 0)
            spread = F.greatest(F.array_max(at) - F.array_min(at) - (F.size(at) - 1), F.lit(-(10**6)))
            every = F.forall(terms, lambda x: F.array_contains(t["tokens"], x))
            exact = F.when(every & (F.size(t["tokens"]) == F.size(terms)), 3).when(every & (typos == 0), 2).when(typos > 0, 0).when(prefixed, 1).otherwise(2)
            return F.when(F.size(at) > 0, F.struct(t["weight"].alias("weight"), (-spread).alias("near"), exact.alias("exactness")))

        top = F.array_max(F.filter(F.transform(texts, field), lambda x: x.isNotNull()))
        return F.struct(f["retrieval"].alias("retrieval"), typos.alias("typos"), F.size(f["best"]).alias("words_matched"), F.coalesce(top["weight"], F.lit(0)).alias("best_field_weight"), F.coalesce(-top["near"], F.lit(0)).alias("proximity"), F.coalesce(top["exactness"], F.lit(0)).alias("exactness"))

    return F.get(F.transform(F.array(found), scored), 0)


def found_documents(plans: DataFrame, index: DataFrame, sizes: DataFrame, facets: bool = True) -> DataFrame:
    """(query_id, site_id, sku, parent_id, missed, value, score, price, business, facets): documents that fulfil a plan, and with facets=True those that miss one selection only (missed: its name, else null). plans: with surfaces. value orders a plan's documents, higher first."""
    plans = plans.withColumn("groups", groups_of(selected=facets))
    starts = starting_lists(plans, sizes, facets)
    keys = F.concat(F.transform("words", lambda w: F.struct(F.lit(True).alias("word"), w.alias("key"))), F.transform("tags", lambda t: F.struct(F.lit(False).alias("word"), t.alias("key"))))
    postings = index.select("site_id", "sku", F.explode(keys).alias("k")).select("site_id", "sku", "k.word", "k.key")
    # Stored files are far smaller than their rows: what grows with the documents is merged and not sent through the driver. Plans meet a candidate last, so they are not shuffled with each.
    slot = F.pmod(F.xxhash64("sku"), F.lit(PARTS)).cast("int")
    starts = starts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    candidates = starts.join(postings.withColumn("slot", slot).hint("merge"), ["site_id", "word", "key", "slot"]).select("query_id", "site_id", "sku").distinct()
    rows = candidates.join(index.hint("merge"), ["site_id", "sku"]).withColumnRenamed("sku", "doc_sku")
    rows = rows.join(plans.select("query_id", "groups", "surfaces", "ranges", "dimensions", F.col("sku").alias("part"), "sort"), "query_id").withColumnRenamed("doc_sku", "sku")
    misses = F.filter("groups", lambda g: ~F.when(g["word"], F.arrays_overlap(g["keys"], F.col("words"))).otherwise(F.arrays_overlap(g["keys"], F.col("tags"))))
    rows = rows.withColumn("misses", misses).where((F.size("misses") == 0) | ((F.size("misses") == 1) & F.get("misses", 0)["own"]))
    number = lambda field: F.when(field == "price", F.col("effective_price")).when(field == "discount_pct", F.col("discount_pct")).otherwise(F.try_element_at(F.col("lengths"), field))
    known = lambda field: field.isin("price", "discount_pct", *AXES)
    inside = F.coalesce(F.forall("ranges", lambda r: ~known(r["field"]) | F.coalesce((r["least"].isNull() | (number(r["field"]) >= r["least"])) & (r["most"].isNull() | (number(r["field"]) <= r["most"])), F.lit(False))), F.lit(True))
    near = lambda v, d: F.coalesce(F.abs(v - d["inches"]) < WITHIN, F.lit(False))
    sized = F.forall("dimensions", lambda d: F.when(d["field"] == "any_dimension_in", F.exists("any_length", lambda v: near(v, d))).otherwise(near(F.try_element_at(F.col("lengths"), d["field"]), d)))
    parted = F.col("part").isNull() | F.upper("sku").startswith(F.col("part")) | F.coalesce(F.upper("mpn").startswith(F.col("part")), F.lit(False))
    rows = rows.where(inside & sized & parted).withColumn("missed", F.get("misses", 0)["name"])
    no_score = F.struct(*[F.lit(0).alias(c) for c in SCORE])
    score = F.when(F.size("surfaces") > 0, text_score(F.col("surfaces"), F.col("texts"), F.col("words"))).otherwise(no_score)
    rows = rows.withColumn("score", F.when(F.col("missed").isNull(), score))
    value = F.coalesce(sort_value(F.col("sort"), F.col("score.retrieval"), F.size("surfaces") > 0), F.lit(float("-inf")))
    return rows.select("query_id", "site_id", "sku", "parent_id", "missed", F.when(F.col("missed").isNull(), value).alias("value"), "score", F.col("effective_price").alias("price"), "business", F.col("facets") if facets else F.lit(None).alias("facets"))


def found_parents(found: DataFrame) -> DataFrame:
    """(query_id, parent_id, best, variants, least, most, values): for each request and parent its best value, how many of its variants match, their prices, and the facet values by which it counts."""
    hit = F.col("missed").isNull()
    counts = F.filter("facets", lambda f: F.col("missed").isNull() | (f["facet"] == F.col("missed")))
    rows = found.withColumn("counts", counts)
    return rows.groupBy("query_id", "parent_id").agg(F.max("value").alias("best"), F.count_if(hit).alias("variants"), F.min(F.when(hit, F.col("price"))).alias("least"), F.max(F.when(hit, F.col("price"))).alias("most"), F.array_distinct(F.flatten(F.collect_set("counts"))).alias("values"))


def totals(parents: DataFrame) -> DataFrame:
    """(query_id, products, variants, least, most): all that a request matches (A18), and its prices."""
    return parents.where("variants > 0").groupBy("query_id").agg(F.count("*").alias("products"), F.sum("variants").alias("variants"), F.min("least").alias("least"), F.max("most").alias("most"))


def request_facets(parents: DataFrame) -> DataFrame:
    """(query_id, facet, value, products, place): parents by facet value, each facet free of its own selection (A16), labels as facets label:key (A17). Values of no product are absent; of each facet the first VALUES by products, then by name.

    A parent brings each value once, so products are a plain count.
    """
    rows = parents.select("query_id", F.explode("values").alias("f")).groupBy("query_id", "f.facet", "f.value").agg(F.count("*").alias("products"))
    place = F.row_number().over(W.partitionBy("query_id", "facet").orderBy(F.desc("products"), "value"))
    return rows.withColumn("place", place).where(F.col("place") <= VALUES)


def facet_panels(facets: DataFrame, totals_: DataFrame, plans: DataFrame, config: DataFrame) -> DataFrame:
    """What each request's page shows beside its products (R9): (query_id, position, facet, label, display, place, value, value_label, products, chosen, least, most), a row for each value, and one for each slider.

    config: (site_id, facet, label, display, position, sort_by count, alpha or custom, truncate_at (0: all),
    custom: array<string>). Facets called label:key are a site's own attributes: sorted by count, not cut.
    Chosen values stay where a facet is cut. A slider shows the prices of what matches.
    """
    config = config.withColumn("own", F.col("facet").startswith("label:"))
    selected = plans.select("query_id", "site_id", F.explode(F.map_concat("filters", F.map_from_entries(F.transform(F.map_entries("labels"), lambda e: F.struct(F.concat(F.lit("label:"), e["key"]).alias("k"), e["value"].alias("v")))))).alias("facet", "values"))
    selected = selected.select("query_id", "facet", F.explode("values").alias("value"), F.lit(True).alias("chosen")).distinct()
    rows = facets.join(plans.select("query_id", "site_id"), "query_id").join(config.where("display <> 'slider'"), ["site_id", "facet"]).join(selected, ["query_id", "facet", "value"], "left").fillna({"chosen": False})
    shown = F.when(F.col("facet") == "in_stock", F.when(F.col("value") == "1", "In Stock").otherwise("Out of Stock")).otherwise(F.col("value"))
    digits = F.regexp_extract(shown, r"^[0-9]+(\.[0-9]+)?", 0).try_cast("double")
    listed = F.coalesce(F.nullif(F.array_position("custom", F.col("value")), F.lit(0).cast("long")), F.lit(999).cast("long")).cast("double")
    alpha = (F.col("sort_by") == "alpha") & ~F.col("own")
    key = F.when(alpha, F.coalesce(digits, F.lit(float("inf")))).when((F.col("sort_by") == "custom") & ~F.col("own"), listed).otherwise(0.0)
    rank = F.row_number().over(W.partitionBy("query_id", "facet").orderBy(key, F.when(alpha, shown), "place"))
    rows = rows.withColumn("value_label", shown).withColumn("place", rank).where(F.col("own") | (F.col("truncate_at") == 0) | (F.col("place") <= F.col("truncate_at")) | F.col("chosen"))
    values = rows.select("query_id", "position", "facet", "label", "display", "place", "value", "value_label", "products", "chosen")
    sliders = totals_.where("least is not null").join(plans.select("query_id", "site_id"), "query_id").join(config.where("display = 'slider' and facet = 'price'"), "site_id")
    return values.unionByName(sliders.select("query_id", "position", "facet", "label", "display", "least", "most"), allowMissingColumns=True)


def ranked_cards(found: DataFrame, parents: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, card, parent_id, sku, siblings, matching): the ranked products of each request (W1-W3): its WINDOW best parents, ROWS rows of them; by the cascade, or by the sort where one is asked for; a card stands where its best variant does and carries up to SIBLINGS more."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("best"), "parent_id"))
    window = parents.where("variants > 0").withColumn("place", place).where(F.col("place") <= WINDOW).select("query_id", "parent_id", "place", "variants")
    rows = found.where("missed is null").hint("merge").join(window, ["query_id", "parent_id"])
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("place", F.desc("value"), "sku"))).where(F.col("n") <= ROWS)
    rows = rows.join(plans.select("query_id", F.col("sort").alias("asked")), "query_id").select("query_id", "parent_id", "sku", "asked", "place", "variants", "value", "business", "n", "score.*", F.col("score.retrieval").alias("r"))
    relevance = lambda c: F.when(F.col("asked") == "relevance", c)
    signals = [relevance(F.col("typos")), relevance(-F.col("words_matched")), relevance(-F.col("best_field_weight")), relevance(F.col("proximity")), relevance(-F.col("exactness")), relevance(-F.col("business")), relevance(-F.col("value"))]
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*signals, F.when(F.col("asked") != "relevance", F.col("n")), "sku")))
    within = rows.withColumn("k", F.row_number().over(W.partitionBy("query_id", "parent_id").orderBy("rank"))).where(F.col("k") <= SIBLINGS + 1)
    cards = within.groupBy("query_id", "parent_id").agg(F.min("rank").alias("first"), F.first("variants").alias("matching"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "sku"))), lambda s: s["sku"]).alias("skus"))
    card = F.row_number().over(W.partitionBy("query_id").orderBy("first"))
    return cards.select("query_id", card.alias("card"), "parent_id", F.get("skus", 0).alias("sku"), F.slice("skus", 2, SIBLINGS).alias("siblings"), "matching")


def merchandised(cards: DataFrame, actions: DataFrame, docs: DataFrame) -> DataFrame:
    """cards after the query rules (R10): (query_id, card, parent_id, sku, siblings, matching, pinned). actions: (query_id, site_id, parent_id, action, slot, ordinal); docs: (site_id, sku, parent_id, ordinal). Pinned products that were not found come with their first document."""
    here = actions.join(docs.select("site_id", "parent_id").distinct(), ["site_id", "parent_id"], "left_semi").drop("site_id")
    ruled = actions.select("query_id").distinct()
    mine, others = cards.join(ruled, "query_id", "left_semi"), cards.join(ruled, "query_id", "left_anti")
    moved = apply_query_rule(mine, here, here.select("parent_id").distinct())
    pins = actions.where("action = 'pin'").select("query_id", "site_id", "parent_id")
    absent = absent_pins(pins, mine, docs, by=["site_id"]).select("query_id", "parent_id", F.col("sku").alias("first_sku"))
    moved = moved.join(mine.drop("card"), ["query_id", "parent_id"], "left").join(absent, ["query_id", "parent_id"], "left")
    moved = moved.select("query_id", "card", "parent_id", F.coalesce("sku", "first_sku").alias("sku"), F.coalesce("siblings", F.array().cast(STRINGS)).alias("siblings"), F.coalesce("matching", F.lit(0)).alias("matching"), "pinned")
    return moved.unionByName(others.withColumn("pinned", F.lit(False)))


def page_numbers(products: Column, per_page: int) -> Column:
    """Pages that can be turned to: all products, but no more than the window ranks."""
    return F.greatest(F.ceil(F.least(products, F.lit(max(per_page, WINDOW))) / per_page), F.lit(1)).cast("int")


# BM25 (R2) ---------------------------------------------------------------------------------------------

K1, B = 1.2, 0.75


def impacts(index: DataFrame) -> DataFrame:
    """(site_id, token, sku, impact): what a word adds to a document's BM25 score, to be stored with the postings.

    A word's frequency is the sum of the weights of its places; lengths are words of all fields, against
    the mean of the site; idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6, over the site's documents.
    """
    tokens = F.flatten(F.transform("texts", lambda t: F.transform(t["tokens"], lambda w: F.struct(w.alias("token"), t["weight"].alias("weight")))))
    rows = index.select("site_id", "sku", F.aggregate("texts", F.lit(0), lambda n, t: n + F.size(t["tokens"])).alias("length"), tokens.alias("tokens"))
    sites = rows.groupBy("site_id").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    places = rows.select("site_id", "sku", "length", F.explode("tokens").alias("t")).groupBy("site_id", "sku", "length", "t.token").agg(F.sum("t.weight").alias("f"))
    holding = places.groupBy("site_id", "token").agg(F.count("*").alias("n"))
    rows = places.hint("merge").join(holding, ["site_id", "token"]).join(F.broadcast(sites), "site_id")  # one row for each site
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    return rows.select("site_id", "token", "sku", (idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))).alias("impact"))


def bm25_scores(found: DataFrame, plans: DataFrame, stored_impacts: DataFrame) -> DataFrame:
    """(query_id, sku, bm25): the sum of the impacts of all words of a plan's terms in the documents found for it. Words of several terms count once for each."""
    words = plans.select("query_id", "site_id", F.explode("surfaces").alias("s")).select("query_id", "site_id", F.explode("s.words").alias("w"))
    slot = F.pmod(F.xxhash64("sku"), F.lit(PARTS)).cast("int")
    words = words.select("query_id", "site_id", "w.token").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = words.join(stored_impacts.withColumn("slot", slot).hint("merge"), ["site_id", "token", "slot"])
    hits = found.where("missed is null").select("query_id", "sku")
    return rows.join(hits.hint("merge"), ["query_id", "sku"], "left_semi").groupBy("query_id", "sku").agg(F.sum("impact").alias("bm25"))


# Rescue of requests that find nothing (R8) -------------------------------------------------------------

NO_RANGES = "array<struct<field:string,least:double,most:double>>"
NO_CONSTRAINTS = "array<struct<kind:string,field:string,value:string,source:string>>"
NO_LENGTHS = "array<struct<field:string,inches:double>>"


def attempts(empty: DataFrame, corrections: DataFrame, directory: DataFrame) -> DataFrame:
    """All that may be tried for requests that found nothing, as plans with `attempt` (the order) and `strategy`; query_id stays that of the request.

    1 spell_correct: unknown terms by their corrections. 2 drop_entity: what was understood without the
    other words; then with fewer and fewer attributes; without the brand; the brand alone. 3 relax_query:
    the shortest term after the other goes. 4 category_fallback: the category that was named, else the one
    whose path holds the most letters of the terms. 5 best_sellers of the site. From 2 on, but for 3, the
    shopper's own filters go, and relevance becomes best_selling.

    empty: plans; corrections: (site_id, term, correction); directory: (site_id, category_id, path).
    """
    base = empty.drop("surfaces")
    none = {"terms": F.array().cast(STRINGS), "dimensions": F.array().cast(NO_LENGTHS), "sku": F.lit(None).cast("string"), "labels": F.create_map().cast(MAP), "ranges": F.array().cast(NO_RANGES), "collection": F.lit(None).cast("string"), "category_id": F.lit(None).cast("string"), "filters": F.create_map().cast(MAP), "sort": F.when(F.col("sort") == "relevance", "best_selling").otherwise(F.col("sort"))}
    bare = base.withColumns(none)
    brand = F.filter("constraints", lambda c: c["kind"] == "brand")
    attributes = F.filter("constraints", lambda c: c["kind"] == "attribute")
    named = F.get(F.filter("constraints", lambda c: c["kind"] == "category"), 0)["value"]
    as_filters = lambda cs: F.map_from_entries(F.transform(cs, lambda c: F.struct(c["field"].alias("k"), F.array(c["value"]).alias("v"))))
    step = lambda rows, n, strategy: rows.withColumn("attempt", n if isinstance(n, Column) else F.lit(n)).withColumn("strategy", F.lit(strategy))

    words = base.where("sku is null").select("query_id", "site_id", F.posexplode("terms").alias("i", "term")).join(corrections, ["site_id", "term"], "left")
    words = words.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("correction", "term").alias("w")))), lambda s: s["w"]).alias("fixed"), F.count("correction").alias("changed")).where("changed > 0")
    spelled = step(base.join(words, "query_id").withColumn("terms", F.col("fixed")).drop("fixed", "changed"), 100, "spell_correct")

    understood = bare.where(F.size(F.filter("constraints", lambda c: c["kind"].isin("brand", "category", "attribute"))) > 0)
    left = empty.select("query_id", F.size("terms").alias("n_terms"))
    understood = understood.join(left, "query_id")
    whole = step(understood.where("n_terms > 0").withColumns({"filters": as_filters(F.concat(brand, attributes)), "category_id": named}), 200, "drop_entity")
    fewer = understood.where(F.size(attributes) > 1).withColumn("keep", F.explode(F.sequence(F.lit(1), F.size(attributes) - 1)))
    fewer = step(fewer.withColumns({"filters": as_filters(F.concat(brand, F.slice(attributes, F.lit(1), F.col("keep")))), "category_id": named}), 220 - F.col("keep"), "drop_entity").drop("keep")
    both = understood.where((F.size(brand) > 0) & named.isNotNull())
    dropped = step(both.withColumn("category_id", named), 230, "drop_entity").unionByName(step(both.withColumn("filters", as_filters(brand)), 231, "drop_entity"))

    shorter = base.where((F.size("terms") > 1) & F.col("sku").isNull()).withColumn("steps", F.explode(F.sequence(F.lit(1), F.size("terms") - 1)))
    # After s steps the s shortest terms are gone; of equal ones the first goes first.
    order = F.transform(F.array_sort(F.transform("terms", lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i")))), lambda s: s["i"])
    gone = F.slice(order, F.lit(1), F.col("steps"))
    shorter = step(shorter.withColumn("gone", gone).withColumn("terms", F.filter("terms", lambda t, i: ~F.array_contains(F.col("gone"), i))), 300 + F.col("steps"), "relax_query").drop("gone", "steps")

    asked = base.where(named.isNull()).select("site_id", F.explode("terms").alias("term")).distinct()
    # Category paths are a site's shelf marks; terms meet the three-letter pieces of theirs.
    pieces = lambda text: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))
    paths = directory.select("site_id", "category_id", F.lower(F.array_join("path", " ")).alias("text"))
    short = asked.where(F.length("term") < 3).join(paths, "site_id").where(F.col("text").contains(F.col("term"))).select("site_id", "term", "category_id")
    long = asked.where(F.length("term") >= 3).withColumn("piece", F.substring("term", 1, 3)).join(paths.withColumn("piece", F.explode(pieces(F.col("text")))), ["site_id", "piece"])
    inside = long.where(F.col("text").contains(F.col("term"))).select("site_id", "term", "category_id").unionByName(short)
    near = base.where(named.isNull()).select("query_id", "site_id", F.explode("terms").alias("term")).join(inside, ["site_id", "term"]).groupBy("query_id", "category_id").agg(F.sum(F.length("term")).alias("letters"))
    near = near.groupBy("query_id").agg(F.min_by("category_id", F.struct(-F.col("letters"), "category_id")).alias("nearest"))
    fallback = bare.join(near, "query_id", "left").withColumn("category_id", F.coalesce(named, "nearest")).drop("nearest").where("category_id is not null")
    last = step(fallback, 400, "category_fallback").unionByName(step(bare, 500, "best_sellers"))
    every = spelled.unionByName(shorter).unionByName(last)
    return every.unionByName(whole.drop("n_terms")).unionByName(fewer.drop("n_terms")).unionByName(dropped.drop("n_terms"))


def same_plan() -> Column:
    """One text for all plans that ask the same."""
    ordered = lambda c: F.sort_array(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), F.sort_array(e["value"]).alias("v")))) if c in ("filters", "labels") else F.col(c)
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.to_json(F.array(ordered(c))), F.lit("")).alias(c) for c in PLAN])), 256)


def distinct_plans(plans: DataFrame) -> DataFrame:
    """One plan for each plan_id, with it as query_id: what many requests ask is looked up once."""
    rows = plans.groupBy("plan_id").agg(*[F.first(F.struct(c)).alias(c) for c in PLAN])
    return rows.select(F.col("plan_id").alias("query_id"), *[F.col(f"{c}.{c}").alias(c) for c in PLAN])


#: What a plan's documents depend on.
PLAN = ["site_id", "terms", "filters", "labels", "ranges", "category_id", "collection", "dimensions", "sku", "sort"]


def first_success(tries: DataFrame, index: DataFrame, sizes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Of each request's attempts the first that finds a document. All attempts are looked up in one pass over their shortest lists, equal ones of different requests once."""
    probes = stored(with_surfaces(stored(distinct_plans(tries), "probes"), vocabulary), "probes")
    hits = found_documents(probes, index, sizes, facets=False).select(F.col("query_id").alias("plan_id")).distinct()
    return tries.join(hits, "plan_id", "left_semi").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("attempt"))).where("n = 1").drop("n")


def search(plans: DataFrame, index: DataFrame, vocabulary: DataFrame, corrections: DataFrame | None = None, directory: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(answers, plans, found, parents) of all requests. answers: (query_id, plan_id, strategy), the plan that answers each request, with the strategy that rescued it (null: none was needed); plans, found and parents have the plan's identifier as query_id.

    Requests that ask the same share a plan. With corrections and directory, requests that find nothing
    are rescued. Plans and found documents are stored, since pages, totals and facets read them.
    """
    sizes = stored(list_sizes(index), "list_sizes")
    asked = stored(plans.withColumn("plan_id", same_plan()), "asked")
    first = stored(with_surfaces(distinct_plans(asked), vocabulary), "plans")
    found = stored(found_documents(first, index, sizes), "found")
    answers = asked.select("query_id", "plan_id", F.lit(None).cast("string").alias("strategy"))
    if corrections is None:
        return answers, first, found, found_parents(found)
    full = found.where("missed is null").select(F.col("query_id").alias("plan_id")).distinct()
    empty = asked.join(full, "plan_id", "left_anti").where("type <> 'empty'").drop("plan_id")
    tries = stored(attempts(empty, corrections, directory).withColumn("plan_id", same_plan()), "attempts")
    rescued = stored(first_success(tries, index, sizes, vocabulary), "rescued")
    known = first.select(F.col("query_id").alias("plan_id"))
    new = stored(with_surfaces(stored(distinct_plans(rescued.join(known, "plan_id", "left_anti")), "new_plans"), vocabulary), "new_plans")
    again = stored(found_documents(new, index, sizes), "found_again")
    answers = answers.join(rescued.select("query_id"), "query_id", "left_anti").unionByName(rescued.select("query_id", "plan_id", "strategy"))
    found = found.unionByName(again)
    return answers, first.unionByName(new), found, found_parents(found)
