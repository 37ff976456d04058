"""Retrieval for a whole query log: postings (R1), term expansion (J9, J10), matching (J11), filters (P1-P8), scores (R2) and the candidate window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import edit_distance, typo_budget

# Weights of the searchable fields.
WEIGHTS = {"title": 10, "sku": 9, "mpn": 9, "brand": 7, "categoryPath": 6, "attributes": 5, "variantTitle": 4, "description": 2}
TOKENS = "[^a-z0-9]+"
#: Parts of a word's postings that are joined on their own: a frequent word is no single task.
PARTS = 32


def postings(docs: DataFrame, fields: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """(site_id, sku, parent_id, the columns `keep`, field, token, position): every word of every field, positions from 0."""
    keep = keep or []
    texts = F.array(*[F.struct(F.lit(name).alias("field"), F.filter(F.split(F.lower(text), TOKENS), lambda t: t != "").alias("tokens")) for name, text in fields.items()])
    rows = docs.select("site_id", "sku", "parent_id", *keep, F.explode(texts).alias("f"))
    return rows.select("site_id", "sku", "parent_id", *keep, "f.field", F.posexplode("f.tokens").alias("position", "token"))


def bigrams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2))))


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, limit: int = 12, by: list[str] | None = None) -> DataFrame:
    """(term, token, distance and the columns `by`): vocabulary words within the typo budget of each term, at most `limit`, nearest first, then shortest, then by name.

    Words are blocked by shared bigrams: an edit spoils at most two, so a word within the budget shares at
    least max(1, bigrams - 2 * budget) of the term's. terms: (term), vocabulary: (token), both with the
    columns `by`, such as site_id, which must be equal.
    """
    by = by or []
    wanted = terms.select(*by, "term").distinct().withColumn("budget", typo_budget(F.col("term"))).where("budget > 0").withColumn("grams", bigrams(F.col("term")))
    wanted = wanted.select(*by, "term", "budget", F.greatest(F.size("grams") - 2 * F.col("budget"), F.lit(1)).alias("least"), F.explode("grams").alias("gram"))
    known = vocabulary.select(*by, "token").distinct().select(*by, "token", F.explode(bigrams(F.col("token"))).alias("gram"))
    # Spark takes exploded rows for as small as the file they come from, and would send them through the driver: such sides ask for a merge join.
    near = wanted.join(known.hint("merge"), [*by, "gram"]).where(F.abs(F.length("term") - F.length("token")) <= F.col("budget"))
    near = near.groupBy(*by, "term", "token", "budget", "least").agg(F.count("*").alias("shared")).where("shared >= least")
    near = near.withColumn("distance", edit_distance(F.col("term"), F.col("token"), 2)).where("distance <= budget and distance > 0")
    rank = F.row_number().over(W.partitionBy(*by, "term").orderBy("distance", F.length("token"), "token"))
    return near.withColumn("n", rank).where(F.col("n") <= limit).select(*by, "term", "token", "distance")


def prefix_terms(terms: DataFrame, vocabulary: DataFrame, limit: int | None = 8, by: list[str] | None = None) -> DataFrame:
    """(term, token and the columns `by`): the first `limit` vocabulary words (None: all) that go on from a term of three letters or more, joined on the first three."""
    by = by or []
    wanted = terms.select(*by, "term").distinct().where(F.length("term") >= 3).withColumn("head", F.substring("term", 1, 3))
    known = vocabulary.select(*by, "token").distinct().withColumn("head", F.substring("token", 1, 3))
    found = wanted.join(known.hint("merge"), [*by, "head"]).where(F.col("token").startswith(F.col("term")) & (F.col("token") != F.col("term")))
    if limit is None:
        return found.select(*by, "term", "token")
    rank = F.row_number().over(W.partitionBy(*by, "term").orderBy("token"))
    return found.withColumn("n", rank).where(F.col("n") <= limit).select(*by, "term", "token")


def expansions(terms: DataFrame, vocabulary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(term, token, distance, kind and the columns `by`): the term itself, fuzzy and prefix words; of a token reached twice the better kind (0 exact, 1 fuzzy, 2 prefix)."""
    by = by or []
    own = terms.select(*by, "term").distinct().select(*by, "term", F.col("term").alias("token"), F.lit(0).alias("distance"), F.lit(0).alias("kind"))
    fuzzy = fuzzy_terms(terms, vocabulary, by=by).withColumn("kind", F.lit(1))
    prefix = prefix_terms(terms, vocabulary, by=by).select(*by, "term", "token", F.lit(0).alias("distance"), F.lit(2).alias("kind"))
    best = F.min(F.struct("kind", "distance")).alias("b")
    return own.unionByName(fuzzy).unionByName(prefix).groupBy(*by, "term", "token").agg(best).select(*by, "term", "token", "b.distance", "b.kind")


def query_terms(queries: DataFrame, terms: str = "terms", keep: list[str] | None = None) -> DataFrame:
    """(query_id, term, n_terms and the columns `keep`) of queries (query_id, terms)."""
    distinct = F.array_distinct(F.col(terms))
    return queries.select("query_id", F.explode(distinct).alias("term"), F.size(distinct).alias("n_terms"), *(keep or []))


def match_terms(queries: DataFrame, index: DataFrame, expanded: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(query_id, sku, term, token, field, position, distance, kind): postings that a query's terms reach, of documents in which every term is found. Columns `within`, such as site_id or a category, must be equal in query and posting."""
    part = F.pmod(F.xxhash64("sku"), F.lit(PARTS)).cast("int")
    asked = query_terms(queries, keep=within).join(expanded, "term").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # Pairs of a query and a document are far more than postings: a word meets queries once for each document, its places follow as a list, and what is met is shuffled once.
    places = F.collect_list(F.struct("field", "position")).alias("places")
    words = index.groupBy(*[c for c in index.columns if c not in ("field", "position")]).agg(places).withColumn("part", part)
    hits = asked.join(words.hint("merge"), ["token", "part", *(within or [])]).drop("part")
    found = F.size(F.collect_set("term").over(W.partitionBy("query_id", "sku")))
    hits = hits.withColumn("found", found).where("found = n_terms and query_id is not null and sku is not null").drop("found")
    return hits.withColumn("place", F.explode("places")).select(*[c for c in hits.columns if c != "places"], "place.field", "place.position")


def best_expansion(matches: DataFrame) -> DataFrame:
    """For each query, document and term the best word: exact before fuzzy before prefix, then by distance and name."""
    best = F.min(F.struct("kind", "distance", "token")).alias("b")
    return matches.groupBy("query_id", "sku", "term").agg(best).select("query_id", "sku", "term", "b.token", "b.kind", "b.distance")


def weight_of(field: Column, weights: dict[str, int] = WEIGHTS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), field), F.lit(0))


def retrieval_score(matches: DataFrame) -> DataFrame:
    """(query_id, sku, retrieval): for each term and field it is found in, the field's weight."""
    found = matches.select("query_id", "sku", "term", "field").distinct()
    return found.groupBy("query_id", "sku").agg(F.sum(weight_of(F.col("field"))).alias("retrieval"))


def facet_filter(selected: dict[str, list[str]], columns: dict[str, Column]) -> Column:
    """Any of the values within a field, all of the fields; in_stock takes 0, 1, true and false."""
    test = F.lit(True)
    for field, values in selected.items():
        if field == "in_stock":
            wanted = [v.lower() in ("1", "true") for v in values]
            test = test & columns[field].isin(wanted)
        else:
            test = test & F.coalesce(columns.get(field, F.lit(None)).cast("string").isin(values), F.lit(False))
    return test


def range_filter(ranges: list[tuple[str, float | None, float | None]], columns: dict[str, Column]) -> Column:
    """All ranges, ends included; unknown fields are ignored."""
    test = F.lit(True)
    for field, least, most in ranges:
        if field in columns:
            test = test & (columns[field] >= least if least is not None else F.lit(True)) & (columns[field] <= most if most is not None else F.lit(True))
    return test


def category_filter(category_id: str) -> Column:
    return F.array_contains("category_ids", category_id)


def label_filter(selected: dict[str, list[str]], labels: str = "labels") -> Column:
    """Any of the labels key:value within a key, all of the keys; collections are labels too."""
    test = F.lit(True)
    for key, values in selected.items():
        test = test & F.arrays_overlap(F.col(labels), F.array(*[F.lit(f"{key}:{v}") for v in values]))
    return test


def part_number_filter(query: Column) -> Column:
    return F.upper("sku").startswith(F.upper(query))


def dimension_filter(axis: str, inches: float, columns: dict[str, Column], within: float = 0.03) -> Column:
    """Axis within a tolerance of a length; width and height fall back to size, any_dimension_in takes any axis."""
    near = lambda c: F.coalesce(F.abs(c - inches) < within, F.lit(False))
    get = lambda k: columns.get(k, F.lit(None).cast("double"))
    if axis == "any_dimension_in":
        test = F.lit(False)
        for k in ("width_in", "height_in", "length_in", "size_in"):
            test = test | near(get(k))
        return test
    value = F.coalesce(get(axis), get("size_in")) if axis in ("width_in", "height_in") else get(axis)
    return near(value)


def window_parents(scored: DataFrame, order: str = "retrieval", descending: bool = True, window: int = 240, rows: int | None = None) -> DataFrame:
    """Rows (query_id, parent_id, sku and the order column) of the best `window` parents of each query by their best variant, at most 8 rows for each parent of the window (6000 at most)."""
    best = (F.max if descending else F.min)(order).alias("best")
    parents = scored.groupBy("query_id", "parent_id").agg(best)
    direction = F.desc("best") if descending else F.asc("best")
    parents = parents.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(direction, "parent_id"))).where(F.col("place") <= window)
    cut = min(6000, 8 * window) if rows is None else rows
    out = scored.join(parents.select("query_id", "parent_id", "place"), ["query_id", "parent_id"])
    within = F.row_number().over(W.partitionBy("query_id").orderBy("place", F.desc(order) if descending else F.asc(order), "sku"))
    return out.withColumn("n", within).where(F.col("n") <= cut).drop("n")


def exclude_skus(docs: DataFrame, excluded: DataFrame) -> DataFrame:
    """docs without the excluded (site_id, sku); a null SKU excludes nothing."""
    return docs.join(excluded.select("site_id", "sku"), ["site_id", "sku"], "left_anti")


def filter_to_candidates(docs: DataFrame, parents: DataFrame, matches: DataFrame, test: Column) -> DataFrame:
    """(query_id, parent_id, sku, place): the matching variants of each query's candidate parents that pass the filters again (J17). parents: (query_id, parent_id, place); matches: (query_id, sku, ...); test: a condition on docs."""
    found = matches.select("query_id", "sku").distinct().join(docs.where(test).select("sku", "parent_id").hint("merge"), "sku")
    return found.join(parents.select("query_id", "parent_id", "place"), ["query_id", "parent_id"]).select("query_id", "parent_id", "sku", "place")
