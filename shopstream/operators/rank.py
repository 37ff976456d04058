"""Ranking: text signals (R3), business score (R4), the cascade (W2), cards (W3), pages (W4), tie bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import clamp01, half_up, log_share, recency
from .retrieve import best_expansion, weight_of

# Weights of the business signals; ceilings of the logarithmic ones; availability.
BUSINESS = {"salesVelocity": 3, "margin": 2, "inventoryDepth": 1, "recency": 1, "reviewScore": 2, "ctr": 2}
VELOCITY_CEILING, INVENTORY_CEILING = 1000, 500
SOLD_OUT, DISCONTINUED = 0.35, 0.15
CASCADE = ["typos", "words_matched", "best_field_weight", "proximity", "exactness", "business", "retrieval"]


def text_signals(matches: DataFrame, n_terms: DataFrame) -> DataFrame:
    """(query_id, sku, typos, words_matched, best_field_weight, proximity, exactness).

    For each field the first place of each term's best word; proximity is the span beyond the number of
    words found. exactness: 2 all words exact, 1 some only as prefixes, 0 some with typos. The best field
    has the largest weight, then the least proximity, then the largest exactness. n_terms is unused rows
    of other queries' sizes: (query_id, n_terms).
    """
    best = best_expansion(matches)
    words = best.groupBy("query_id", "sku").agg(F.sum("distance").alias("typos"), F.count("*").alias("words_matched"))
    placed = matches.join(best.select("query_id", "sku", "term", "token"), ["query_id", "sku", "term", "token"])
    placed = placed.groupBy("query_id", "sku", "field", "term", "kind").agg(F.min("position").alias("position"))
    exact = F.when(F.count_if(F.col("kind") == 1) > 0, 0).when(F.count_if(F.col("kind") == 2) > 0, 1).otherwise(2)
    fields = placed.groupBy("query_id", "sku", "field").agg((F.max("position") - F.min("position") + 1 - F.count("*")).alias("proximity"), exact.alias("exactness"))
    fields = fields.withColumn("weight", weight_of(F.col("field"))).where("weight > 0")
    top = fields.groupBy("query_id", "sku").agg(F.max(F.struct("weight", (-F.col("proximity")).alias("near"), "exactness")).alias("t"))
    rows = words.join(top, ["query_id", "sku"]).join(n_terms, "query_id")
    return rows.select("query_id", "sku", "typos", "words_matched", F.col("t.weight").alias("best_field_weight"), (-F.col("t.near")).alias("proximity"), F.col("t.exactness").alias("exactness"))


def business_score(docs: DataFrame, as_of: Column, weights: dict[str, int] = BUSINESS) -> DataFrame:
    """docs with `business` (0 to 1) and its breakdown: weighted mean of the signals, times availability. Columns sales_velocity, margin, inventory, date_added, review_score, ctr and mean (null: unknown) and discontinued are used."""
    relative = F.when((F.col("mean") > 0) & F.col("ctr").isNotNull(), F.least(0.5 * F.col("ctr") / F.col("mean"), F.lit(1.0))).otherwise(0.5)
    signals = {
        "salesVelocity": log_share(F.col("sales_velocity"), VELOCITY_CEILING),
        "margin": clamp01(F.coalesce(F.col("margin"), F.lit(0.0)) / 100),
        "inventoryDepth": log_share(F.col("inventory").cast("double"), INVENTORY_CEILING),
        "recency": recency(F.col("date_added"), as_of),
        "reviewScore": clamp01(F.coalesce(F.col("review_score"), F.lit(0.0)) / 5),
        "ctr": relative,
    }
    used = {k: w for k, w in weights.items() if w}
    total = sum((signals[k] * w for k, w in used.items()), F.lit(0.0))
    buyable = F.when(F.col("discontinued"), DISCONTINUED).when(F.col("inventory") > 0, 1.0).otherwise(SOLD_OUT)
    breakdown = F.map_from_arrays(F.array(*[F.lit(k) for k in used]), F.array(*[half_up(signals[k] * w, 4) for k, w in used.items()]))
    return docs.withColumn("business", half_up(total / sum(used.values()) * buyable, 4)).withColumn("breakdown", breakdown)


def cascade_order() -> list[Column]:
    return [F.asc("typos"), F.desc("words_matched"), F.desc("best_field_weight"), F.asc("proximity"), F.desc("exactness"), F.desc("business"), F.desc("retrieval"), F.asc("sku")]


def rank_cascade(candidates: DataFrame) -> DataFrame:
    """candidates with rank (from 1) and final_score = 1 - (rank - 1) / n to four places, for each query."""
    rows = candidates.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*cascade_order())))
    n = F.count("*").over(W.partitionBy("query_id"))
    return rows.withColumn("final_score", half_up(1 - (F.col("rank") - 1) / n, 4))


def band_key() -> Column:
    """The textual tie band of a candidate."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in CASCADE[:5]])


def group_by_parent(ranked: DataFrame, siblings: int = 8) -> DataFrame:
    """One card for each query and parent, in order of first appearance: its best variant, how many match, and the first siblings."""
    parent = W.partitionBy("query_id", "parent_id")
    rows = ranked.withColumn("in_parent", F.row_number().over(parent.orderBy("rank"))).where(F.col("in_parent") <= siblings)
    counts = ranked.groupBy("query_id", "parent_id").agg(F.count("*").alias("matching"))
    cards = rows.groupBy("query_id", "parent_id").agg(F.min("rank").alias("first_rank"), F.min_by("sku", "rank").alias("sku"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "sku"))), lambda s: s["sku"]).alias("variants"))
    cards = cards.join(counts, ["query_id", "parent_id"])
    return cards.withColumn("card", F.row_number().over(W.partitionBy("query_id").orderBy("first_rank")))


def paginate(cards: DataFrame, page: int, per_page: int) -> DataFrame:
    return cards.where(F.col("card").between((page - 1) * per_page + 1, page * per_page))


def page_counts(totals: DataFrame, per_page: int, window: int) -> DataFrame:
    """totals (with `total`, the products of each request after its rule) with `reachable`, as many as can be paged to, and `pages`, at least 1."""
    reachable = F.least(F.col("total"), F.lit(max(per_page, window)).cast("long"))
    return totals.withColumn("reachable", reachable).withColumn("pages", F.greatest(F.ceil(F.col("reachable") / per_page), F.lit(1)).cast("long"))
