"""Facets: counts that ignore a facet's own selection (A16, A17), totals (A18), order (O2) and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def facet_counts(docs: DataFrame, facets: dict[str, Column], selected: dict[str, list[str]], limit: int = 200) -> DataFrame:
    """(facet, value, products): different parents with each value. A facet does not obey its own selection but all others.

    One pass: rows carry how many selections they miss; a value counts where nothing is missed, or only
    its own facet's selection.
    """
    misses = {k: (~F.coalesce(facets[k].cast("string").isin(v), F.lit(False))).cast("int") for k, v in selected.items()}
    total = reduce(lambda a, b: a + b, misses.values(), F.lit(0))
    values = F.array(*[F.struct(F.lit(k).alias("facet"), c.cast("string").alias("value"), misses.get(k, F.lit(0)).alias("own")) for k, c in facets.items()])
    rows = docs.select("parent_id", total.alias("missed"), F.explode(values).alias("f")).where("missed = f.own and f.value is not null")
    counts = rows.groupBy("f.facet", "f.value").agg(F.count_distinct("parent_id").alias("products"))
    rank = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("products"), "value"))
    return counts.withColumn("n", rank).where(F.col("n") <= limit).drop("n")


def price_range(docs: DataFrame) -> DataFrame:
    return docs.groupBy("site_id").agg(F.min("effective_price").alias("least"), F.max("effective_price").alias("most"))


def label_counts(docs: DataFrame, labels: str = "labels") -> DataFrame:
    """(label_key, value, products) of labels key:value."""
    parts = F.split("label", ":", 2)
    rows = docs.select("parent_id", F.explode(labels).alias("label"))
    return rows.groupBy(F.get(parts, 0).alias("label_key"), F.get(parts, 1).alias("value")).agg(F.count_distinct("parent_id").alias("products"))


def query_totals(matches: DataFrame) -> DataFrame:
    """(query_id, products, variants): everything a query reaches, not only its window."""
    return matches.groupBy("query_id").agg(F.count_distinct("parent_id").alias("products"), F.count_distinct("sku").alias("variants"))


def facet_stats(docs: DataFrame, numeric: dict[str, Column], facets: dict[str, Column], selected: dict[str, list[str]]) -> DataFrame:
    """(facet, least, most) of numeric fields over the documents that obey all selections; a field without a number has no row."""
    test = reduce(lambda a, b: a & b, [F.coalesce(facets[k].cast("string").isin(v), F.lit(False)) for k, v in selected.items()], F.lit(True))
    values = F.array(*[F.struct(F.lit(k).alias("facet"), c.cast("double").alias("value")) for k, c in numeric.items()])
    rows = docs.where(test).select(F.explode(values).alias("f")).where("f.value is not null")
    return rows.groupBy("f.facet").agg(F.min("f.value").alias("least"), F.max("f.value").alias("most"))


def value_label(facet: Column, value: Column) -> Column:
    """What a shopper reads for a stored value."""
    return F.when(facet == "in_stock", F.when(value == "1", "In Stock").otherwise("Out of Stock")).otherwise(value)


def sort_facet_values(counts: DataFrame, config: DataFrame, selected: DataFrame) -> DataFrame:
    """Values of each facet in the order its config asks for, cut to truncate_at but with the selected ones kept.

    config: (facet, sort_by, truncate_at, custom: array<string>); selected: (facet, value). sort_by count
    is products desc, value asc; alpha is by the number a label starts with, then by label; custom is by
    place in the list, others at the end as by count.
    """
    chosen = selected.distinct().withColumn("chosen", F.lit(True))
    rows = counts.join(config, "facet").join(chosen, ["facet", "value"], "left").fillna({"chosen": False}).withColumn("shown", value_label(F.col("facet"), F.col("value")))
    digits = F.regexp_extract("shown", r"^[0-9]+(\.[0-9]+)?", 0).try_cast("double")
    custom = F.coalesce(F.nullif(F.array_position("custom", F.col("value")), F.lit(0).cast("long")), F.lit(999).cast("long"))
    key = F.when(F.col("sort_by") == "alpha", F.coalesce(digits, F.lit(float("inf")))).when(F.col("sort_by") == "custom", custom.cast("double")).otherwise(F.lit(0.0))
    then = [F.when(F.col("sort_by") == "alpha", F.col("shown")), F.desc("products"), F.asc("value")]
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("facet").orderBy(key, *then)))
    return rows.where((F.col("truncate_at") == 0) | (F.col("place") <= F.col("truncate_at")) | F.col("chosen")).select("facet", "value", "products", "place", "chosen")


def build_facets(counts: DataFrame, stats: DataFrame, config: DataFrame, selected: DataFrame) -> DataFrame:
    """What a page shows (R9): (position, facet, label, display, attribute, place, value, value_label, products, chosen, least, most), one row for each value and one, without a value, for each slider.

    config: that of sort_facet_values with label, display, position and attribute (boolean). Values of a
    site's own facets are sorted and cut as configured, those of custom attributes stay in order of their
    counts and are not cut. Sliders need statistics. A facet without values has no row.
    """
    slider = (F.col("display") == "slider") & ~F.col("attribute")
    asked = config.where(~slider).withColumns({"sort_by": F.when(F.col("attribute"), "count").otherwise(F.col("sort_by")), "truncate_at": F.when(F.col("attribute"), 0).otherwise(F.col("truncate_at"))})
    head = config.select("position", "facet", "label", "display", "attribute")
    values = sort_facet_values(counts, asked.select("facet", "sort_by", "truncate_at", "custom"), selected).withColumn("value_label", value_label(F.col("facet"), F.col("value")))
    values = head.join(values, "facet").select("position", "facet", "label", "display", "attribute", "place", "value", "value_label", "products", "chosen")
    return values.unionByName(head.where(slider).join(stats, "facet"), allowMissingColumns=True)
