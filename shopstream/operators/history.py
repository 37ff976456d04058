"""Audit history: differences (F24, D10) and undoing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Keys that change with every write, kinds that can be put back, and kinds whose change needs the catalogue labelled anew.
NOISE = ["id", "createdAt", "updatedAt", "siteId"]
UNDOABLE = ["collection", "attribute", "badge", "synonym", "redirect"]
RELABELLED = ["collection", "attribute", "badge"]


def json_diff(before: Column, after: Column, noise: list[str] = NOISE) -> Column:
    """array<struct<field, before, after>> of the keys whose values differ, by name. Missing and null are alike."""
    old, new = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (before, after))
    keys = F.array_sort(F.array_except(F.array_union(F.map_keys(old), F.map_keys(new)), F.array(*[F.lit(k) for k in noise])))
    rows = F.transform(keys, lambda k: F.struct(k.alias("field"), F.try_element_at(old, k).alias("before"), F.try_element_at(new, k).alias("after")))
    return F.filter(rows, lambda r: ~r["before"].eqNullSafe(r["after"]))


def audit_diff(audit: DataFrame) -> DataFrame:
    """Audit rows with their changes, and whether they can be undone and why not. An undoing is a change like others and can be undone itself."""
    reason = F.when(~F.coalesce(F.col("entity").isin(UNDOABLE), F.lit(False)), "not of a kind that can be put back").when(F.col("entity_id").isNull(), "of no entity").when(F.col("before").isNull() & F.col("after").isNull(), "without a state")
    return audit.withColumn("changes", json_diff(F.col("before"), F.col("after"))).withColumn("refused", reason).withColumn("revertible", reason.isNull())


def newest_changes(audit: DataFrame, most: int = 500) -> DataFrame:
    """The newest `most` entries of each site's audit log, with `place` from 1 (newest first, of one time the larger id first), and what audit_diff says of them. audit: with site_id and created_at. Each task keeps its own newest before the shuffle."""
    place = F.row_number().over(W.partitionBy("site_id").orderBy(F.desc("created_at"), F.desc("audit_id")))
    return audit_diff(audit.withColumn("place", place).where(F.col("place") <= most))


def inverse_changes(audit: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows to append that undo the given entries: before and after swapped. ids: (audit_id)."""
    rows = audit_diff(audit).where("revertible").join(ids, "audit_id", "left_semi")
    return rows.select(F.col("audit_id").alias("reverts"), "entity", "entity_id", F.lit("revert").alias("action"), F.col("after").alias("before"), F.col("before").alias("after"), F.when(F.col("before").isNull(), "removed").otherwise("restored").alias("outcome"), F.col("entity").isin(RELABELLED).alias("reindex_required"))
