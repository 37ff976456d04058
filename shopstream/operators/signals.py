"""Click-through of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import days_back


def product_ctr(product_days: DataFrame, as_of: Column, days: int = 30, k: float = 50.0) -> DataFrame:
    """(site_id, sku, impressions, clicks, mean, ctr): click-through shrunk towards the site's mean as by k impressions."""
    rows = product_days.where(F.col("day") >= days_back(as_of, days - 1)).groupBy("site_id", "sku").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")).where("impressions > 0")
    mean = rows.groupBy("site_id").agg((F.sum("clicks") / F.sum("impressions")).alias("mean"))  # a row for each site
    return rows.join(mean, "site_id").withColumn("ctr", (F.col("clicks") + k * F.col("mean")) / (F.col("impressions") + k))
