"""Variant documents: maintenance (S6-S9, S14-S17), directory (A19) and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import discount_pct, effective_price
from ..functions.text import category_ids, vocabulary_words


def variant_docs(variants: DataFrame) -> DataFrame:
    """Variants as search documents: effective price, stock, category path and identifiers, searchable attribute text."""
    path = F.array("category_top", "category_leaf")
    return variants.select(
        "*",
        effective_price(F.col("price"), F.col("sale_price")).alias("effective_price"),
        discount_pct(F.col("price"), F.col("sale_price")).alias("discount_pct"),
        (F.col("inventory") > 0).alias("in_stock"),
        path.alias("category_path"),
        category_ids(path).alias("category_ids"),
        F.concat_ws(" ", "finish", F.concat(F.lit("finish:"), "finish")).alias("attribute_text"),
        F.create_map(F.lit("finish"), F.col("finish")).alias("attrs"),
    )


def apply_price_deltas(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """docs with the prices, sale prices and inventories of updates (site_id, sku, and each null to keep). Effective price and stock follow, the discount stays as it was indexed; unknown SKUs are ignored. Of several updates for a SKU the last by `at` counts."""
    last = updates.groupBy("site_id", "sku").agg(*[F.max_by(c, "at").alias(f"__{c}") for c in ("price", "sale_price", "inventory")])
    rows = docs.join(last, ["site_id", "sku"], "left").withColumns({c: F.coalesce(f"__{c}", c) for c in ("price", "sale_price", "inventory")})
    rows = rows.withColumns({"effective_price": effective_price(F.col("price"), F.col("sale_price")), "in_stock": F.col("inventory") > 0})
    return rows.select(docs.columns)


def upsert_docs(docs: DataFrame, new: DataFrame) -> DataFrame:
    """New documents in place of old ones with their (site_id, sku), the rest added."""
    return docs.join(new, ["site_id", "sku"], "left_anti").unionByName(new)


def delete_by_sku(docs: DataFrame, skus: DataFrame) -> DataFrame:
    return docs.join(skus, ["site_id", "sku"], "left_anti")


def deleted_count(docs: DataFrame, skus: DataFrame) -> DataFrame:
    """(site_id, deleted): how many documents of each site delete_by_sku takes out."""
    return docs.join(skus, ["site_id", "sku"], "left_semi").groupBy("site_id").agg(F.count("*").alias("deleted"))


POINTER = "CURRENT"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that readers see; None before the first is published."""
    fs, path = _files(spark, f"{folder}/{POINTER}")
    return spark.read.text(f"{folder}/{POINTER}").first()[0] if fs.exists(path) else None


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The current version's documents, as they were when this was called: a version published later does not change them."""
    version = current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no snapshot has been published in {folder}")
    return spark.read.parquet(f"{folder}/version={version}")


def publish_snapshot(docs: DataFrame, folder: str, version: str, view: str | None = None, keep: int = 1) -> None:
    """Writes a full build into a folder of its own, then makes it the current one.

    The pointer is a small file that is written beside and renamed over the old one, the only step that
    readers can see: they have the old version until then and the new one after. A build that dies before
    leaves the old version current, and its folder goes with the next publication. Versions beyond the
    `keep` before the new one are dropped then, so readers that began before can end. A version can't be
    published twice. One job at a time may publish into a folder.
    """
    spark = docs.sparkSession
    before = current_version(spark, folder)
    docs.write.mode("errorifexists").parquet(f"{folder}/version={version}")
    fs, base = _files(spark, folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    made, target = hadoop.Path(f"{folder}/.{POINTER}-{version}"), hadoop.Path(f"{folder}/{POINTER}")
    out = fs.create(made, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, target, over)
    found = [(s.getModificationTime(), s.getPath()) for s in fs.listStatus(base) if s.getPath().getName().startswith("version=")]
    stay = {f"version={version}"} | {p.getName() for _, p in sorted((f for f in found if f[1].getName() != f"version={version}" and fs.exists(hadoop.Path(f[1], "_SUCCESS"))), key=lambda f: (f[1].getName() != f"version={before}", -f[0]))[:keep]}
    for _, path in found:
        if path.getName() not in stay:
            fs.delete(path, True)
    if view:
        read_snapshot(spark, folder).createOrReplaceTempView(view)


def get_by_parent_ids(docs: DataFrame, wanted: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One document for each wanted parent, the first by ordinal, in the caller's order. wanted: (site_id, parent_id, place and what tells the requests apart); parents without documents are left out."""
    first = docs.join(wanted.select("site_id", "parent_id"), ["site_id", "parent_id"], "left_semi").groupBy("site_id", "parent_id").agg(F.min_by("sku", ordinal).alias("sku"))
    return wanted.join(first, ["site_id", "parent_id"]).select(*wanted.columns, "sku")


def sample_products(docs: DataFrame, n: int) -> DataFrame:
    """All documents of the first n parents by identifier, and each site's number of parents."""
    parents = docs.select("site_id", "parent_id").distinct()
    ranked = parents.withColumn("place", F.row_number().over(W.partitionBy("site_id").orderBy("parent_id"))).where(F.col("place") <= n)
    totals = parents.groupBy("site_id").agg(F.count("*").alias("total_products"))
    return docs.join(ranked, ["site_id", "parent_id"]).join(totals, "site_id")


def document_count(docs: DataFrame) -> DataFrame:
    return docs.groupBy("site_id").agg(F.count("*").alias("documents"))


def vocabulary(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(site_id, token): different words of three letters and digits or more in the given columns."""
    text = F.concat_ws(" ", *[F.col(c) for c in columns])
    return docs.select("site_id", F.explode(vocabulary_words(text)).alias("token")).distinct()


def category_directory(docs: DataFrame) -> DataFrame:
    """(site_id, category_id, depth, path, products): every level of every path."""
    rows = docs.select("site_id", "parent_id", "category_path", F.posexplode("category_ids").alias("i", "category_id"))
    path = F.array_join(F.slice("category_path", F.lit(1), F.col("i") + 1), " > ")
    return rows.groupBy("site_id", "category_id", (F.col("i") + 1).alias("depth"), path.alias("path")).agg(F.count_distinct("parent_id").alias("products"))


def brand_directory(docs: DataFrame) -> DataFrame:
    return docs.groupBy("site_id", "brand").agg(F.count_distinct("parent_id").alias("products"))


def sort_key(sort: str) -> list[Column]:
    """Order of a sort option over documents, ties by SKU."""
    keys = {
        "best_selling": F.desc("sales_velocity"), "newest": F.desc_nulls_last("date_added"), "price_asc": F.asc("effective_price"), "price_desc": F.desc("effective_price"),
        "top_rated": F.desc("review_score"), "discount": F.desc("discount_pct"),
    }
    return [keys[sort], F.asc("sku")]
