"""Product feeds: reading (S1, S2), mapping (S3), normalising (I1), quality (I2), exporting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.measure import attribute_inches, to_boolean, to_number
from ..functions.store import stored
from ..functions.text import split_multi

# Source headings of each schema field, the attributes worth a facet, and plumbing columns.
ALIASES: dict[str, list[str]] = {
    "sku": ["sku", "item name/number", "item name", "itemid", "internal id", "item", "part number", "uid", "product id"],
    "mpn": ["mpn", "manufacturer part number", "mfg part number", "vendor code", "mfrpartnumber"],
    "parentId": ["parent", "parent item", "parent sku", "matrix parent", "item group", "product id"],
    "title": ["title", "display name", "name", "product name", "storedisplayname"],
    "variantTitle": ["variant", "variant title", "matrix option", "option"],
    "description": ["description", "sales description", "store description", "detailed description"],
    "brand": ["brand", "manufacturer", "vendor"],
    "categoryPath": ["category hierarchy", "category", "category path", "commerce category", "class", "web category", "categories"],
    "price": ["price", "base price", "list price", "msrp"],
    "salePrice": ["sale price", "online price", "special price", "promo price"],
    "inventory": ["inventory", "quantity available", "qty available", "available", "stock", "quantity", "stock status"],
    "image": ["image", "image url", "imageurl", "primary image", "main image", "thumbnailimageurl", "thumbnail image url"],
    "images": ["images", "image urls", "gallery", "additional images", "alternate images", "secondary images"],
    "reviewScore": ["review score", "rating", "avg rating", "stars", "reviewsaverage"],
    "reviewCount": ["review count", "reviews", "num reviews", "reviewscount"],
    "salesVelocity": ["sales velocity", "units sold", "qty sold", "sales rank", "velocity", "popularity"],
    "margin": ["margin", "margin %", "gross margin", "markup"],
    "dateAdded": ["date added", "created date", "date created", "first available"],
    "tags": ["tags", "keywords", "labels"],
    "discontinued": ["discontinued", "inactive", "is inactive"],
}
FACET_HINTS = ["finish", "color", "colour", "material", "style", "size", "length", "width", "height", "depth", "thickness", "profile", "species", "texture", "mount"]
IGNORED = [r"^internal ?id$", r"^external ?id$", r"^record ?(id|type)$", r"^(date )?last modified", r"^(date )?created (by|from)", r"^modified by$", r"^_", r"^unnamed", r"^column \d+$"]
DELIMITERS = ["\t", ",", "|", ";"]


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A delimited feed as texts. The delimiter is the one that the header line has most of (the first of tab, comma, bar and semicolon among equals); ragged rows and stray quotes are tolerated, blanks around values and empty lines dropped."""
    header = (spark.read.text(path).limit(1).collect() or [[""]])[0][0].lstrip("﻿")
    sep = max(DELIMITERS, key=header.count)
    return spark.read.options(sep=sep, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, unescapedQuoteHandling="STOP_AT_DELIMITER", mode="PERMISSIVE", escape='"').csv(path)


def with_row_numbers(rows: DataFrame, column: str = "row_ix") -> DataFrame:
    """Rows as read from files with their numbers from 0, in the order of the files' paths and of the rows in each.

    The rows are stored with the piece of the file they come from and their place in the task that read it.
    A piece is read by one task in order, so a row's number is the rows of all pieces before, plus its
    distance from the piece's first row: no sort and no window over rows. The table of pieces has a row for
    each split of the files and is broadcast.
    """
    read = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    read = stored(read, "feed")
    pieces = read.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("n"))
    pieces = pieces.select("__file", "__start", "__first", (F.sum("n").over(W.orderBy("__file", "__start")) - F.col("n")).alias("__before"))
    numbered = read.join(F.broadcast(pieces), ["__file", "__start"])
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__before") + F.col("__at") - F.col("__first")).alias(column))


def read_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A feed of JSON rows, all values as texts."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).json(path)


def canonical(header: str) -> str:
    return re.sub(r"[_\s]+", " ", re.sub(r"^custom item field:\s*", "", header.lower())).strip()


def infer_mapping(columns: list[str], overrides: dict[str, str] | None = None) -> dict:
    """fields: schema field to column; attributes: name to column; facetable attributes; parent column. Only headings are looked at."""
    by_name = {canonical(c): c for c in columns}
    fields = {field: next(by_name[a] for a in names if a in by_name) for field, names in ALIASES.items() if any(a in by_name for a in names)}
    fields |= overrides or {}
    claimed = set(fields.values())
    attributes = {name: c for name, c in by_name.items() if c not in claimed and not any(re.search(p, name) for p in IGNORED)}
    facetable = [a for a in attributes if any(a == h or a.startswith(h) or a.endswith(h) for h in FACET_HINTS)]
    return {"fields": fields, "attributes": attributes, "facetable": facetable, "parent": fields.get("parentId") or fields.get("sku") or columns[0]}


def map_feed(rows: DataFrame, mapping: dict, category_delimiter: str = ">") -> DataFrame:
    """Feed rows as variants: a column for each schema field, typed, and the map attrs of the other columns' values that are not empty."""
    text = lambda f: F.trim(F.coalesce(F.col(f"`{mapping['fields'][f]}`"), F.lit(""))) if f in mapping["fields"] else F.lit("")
    numbers = ["price", "salePrice", "inventory", "reviewScore", "reviewCount", "salesVelocity", "margin"]
    columns: list[Column] = [text(f).alias(f) for f in ("sku", "mpn", "title", "variantTitle", "description", "brand", "image", "dateAdded")]
    columns += [to_number(text(f)).alias(f) for f in numbers]
    columns += [split_multi(text("categoryPath"), category_delimiter).alias("categoryPath"), split_multi(text("tags"), ",").alias("tags"), to_boolean(text("discontinued")).alias("discontinued")]
    parent = F.trim(F.coalesce(F.col(f"`{mapping['parent']}`"), F.lit("")))
    pairs = F.array(*[F.struct(F.lit(name).alias("key"), F.trim(F.col(f"`{c}`")).alias("value")) for name, c in mapping["attributes"].items()]) if mapping["attributes"] else F.array().cast("array<struct<key:string,value:string>>")
    inches = F.transform(pairs, lambda p: F.struct(F.concat(p["key"], F.lit("_in")).alias("key"), attribute_inches(p["key"], p["value"]).alias("value")))
    columns.append(F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")).alias("attrs"))
    columns.append(F.map_from_entries(F.filter(inches, lambda p: p["value"].isNotNull())).alias("attrs_in"))
    return rows.select("row_ix", F.when(parent != "", parent).otherwise(text("sku")).alias("parent_id"), *columns)


def normalise_feed(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, rejects (row, sku, reason)) of mapped rows, first reason first: missing SKU, duplicate SKU (of a row before), no title. The row is counted as in the file, the header being the first. A missing price is 0 and marked."""
    first = F.min("row_ix").over(W.partitionBy("sku"))
    reason = F.when(F.col("sku") == "", "missing SKU").when(F.col("row_ix") > first, "duplicate SKU").when(F.col("title") == "", "no title")
    marked = mapped.withColumn("reason", reason)
    good = marked.where("reason is null").drop("reason").withColumn("missing_price", F.col("price").isNull()).fillna({"price": 0.0})
    return good, marked.where("reason is not null").select((F.col("row_ix") + 2).alias("row"), "sku", "reason")


def quality_report(variants: DataFrame, rejects: DataFrame) -> DataFrame:
    """(check, key): offending parents or SKUs of each check, and the rejected rows."""
    parents = variants.groupBy("parent_id").agg(F.max(F.col("image") != "").alias("has_image"), F.max(F.length(F.trim("description"))).alias("described"), F.max(F.size("categoryPath")).alias("depth"))
    checks = [
        parents.where("not has_image").select(F.lit("missingImages").alias("check"), F.col("parent_id").alias("key")),
        parents.where("described < 20").select(F.lit("emptyDescriptions"), "parent_id"),
        parents.where("depth < 1").select(F.lit("uncategorised"), "parent_id"),
        variants.where("missing_price").select(F.lit("missingPrice"), "sku"),
        rejects.where("reason = 'duplicate SKU'").select(F.lit("duplicateSkus"), "sku"),
        rejects.select(F.lit("rejected"), F.col("row").cast("string")),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.union(more)
    return out


def export_csv(df: DataFrame, path: str) -> None:
    """With a header, quoted where needed, nulls empty."""
    df.write.mode("overwrite").options(header=True, escape='"', nullValue="", emptyValue="").csv(path)
