"""Selectors (P9): a rule tree of all, any and none over conditions, compiled to a Column; and whether a rule is live (P11, P13); label plans (J16, W8) and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scoring import effective_price

COMPARATORS = ["equals", "not_equals", "contains", "not_contains", "starts_with", "in", "not_in", "gt", "gte", "lt", "lte", "between", "exists", "missing"]
ARRAYS = {"tags", "category_path", "category_ids"}
DEEPEST = 5


def products(variants: DataFrame) -> DataFrame:
    """One row for each parent (A21): fields of its first variant by SKU, and the array of its variants in that order."""
    variant = F.struct("sku", "price", "sale_price", "inventory", "brand", "finish", "size_in")
    return variants.groupBy("site_id", "parent_id").agg(
        F.min_by("title", "sku").alias("title"), F.min_by("brand", "sku").alias("brand"), F.min_by(F.array("category_top", "category_leaf"), "sku").alias("category_path"),
        F.max("sales_velocity").alias("sales_velocity"), F.array_sort(F.collect_list(variant)).alias("variants"),
    )


def validate(tree: dict, depth: int = 1) -> None:
    """Refuses what can't be compiled, before any job starts."""
    if depth > DEEPEST:
        raise ValueError("a selector is nested too deeply")
    groups = [k for k in ("all", "any", "none") if k in tree]
    if groups:
        for k in groups:
            if not tree[k]:
                raise ValueError(f"an empty group: {k}")
            for child in tree[k]:
                validate(child, depth + 1)
    elif tree:
        if "field" not in tree or tree.get("op") not in COMPARATORS:
            raise ValueError(f"not a condition: {tree}")
        if tree["op"] not in ("exists", "missing") and tree.get("value") is None:
            raise ValueError(f"a condition without a value: {tree}")


def _number(value) -> float | None:
    try:
        return float(str(value).replace("$", "").replace(",", "").replace("%", "").replace(" ", ""))
    except ValueError:
        return None


def compare(actual: Column, op: str, value) -> Column:
    """One value against a condition. Texts are compared trimmed in lower case, orders as numbers; a null is only ever missing."""
    text = F.lower(F.trim(actual.cast("string")))
    fold = lambda v: str(v).strip().lower()
    number = F.regexp_replace(actual.cast("string"), r"[$,%\s]", "").try_cast("double")
    tests = {
        "equals": lambda: text == fold(value), "not_equals": lambda: text != fold(value),
        "contains": lambda: text.contains(fold(value)), "not_contains": lambda: ~text.contains(fold(value)), "starts_with": lambda: text.startswith(fold(value)),
        "in": lambda: text.isin([fold(v) for v in value]), "not_in": lambda: ~text.isin([fold(v) for v in value]),
        "gt": lambda: number > _number(value), "gte": lambda: number >= _number(value), "lt": lambda: number < _number(value), "lte": lambda: number <= _number(value),
        "between": lambda: number.between(_number(value[0]), _number(value[1])), "exists": lambda: actual.isNotNull() & (text != ""),
    }
    if op == "missing":
        return actual.isNull() | (text == "")
    return F.coalesce(tests[op](), F.lit(False))


def _condition(field: str, op: str, value) -> Column:
    v = lambda f: F.transform("variants", f)
    price = lambda x: effective_price(x["price"], x["sale_price"])
    sums = {
        "variantCount": lambda: F.size("variants"), "minPrice": lambda: F.array_min(v(price)), "maxPrice": lambda: F.array_max(v(price)),
        "inStock": lambda: F.exists("variants", lambda x: x["inventory"] > 0), "totalInventory": lambda: F.aggregate("variants", F.lit(0).cast("long"), lambda s, x: s + x["inventory"]),
        "onSale": lambda: F.exists("variants", lambda x: (x["sale_price"] > 0) & (x["sale_price"] < x["price"])),
    }
    if field.startswith("variant."):
        name = field.removeprefix("variant.")
        of = price if name == "effectivePrice" else (lambda x: x[name.removeprefix("attrs.")])
        return F.exists("variants", lambda x: compare(of(x), op, value))
    if field in sums:
        return compare(sums[field](), op, value)
    if field in ARRAYS:
        return F.exists(field, lambda x: compare(x, op, value)) if op != "missing" else F.coalesce(F.size(field) == 0, F.lit(True))
    return compare(F.col(field), op, value)


def compile_selector(tree: dict) -> Column:
    """A Column over products. An empty tree selects nothing; array and variant fields match if any element does."""
    validate(tree)

    def build(node: dict) -> Column:
        parts = []
        if "all" in node:
            parts.append(reduce(lambda a, b: a & b, map(build, node["all"])))
        if "any" in node:
            parts.append(reduce(lambda a, b: a | b, map(build, node["any"])))
        if "none" in node:
            parts.append(~reduce(lambda a, b: a | b, map(build, node["none"])))
        return reduce(lambda a, b: a & b, parts) if parts else _condition(node["field"], node["op"], node.get("value"))

    return build(tree) if tree else F.lit(False)


def is_live(as_of: Column, end_excluded: bool = True) -> Column:
    """Enabled, begun and not over. Collections and badges are over at their end, query rules after it (end_excluded=False)."""
    over = F.col("ends_at") <= as_of if end_excluded else F.col("ends_at") < as_of
    return F.col("enabled") & F.coalesce(F.col("starts_at") <= as_of, F.lit(True)) & ~F.coalesce(over, F.lit(False))


def browsable_collections(collections: DataFrame, as_of: Column) -> DataFrame:
    return collections.where((F.col("kind") == "marketing") & is_live(as_of))


def apply_labels(catalogue: DataFrame, rules: list[dict]) -> DataFrame:
    """(site_id, sku, parent_id, label) of products and rules (I10, A22). A rule has a label, a selector, and include and exclude lists of parents.

    Excluded parents get no label; included ones get it on all variants. A selector that looks at
    variants labels those that satisfy it alone, or all where none does. The rules are few and become one
    expression; the catalogue is read once.
    """

    def looks_at_variants(node: dict) -> bool:
        children = [c for k in ("all", "any", "none") for c in node.get(k, [])]
        return any(map(looks_at_variants, children)) or str(node.get("field", "")).startswith("variant.") or node.get("field") in ("minPrice", "maxPrice", "inStock", "totalInventory", "onSale")

    found = [compile_selector(r.get("selector") or {}) for r in rules]
    whole = catalogue.withColumn("hit", F.array(*found))
    single = whole.select("*", F.posexplode("variants").alias("i", "one")).withColumn("all_variants", F.col("variants")).withColumn("variants", F.array("one"))
    alone = F.array(*[compile_selector(r.get("selector") or {}) if looks_at_variants(r.get("selector") or {}) else F.lit(True) for r in rules])
    single = single.withColumn("alone", alone)
    some = single.groupBy("site_id", "parent_id").agg(*[F.max(F.get("alone", k)).alias(f"some{k}") for k in range(len(rules))])
    single = single.join(some, ["site_id", "parent_id"])
    labels = []
    for k, r in enumerate(rules):
        included, excluded = F.col("parent_id").isin(r.get("include", [])), F.col("parent_id").isin(r.get("exclude", []))
        by_selector = F.get("hit", k) & (F.get("alone", k) | ~F.col(f"some{k}"))
        labels.append(F.when(~excluded & (included | by_selector), r["label"]))
    return single.select("site_id", "parent_id", F.col("one.sku").alias("sku"), F.explode(F.array_compact(F.array(*labels))).alias("label"))


def label_plan(values: DataFrame, assignments: DataFrame) -> DataFrame:
    """(site_id, label, selector, parent_id, mode, position): every label value with its hand-made members, one row each, or one row with nulls where it has none (J16). values: (site_id, label, selector); assignments: (site_id, label, parent_id, mode include or exclude, position). Of several assignments of a product to a label an exclusion wins, then the lowest position.

    Members stay rows: a label may have very many.
    """
    once = assignments.groupBy("site_id", "label", "parent_id").agg(F.min(F.struct("mode", F.coalesce("position", F.lit(2**31 - 1)).alias("at"), "position")).alias("a"))
    return values.join(once, ["site_id", "label"], "left").select("site_id", "label", "selector", "parent_id", "a.mode", "a.position")


def curated_positions(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with `positions`, an array of (label, position) by label: the places that collections give to the product by hand; empty where there are none (W8). plan: see label_plan."""
    placed = plan.where("mode = 'include' and position is not null").groupBy("site_id", "parent_id").agg(F.array_sort(F.collect_set(F.struct("label", "position"))).alias("positions"))  # a product's collections
    none = F.array().cast("array<struct<label:string,position:int>>")
    return docs.join(placed, ["site_id", "parent_id"], "left").withColumn("positions", F.coalesce("positions", none))


def preview_selector(catalogue: DataFrame, tree: dict, sample_limit: int | None = None, most: int = 8) -> DataFrame:
    """(site_id, matched, total, sampled, exact, examples): how many products a selector would select at each site, and the first `most` of them by identifier (I11). Without sample_limit all products are looked at; with it the first so many of each site, and `matched` is scaled to all of them."""
    rows = catalogue.withColumn("hit", compile_selector(tree)).select("site_id", "parent_id", "hit")
    totals = rows.groupBy("site_id").agg(F.count("*").alias("total"))
    if sample_limit is not None:
        rows = rows.withColumn("n", F.row_number().over(W.partitionBy("site_id").orderBy("parent_id"))).where(F.col("n") <= sample_limit)
    counts = rows.groupBy("site_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("sampled"))
    first = rows.where("hit").withColumn("n", F.row_number().over(W.partitionBy("site_id").orderBy("parent_id"))).where(F.col("n") <= most)
    first = first.groupBy("site_id").agg(F.array_sort(F.collect_list("parent_id")).alias("examples"))  # `most` rows
    exact = F.col("sampled") >= F.col("total")
    matched = F.when(exact, F.col("hits")).otherwise(F.floor(F.col("hits") / F.col("sampled") * F.col("total") + 0.5))
    out = totals.join(counts, "site_id").join(first, "site_id", "left")
    return out.select("site_id", matched.cast("long").alias("matched"), "total", "sampled", exact.alias("exact"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
