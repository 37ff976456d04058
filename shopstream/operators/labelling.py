"""Labels from a table of rules (I10 over J16): any number of selectors over a whole catalogue.

A selector's JSON becomes rows of conditions and a postfix program of its groups. Conditions are tested on
the different values of a field, not on products: equality by an equi-join on field and value, the rest
within the field. Products meet the conditions that hold for their values by an equi-join, and each rule's
program runs over the conditions that a product fulfils. So no expression grows with the rules, and the
work with the products that some condition holds for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import effective_price
from ..functions.store import stored
from .selectors import ARRAYS, _number, validate

SUMS = ["minPrice", "maxPrice", "inStock", "totalInventory", "onSale"]
STEP = "array<struct<op:string,n:int>>"
CONDITION = "array<struct<id:int,field:string,op:string,texts:array<string>,low:double,high:double>>"
RULES = f"site_id string, label string, program {STEP}, conditions {CONDITION}, by_variant boolean, vacuous boolean"
#: Stands for a null where values are joined.
NULL = "\u0000"


def program_of(tree: dict) -> tuple[list[dict], list[dict]]:
    """The steps of a selector in postfix order (cond: the n-th condition; all, any, none: over the last n results) and its conditions."""
    steps: list[dict] = []
    conditions: list[dict] = []

    def visit(node: dict) -> None:
        groups = [k for k in ("all", "any", "none") if k in node]
        for k in groups:
            for child in node[k]:
                visit(child)
            steps.append({"op": k, "n": len(node[k])})
        if len(groups) > 1:
            steps.append({"op": "all", "n": len(groups)})
        if not groups:
            value = node.get("value")
            values = value if isinstance(value, list) else [value]
            between = node["op"] == "between"
            texts = [] if value is None else [str(v).strip().lower() for v in values]
            low, high = (_number(values[0]), _number(values[-1])) if texts else (None, None)
            steps.append({"op": "cond", "n": len(conditions)})
            conditions.append({"id": len(conditions), "field": node["field"].replace("variant.attrs.", "variant."), "op": node["op"], "texts": texts, "low": low, "high": high if between else low})

    visit(tree)
    return steps, conditions


def runs(steps: list[dict], true: set[int]) -> bool:
    stack: list[bool] = []
    for s in steps:
        if s["op"] == "cond":
            stack.append(s["n"] in true)
        else:
            last = stack[-s["n"] :]
            stack[-s["n"] :] = [all(last) if s["op"] == "all" else any(last) if s["op"] == "any" else not any(last)]
    return stack[0] if stack else False


def read_selectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for site, label, text in batch.itertuples(index=False):
            try:
                tree = json.loads(text or "{}")
                validate(tree)
                steps, conditions = program_of(tree) if tree else ([], [])
            except (ValueError, TypeError, AttributeError, KeyError):  # not a selector
                steps, conditions = [], []
            by_variant = any(c["field"].startswith("variant.") or c["field"] in SUMS for c in conditions)
            rows.append((site, label, steps, conditions, by_variant, runs(steps, set())))
        yield pd.DataFrame(rows, columns=["site_id", "label", "program", "conditions", "by_variant", "vacuous"])


def compiled_rules(rules: DataFrame) -> DataFrame:
    """(site_id, label, program, conditions, by_variant, vacuous) of rules (site_id, label, selector as JSON). A selector that is empty, null or not valid selects nothing. by_variant: it looks at variants or at sums over them; vacuous: it holds where no condition does."""
    return rules.select("site_id", "label", "selector").distinct().mapInPandas(read_selectors, RULES)


def unit_values(products: DataFrame) -> DataFrame:
    """(site_id, parent_id, sku, field, text): the values of each product (sku null) and of each of its variants taken alone. Empty arrays and nulls have a row with a null text."""
    whole = products.withColumn("sku", F.lit(None).cast("string"))
    alone = products.select("*", F.explode("variants").alias("one")).withColumns({"variants": F.array("one"), "sku": F.col("one.sku")}).drop("one")
    rows = whole.unionByName(alone)
    price = F.transform("variants", lambda v: effective_price(v["price"], v["sale_price"]))
    sums = {
        "variantCount": F.size("variants"), "minPrice": F.array_min(price), "maxPrice": F.array_max(price), "inStock": F.exists("variants", lambda v: v["inventory"] > 0), "totalInventory": F.aggregate("variants", F.lit(0).cast("long"), lambda s, v: s + v["inventory"]),
        "onSale": F.exists("variants", lambda v: (v["sale_price"] > 0) & (v["sale_price"] < v["price"])),
    }
    own = [c for c in products.columns if c not in ("site_id", "parent_id", "variants") and not products.schema[c].dataType.typeName().startswith("array")]
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), value.cast("string").alias("text"))
    single = F.array(*[pair(c, F.col(c)) for c in own], *[pair(name, c) for name, c in sums.items()])
    some = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))
    lists = [F.transform(some(c), partial(pair, c)) for c in products.columns if c in ARRAYS]
    inner = products.schema["variants"].dataType.elementType.fieldNames()
    of_variants = F.flatten(F.transform("variants", lambda v: F.array(*[pair(f"variant.{name}", v[name]) for name in inner], pair("variant.effectivePrice", effective_price(v["price"], v["sale_price"])))))
    # Made distinct by a shuffle: array_distinct compares each pair of a product's values, and products have thousands of variants.
    rows = rows.select("site_id", "parent_id", "sku", F.explode(F.concat(single, *lists, of_variants)).alias("v"))
    return rows.select("site_id", "parent_id", "sku", "v.field", F.lower(F.trim("v.text")).alias("text")).distinct()


def holds(c: str = "c") -> Column:
    """Whether a condition holds for a value `text`."""
    op, first, text = F.col(f"{c}.op"), F.get(F.col(f"{c}.texts"), 0), F.col("text")
    number = F.regexp_replace(text, r"[$,%\s]", "").try_cast("double")
    low, high = F.col(f"{c}.low"), F.col(f"{c}.high")
    missing = text.isNull() | ((text == "") & ~F.col("field").isin(sorted(ARRAYS)))
    tests = {
        "not_equals": text != first, "contains": text.contains(first), "not_contains": ~text.contains(first), "starts_with": text.startswith(first), "not_in": ~F.array_contains(F.col(f"{c}.texts"), text),
        "gt": number > low, "gte": number >= low, "lt": number < low, "lte": number <= low, "between": number.between(low, high), "exists": text.isNotNull() & (text != ""), "missing": missing,
    }
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(op == name, test).otherwise(out)
    return F.coalesce(out, F.lit(False))


def program_result(program: Column, true: Column) -> Column:
    """What a program says where the conditions in `true` hold."""
    last = lambda stack, n: F.slice(stack, F.size(stack) - n + 1, n)

    def step(stack: Column, s: Column) -> Column:
        group = last(stack, s["n"])
        result = F.when(s["op"] == "all", F.forall(group, lambda x: x)).when(s["op"] == "any", F.exists(group, lambda x: x)).otherwise(~F.exists(group, lambda x: x))
        return F.when(s["op"] == "cond", F.concat(stack, F.array(F.array_contains(true, s["n"])))).otherwise(F.concat(F.slice(stack, F.lit(1), F.size(stack) - F.when(s["op"] == "cond", 0).otherwise(s["n"])), F.array(result)))

    # A condition's n is no count: the branches for groups must not see it as one.
    safe = F.transform(program, lambda s: F.struct(s["op"].alias("op"), s["n"].alias("n")))
    return F.coalesce(F.get(F.aggregate(safe, F.array().cast("array<boolean>"), step), 0), F.lit(False))


def apply_label_rules(products: DataFrame, rules: DataFrame, plan: DataFrame) -> DataFrame:
    """(site_id, sku, parent_id, label) for all rules at once.

    products: see selectors.products; rules: (site_id, label, selector as JSON); plan: (site_id, label,
    parent_id, mode include or exclude). A product that is excluded gets no label, one that is included
    gets it on all variants. A selector that looks at variants labels those that fulfil it alone, or all
    where the product does but no variant alone; other selectors label all variants. An invalid selector
    selects nothing; rules of one site do not touch another.
    """
    compiled = stored(compiled_rules(rules), "label_rules")
    conditions = compiled.select("site_id", "label", F.explode("conditions").alias("c"))
    read = unit_values(products).join(conditions.select("site_id", F.col("c.field").alias("field")).distinct(), ["site_id", "field"], "left_semi")
    units = stored(read, "unit_values").withColumn("key", F.coalesce("text", F.lit(NULL)))
    values = units.select("site_id", "field", "text", "key").distinct()
    equal = conditions.where(F.col("c.op").isin("equals", "in")).select("site_id", "label", F.col("c.id").alias("id"), F.col("c.field").alias("field"), F.explode("c.texts").alias("key")).distinct()
    other = conditions.where(~F.col("c.op").isin("equals", "in")).withColumn("field", F.col("c.field")).join(values, ["site_id", "field"]).where(holds()).select("site_id", "label", F.col("c.id").alias("id"), "field", "key")
    holding = stored(equal.unionByName(other), "holding")
    # Units with the same values that any condition holds for are alike to all rules: rules are asked once for each such kind.
    known = holding.select("site_id", "field", "key").distinct()
    values = F.sort_array(F.collect_set(F.struct("field", "key"))).alias("values")  # of a unit, what conditions hold for
    valued = units.join(known, ["site_id", "field", "key"]).groupBy("site_id", "parent_id", "sku").agg(values)
    bare = products.select("site_id", "parent_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), "variants.sku")).alias("sku"))
    valued = valued.unionByName(bare.withColumn("values", F.array().cast(valued.schema["values"].dataType))).groupBy("site_id", "parent_id", "sku").agg(F.flatten(F.collect_list("values")).alias("values"))
    valued = stored(valued.withColumn("kind", F.sha2(F.to_json("values"), 256)), "unit_kinds")
    kinds = stored(valued.groupBy("site_id", "kind").agg(F.first("values").alias("values")), "label_kinds")
    true = kinds.select("site_id", "kind", F.explode("values").alias("v")).select("site_id", "kind", "v.*").join(holding, ["site_id", "field", "key"]).groupBy("site_id", "label", "kind").agg(F.collect_set("id").alias("true"))  # a rule's conditions
    # Rules that hold where nothing is true are asked for each kind; the others only where a condition holds.
    everywhere = compiled.where("vacuous").select("site_id", "label").join(kinds.select("site_id", "kind"), "site_id")
    asked = true.unionByName(everywhere.withColumn("true", F.array().cast("array<int>"))).groupBy("site_id", "label", "kind").agg(F.flatten(F.collect_list("true")).alias("true"))
    labelled = asked.join(compiled.select("site_id", "label", "program", "by_variant"), ["site_id", "label"]).where(program_result(F.col("program"), F.col("true"))).select("site_id", "label", "kind", "by_variant")
    found = stored(valued.select("site_id", "kind", "parent_id", "sku").hint("merge").join(labelled, ["site_id", "kind"]).drop("kind"), "label_hits")
    whole = found.where("sku is null").drop("sku")
    alone = found.where("sku is not null and by_variant").select("site_id", "label", "parent_id", "sku")
    by_one = whole.where("by_variant").join(alone.hint("merge"), ["site_id", "label", "parent_id"]).select("site_id", "label", "parent_id", "sku")
    skus = products.select("site_id", "parent_id", F.explode("variants.sku").alias("sku"))
    by_all = whole.join(by_one.select("site_id", "label", "parent_id").distinct(), ["site_id", "label", "parent_id"], "left_anti").select("site_id", "label", "parent_id")
    chosen = plan.where("mode = 'include'").select("site_id", "label", "parent_id").unionByName(by_all).distinct()
    every = chosen.join(skus, ["site_id", "parent_id"]).select("site_id", "label", "parent_id", "sku").unionByName(by_one).distinct()
    out = every.join(plan.where("mode = 'exclude'").select("site_id", "label", "parent_id"), ["site_id", "label", "parent_id"], "left_anti")
    return out.select("site_id", "sku", "parent_id", "label")
