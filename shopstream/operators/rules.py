"""Query rules over a whole log: redirects (J6), rules (J7), synonyms (J8), pins (R10), badges (R11), personalisation (R12, R13), pins that were not found."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normalise, singularise

#: Characters by which a pattern that may stand anywhere in a query meets it, and those of a beginning.
GRAM, PREFIX = 4, 16
#: Bytes of regex rules that are sent to every executor at a time.
BLOCK_BYTES = 4 << 20


def substrings(text: Column, shortest: int, longest: int) -> Column:
    """The different substrings of `shortest` to `longest` characters."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(0)) + 1), lambda i: text.substr(i, F.lit(k)))
    return F.array_distinct(F.flatten(F.array(*[F.filter(of(k), lambda g: F.length(g) == k) for k in range(shortest, longest + 1)])))


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def by_rarest(rules: DataFrame, parts: Column, held: DataFrame, by: list[str]) -> DataFrame:
    """rules with `key`, the one of their `parts` that the fewest queries hold; a rule with a part that none holds can't match and goes. held: (by, key) of the queries' parts."""
    own = rules.select(*by, "rule_id", F.explode(parts).alias("key"))
    n = held.join(own.select(*by, "key").distinct(), [*by, "key"], "left_semi").groupBy(*by, "key").agg(F.count("*").alias("n"))
    least = own.join(n, [*by, "key"], "left").groupBy(*by, "rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("least"))
    return rules.join(least.where("least.n > 0").select(*by, "rule_id", "least.key"), [*by, "rule_id"])


def fired(queries: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """(by, query, rule_id, way, p, priority): each query with the rules that hold for it. queries: (by, query, q); rules: (by, rule_id, way, p, priority).

    Queries and rules meet on equal keys, so no query is compared with each rule: a pattern that must be
    all of the query on the whole, one that must begin it on a prefix, a phrase on the word and one that
    may stand anywhere on the gram of GRAM characters which the fewest queries hold. Only patterns of
    the way `regex` have no key; these alone are broadcast, in blocks of BLOCK_BYTES.
    """
    q, p = F.col("q"), F.col("p")
    parts = lambda keys: queries.select(*by, "query", "q", F.explode(keys).alias("key"))
    of = lambda way: rules.where(F.col("way") == way)
    words, grams = parts(F.array_distinct(F.split(q, " "))), parts(substrings(q, 1, GRAM))
    anywhere = F.when(F.length(p) < GRAM, F.array(p)).otherwise(substrings(p, GRAM, GRAM))
    tries = [
        (parts(F.array(q)), of("exact").withColumn("key", p), F.lit(True)),
        (parts(F.transform(F.sequence(F.lit(1), F.least(F.length(q), F.lit(PREFIX))), lambda n: q.substr(F.lit(1), n))), of("starts_with").withColumn("key", F.substring(p, 1, PREFIX)), q.startswith(p)),
        (words, by_rarest(of("phrase"), F.array_distinct(F.split(p, " ")), words, by), padded(q).contains(padded(p))),
        (grams, by_rarest(of("contains"), anywhere, grams, by), q.contains(p)),
    ]
    columns = [*by, "query", "rule_id", "way", "p", "priority"]
    out = None
    for rows, keyed, holds in tries:
        found = rows.join(keyed, [*by, "key"]).where(holds).select(columns)
        out = found if out is None else out.union(found)
    regex = of("regex")
    blocks = 1 + int(regex.agg(F.coalesce(F.sum(F.octet_length("p") + 100), F.lit(0))).first()[0]) // BLOCK_BYTES
    for k in range(blocks):
        block = F.broadcast(regex.where(F.pmod(F.xxhash64("rule_id"), F.lit(blocks)) == k).withColumnsRenamed({c: f"rule_{c}" for c in by}))
        alike = [F.col(c) == F.col(f"rule_{c}") for c in by]
        out = out.union(queries.join(block, [*alike, F.expr("q rlike concat('(?i)', p)")]).select(columns))
    return out


def with_sound_patterns(rules: DataFrame) -> DataFrame:
    """rules without the regex ones whose pattern does not compile: they match nothing, and would fail the job."""
    compiler = rules.sparkSession._jvm.java.util.regex.Pattern
    broken = []
    for row in rules.where("kind = 'regex'").select("pattern").distinct().toLocalIterator():
        try:
            compiler.compile(row.pattern or "")
        except IllegalArgumentException:
            broken.append((row.pattern,))
    if not broken:
        return rules
    gone = rules.sparkSession.createDataFrame(broken, "pattern string").withColumn("kind", F.lit("regex"))
    return rules.join(gone, ["kind", "pattern"], "left_anti")


def match_redirects(queries: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, query, rule_id, target): the first enabled rule of each query by priority (descending), then id. rules: (rule_id, kind, pattern, target, priority, enabled); kinds exact, starts_with, contains and regex. Columns `by`, such as site_id, must be equal in query and rule; a rule_id is unique within them.

    An empty query matches nothing, and neither do a null pattern or one that does not compile. An empty
    pattern begins every query, and every query contains it: of such rules only the first of a site can count.
    """
    by = by or []
    q = queries.select(*by, "query", normalise(F.col("query")).alias("q")).distinct().where("q <> ''")
    sound = with_sound_patterns(rules.where("enabled and pattern is not null"))
    r = sound.select(*by, "rule_id", F.col("kind").alias("way"), F.when(F.col("kind") == "regex", F.col("pattern")).otherwise(normalise(F.col("pattern"))).alias("p"), "priority")
    always = r.where("p = '' and way in ('starts_with', 'contains', 'regex')").groupBy(*by).agg(F.min_by(F.struct("rule_id", "way", "p", "priority"), F.struct(-F.col("priority"), "rule_id")).alias("a"))
    always = always.where("a is not null").select(*by, "a.*")
    every = q.withColumn("any", F.lit(1)).join(always.withColumn("any", F.lit(1)), [*by, "any"]).select(*by, "query", "rule_id", "way", "p", "priority")  # a row for each site
    found = fired(q, r.where("p <> ''"), by).union(every)
    first = found.groupBy(*by, "query").agg(F.min_by("rule_id", F.struct(-F.col("priority"), "rule_id")).alias("rule_id"))
    return first.join(rules.select(*by, "rule_id", "target"), [*by, "rule_id"]).select(*by, "query", "rule_id", "target")


def match_query_rules(queries: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, query, rule_id): the rule of each query by priority, then exact before phrase before contains, then the longer trigger, then id. rules: (rule_id, match, trigger, priority); only live rules are to be given. Columns `by` as in match_redirects. An empty query or trigger matches nothing."""
    by = by or []
    q = queries.select(*by, "query", normalise(F.col("query")).alias("q")).distinct().where("q <> ''")
    r = rules.select(*by, "rule_id", F.col("match").alias("way"), normalise(F.col("trigger")).alias("p"), "priority").where("p <> '' and way in ('exact', 'phrase', 'contains')")
    place = F.when(F.col("way") == "exact", 0).when(F.col("way") == "phrase", 1).otherwise(2)
    order = F.struct(-F.col("priority"), place, -F.length("p"), "rule_id")
    return fired(q, r, by).groupBy(*by, "query").agg(F.min_by("rule_id", order).alias("rule_id"))


def rule_of_request(requests: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(request_id, rule_id, from_category): the rule of each request (request_id, by, query, category_id): that of its words, else the first rule by priority, then id, of exactly its category. rules: as in match_query_rules, with category_id. Requests without a rule are left out."""
    by = by or []
    words = match_query_rules(requests, rules.where("trigger is not null"), by)
    first = rules.where("category_id <> ''").groupBy(*by, "category_id").agg(F.min_by("rule_id", F.struct(-F.col("priority"), "rule_id")).alias("of_category"))
    rows = requests.join(words, [*by, "query"], "left").join(first, [*by, "category_id"], "left")
    return rows.select("request_id", F.coalesce("rule_id", "of_category").alias("rule_id"), F.col("rule_id").isNull().alias("from_category")).where("rule_id is not null")


def expand_synonyms(queries: DataFrame, rules: DataFrame, longest: int = 3, by: list[str] | None = None) -> DataFrame:
    """(query_id, terms, rule_ids): terms with those of the alternatives appended where they are new. queries: (query_id, terms); rules: (rule_id, trigger, alternatives: array<string>), a row for each trigger. Columns `by`, such as site_id, must be equal in query and rule.

    Phrases of up to `longest` terms are looked up in the singular; from left to right the longest at each
    place is taken and its terms are used up.
    """
    folded = F.transform("terms", singularise)
    n = F.size("terms")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct(i.alias("at"), k.alias("k"), F.array_join(F.slice(folded, i, k), " ").alias("phrase")))))
    by = by or []
    spans = queries.where(n > 0).select("query_id", *by, F.explode(F.filter(grams, lambda g: g["at"] + g["k"] - 1 <= n)).alias("g")).select("query_id", *by, "g.at", "g.k", "g.phrase")
    keyed = rules.select(*by, "rule_id", F.array_join(F.transform(F.split(normalise(F.col("trigger")), " "), singularise), " ").alias("phrase"), "alternatives")
    found = spans.join(keyed, [*by, "phrase"]).groupBy("query_id", "at").agg(F.max_by(F.struct("k", "rule_id", "alternatives"), F.struct("k", -F.col("rule_id"))).alias("best"))
    found = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "best"))).alias("hits"))  # a query's places
    none = F.array().cast("array<struct<rule_id:int,alternatives:array<string>>>")
    start = F.struct(F.lit(1).alias("next"), none.alias("taken"))
    take = lambda s, h: F.when(h["at"] >= s["next"], F.struct((h["at"] + h["best"]["k"]).alias("next"), F.concat(s["taken"], F.array(F.struct(h["best"]["rule_id"].cast("int").alias("rule_id"), h["best"]["alternatives"].alias("alternatives")))).alias("taken"))).otherwise(s)
    found = found.withColumn("taken", F.aggregate("hits", start, take)["taken"])
    words = F.flatten(F.transform(F.flatten(F.col("taken.alternatives")), lambda a: F.split(normalise(a), " ")))
    rows = queries.join(found, "query_id", "left")
    return rows.select("query_id", F.when(F.col("taken").isNotNull(), F.concat("terms", F.array_except(F.array_distinct(words), F.col("terms")))).otherwise(F.col("terms")).alias("terms"), F.coalesce(F.col("taken.rule_id"), F.array().cast("array<int>")).alias("rule_ids"))


def apply_query_rule(cards: DataFrame, actions: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, parent_id, card, pinned): cards after the actions of each query's rule. cards: (query_id, parent_id, card); actions: (query_id, parent_id, action, slot), action hide, pin (to a place from 1) or bury; products: (parent_id) of the catalogue.

    Hidden products go, pinned ones take their places (also if they were not found, but only if they are
    in the catalogue; a place beyond the end is the end), buried ones follow the rest. Of two pins for a
    place the later one, by the column `ordinal` of actions or else by parent_id, stands before the other.
    """
    order = F.col("ordinal") if "ordinal" in actions.columns else F.col("parent_id")
    known = actions.where("action = 'pin'").join(products.select("parent_id").distinct(), "parent_id", "left_semi")
    actions = actions.where("action <> 'pin'").unionByName(known.select(actions.columns))
    rows = cards.join(actions, ["query_id", "parent_id"], "full_outer").where("not (action <=> 'hide') and not (card is null and action <> 'pin')")
    w = W.partitionBy("query_id")
    pins = rows.where("action = 'pin'").withColumn("k", F.row_number().over(w.orderBy("slot", F.desc(order))))
    # a place taken by an earlier pin moves on: place = k + the largest of (slot - k) so far
    pins = pins.withColumn("place", F.col("k") + F.max(F.col("slot") - F.col("k")).over(w.orderBy("k").rowsBetween(W.unboundedPreceding, 0)))
    rest = rows.where("not (action <=> 'pin')").withColumn("k", F.row_number().over(w.orderBy(F.when(F.col("action") == "bury", 1).otherwise(0), "card")))
    # the k-th of the rest stands behind the pins whose place leaves fewer than k free ones before it
    shift = pins.groupBy("query_id").agg(F.array_sort(F.collect_list("place")).alias("taken"))  # a rule's pins: few
    rest = rest.join(shift, "query_id", "left")
    place = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("k"), lambda at, p: F.when(p <= at, at + 1).otherwise(at))
    both = rest.select("query_id", "parent_id", place.alias("place"), F.lit(False).alias("pinned")).unionByName(pins.select("query_id", "parent_id", F.col("place"), F.lit(True).alias("pinned")))
    return both.withColumn("card", F.row_number().over(w.orderBy("place", "parent_id"))).drop("place")


def add_badges(labels: DataFrame, badges: DataFrame, most: int = 2) -> DataFrame:
    """(sku, badge, place): the enabled badges of each SKU's labels badge:<slug>, by priority. badges: (slug, priority, enabled)."""
    rows = labels.where(F.col("label").startswith("badge:")).select("sku", F.substring("label", 7, 200).alias("slug")).join(badges.where("enabled"), "slug")
    place = F.row_number().over(W.partitionBy("sku").orderBy("priority", "slug"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("sku", F.col("slug").alias("badge"), "place")


def label_parts(title: Column) -> Column:
    """The trimmed parts between the slashes of a variant's title."""
    return F.transform(F.split(F.coalesce(title, F.lit("")), "/"), lambda x: F.trim(x))


def session_affinity(events: DataFrame, docs: DataFrame, most: int = 8, longest: int = 40, by: list[str] | None = None) -> DataFrame:
    """(by, session_id, word, place): the last `most` different words clicked in each session, newest first: parts of the variant's title (of 2 to `longest` characters) in their order, then its brand. docs: (by, sku, variant_title, brand). Of clicks at the same time the one with the larger SKU is the later."""
    by = by or []
    parts = F.filter(label_parts(F.col("variant_title")), lambda x: F.length(x).between(2, longest))
    words = F.concat(parts, F.when(F.coalesce(F.length("brand"), F.lit(0)) > 0, F.array("brand")).otherwise(F.array().cast("array<string>")))
    rows = events.where("type = 'click'").select(*by, "session_id", "sku", "occurred_at").join(docs.select(*by, "sku", words.alias("words")), [*by, "sku"])
    rows = rows.select(*by, "session_id", "occurred_at", "sku", F.posexplode("words").alias("i", "word"))
    rows = rows.groupBy(*by, "session_id", "word").agg(F.max(F.struct("occurred_at", "sku", -F.col("i"))).alias("last"))
    place = F.row_number().over(W.partitionBy(*by, "session_id").orderBy(F.desc("last"), "word"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(*by, "session_id", "word", "place")


def personalise(hits: DataFrame, words: Column, ruled: Column | None = None) -> DataFrame:
    """hits (query_id, card, variant_title, brand and the session's affinity `words`) with `score` and `place`: more parts of the title and brand among the words first, whatever their case, else as before. Pages to which a rule was applied (`ruled`) and pages of one card stay as they are, with score 0."""
    wanted = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.lower(F.trim(w)))
    among = lambda x: F.coalesce(F.array_contains(wanted, F.lower(x)), F.lit(False)) & (x != "")
    score = F.size(F.filter(label_parts(F.col("variant_title")), among)) + F.when(among(F.col("brand")), 1).otherwise(0)
    page = W.partitionBy("query_id")
    kept = F.count("*").over(page) < 2
    kept = kept if ruled is None else kept | F.coalesce(ruled, F.lit(False))
    return hits.withColumn("score", F.when(kept, 0).otherwise(score)).withColumn("place", F.row_number().over(page.orderBy(F.desc("score"), "card")))


def absent_pins(pins: DataFrame, hits: DataFrame, docs: DataFrame, ordinal: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """(query_id, parent_id, sku): pinned products that a query did not find, each by its first document (J15). pins and hits: (query_id, parent_id); docs: (parent_id, sku and the ordinal). Pins of products without documents are left out. Columns `by`, such as site_id, must be equal in pin and document."""
    by = by or []
    absent = pins.select("query_id", *by, "parent_id").distinct().join(hits.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti")
    first = docs.join(absent.select(*by, "parent_id"), [*by, "parent_id"], "left_semi").groupBy(*by, "parent_id").agg(F.min_by("sku", ordinal).alias("sku"))
    return absent.join(first.hint("merge"), [*by, "parent_id"]).select("query_id", "parent_id", "sku")
