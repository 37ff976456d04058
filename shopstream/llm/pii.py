"""Operator 5, personal data with information-theoretic sanitisation (native: DataFrame functions only).

Entities that have a form (email, ip, card, phone) are found by patterns. A text's protected entities
make the words near them risky: a term that occurs near an entity and hardly elsewhere in the corpus
reveals it. All probabilities are shares of the different texts of the corpus: p(c) of those with entity c,
p(t) of those with term t, p(c,t) of those with t near c. Term t discloses c if their pointwise mutual
information makes up at least `disclosure` of the information content of c:
log p(c,t) / (p(c) p(t))  >=  disclosure * -log p(c).  c is both the entity's value and its kind: a value
in few texts is judged mostly by its kind. Wherever such a term stands in a text with the entity, near it
or not, it is a span of its own; sanitising generalises entities to their kind and removes disclosing terms.

Patterns have no repeated groups: separators inside a run are first turned into single marker characters
(one for one, so places stay), which keeps matching linear and the stack flat on very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

KINDS = ["email", "ip", "card", "phone", "term"]
#: Private-use characters: a separator within a card number, a dot within a domain, and what such characters in a text are taken as.
JOIN, DOT, OTHER = "\ue000", "\ue001", "\ue002"
LOCAL, LABEL = rf"A-Za-z0-9._%+{DOT}-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++{DOT}[{LABEL}{DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{JOIN}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Characters on each side of an entity whose words are its context.
REACH = 60
WORD = r"(?<=[^\p{L}])\p{L}{3,40}(?!\p{L})"
#: Texts that smooth an estimate, texts of a value from which it has half the weight; least share of the information content.
SUPPORT, DISCLOSURE = 3, 0.6
#: Most words of 64 cells in a map that is broadcast.
MAP_WORDS = 1 << 18


FOUND = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in characters from 0.

    What stands between the matches gives their places: a match ends after the lengths of all before it.
    These are summed in blocks of about as many matches as there are blocks, which keeps the work and the
    memory far below the square of the number of matches.
    """

    def walk(pair: Column) -> Column:
        lengths = F.transform(pair["found"], lambda v, i: F.length(F.get(pair["between"], i)) + F.length(v))
        size = F.ceil(F.sqrt(F.size(pair["found"]))).cast("int")
        return let(F.struct(lengths.alias("lengths"), size.alias("size")), lambda work: blocks(pair["found"], work["lengths"], work["size"]))

    def blocks(found: Column, lengths: Column, size: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(found) - 1, size)
        sums = F.transform(starts, lambda at: total(F.slice(lengths, at + 1, size)))
        return let(sums, lambda of: let(F.transform(of, lambda _, k: total(F.slice(of, F.lit(1), k))), lambda before: F.transform(found, lambda v, i: place(v, i, lengths, size, before))))

    def place(value: Column, i: Column, lengths: Column, size: Column, before: Column) -> Column:
        block = F.floor(i / size).cast("int")
        end = F.get(before, block) + total(F.slice(lengths, block * size + 1, i - block * size + 1))
        return let(end, lambda e: F.struct((e - F.length(value)).alias("start"), e.alias("end"), value.alias("value")))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(pair, lambda p: F.when(F.size(p["found"]) == 0, F.array().cast(FOUND)).otherwise(walk(p)))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (place in KINDS), end, value>> of the patterned kinds in a text that is not null, by start, then kind."""
    empty = F.array().cast(FOUND)
    plain = F.translate(text, JOIN + DOT, OTHER + OTHER)
    email = F.when(F.instr(text, "@") > 0, places(F.regexp_replace(plain, rf"(?<=[{LABEL}])\.(?=[{LABEL}])", DOT), EMAIL)).otherwise(empty)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(places(text, IP), lambda m: m["value"].rlike(OCTETS))).otherwise(empty)

    def is_card(m: Column) -> Column:
        digits = digits_of(m["value"])
        return F.length(digits).between(12, 19) & luhn(digits)

    card = F.when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), F.filter(places(F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", JOIN), CARD), is_card)).otherwise(empty)
    phone = F.when(F.instr(text, "+") > 0, F.filter(places(text, PHONE), lambda m: F.length(digits_of(m["value"])).between(9, 15))).otherwise(empty)

    def of_kind(k: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), F.lower(m["value"]).alias("value")))

    return F.array_sort(F.concat(*[of_kind(k, found) for k, found in enumerate((email, ip, card, phone))]))


def context_words(text: Column, span: Column) -> Column:
    """array<struct<start, end, value>> of the whole words within REACH characters of a span, places in the text."""
    begin = F.greatest(span["start"] - REACH, F.lit(0))
    shifted = lambda words, by: F.transform(words, lambda w: F.struct((w["start"] + by).alias("start"), (w["end"] + by).alias("end"), F.lower(w["value"]).alias("value")))
    left = F.concat(F.when(begin == 0, " ").otherwise(""), F.substring(text, begin + 1, span["start"] - begin))
    right = F.substring(text, span["end"] + 1, F.lit(REACH))
    whole = F.filter(places(right, WORD), lambda w: w["end"] < REACH)
    return F.concat(shifted(places(left, WORD), begin - F.when(begin == 0, 1).otherwise(0)), shifted(whole, span["end"]))


def find_entities(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row, uid, same, base, near, words): base spans of each row of docs, for each of them its entity and context words, and all words of texts with a base span; `same` is equal for equal texts. Stored, so that uid stays."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    near = F.transform("base", lambda s: F.struct(F.xxhash64(s["kind"], s["value"]).alias("entity"), context_words(F.col("text"), s).alias("words")))
    words = F.transform(places(F.concat(F.lit(" "), "text"), WORD), lambda w: F.struct((w["start"] - 1).alias("start"), (w["end"] - 1).alias("end"), F.lower(w["value"]).alias("value")))
    some = F.size("base") > 0
    rows = rows.withColumn("near", F.when(some, near)).withColumn("words", F.when(some, words))
    return stored(rows.select("row", F.monotonically_increasing_id().alias("uid"), F.xxhash64("text").alias("same"), "base", "near", "words"), "entities")


def cell_map(rows: DataFrame, column: str) -> DataFrame:
    """(word, bits): a map of MAP_WORDS * 64 cells at most, whatever the number of rows, marking hashes of a column."""
    cell = F.pmod(F.xxhash64(column), F.lit(MAP_WORDS * 64))
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    return rows.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def marked(rows: DataFrame, column: str, cells: DataFrame, wanted: bool = True) -> DataFrame:
    """Rows whose column is marked in a map (with others that share a cell), or those whose column surely is not."""
    cell = F.pmod(F.xxhash64(column), F.lit(MAP_WORDS * 64))
    held = rows.withColumn("cell", cell).withColumn("word", F.shiftright("cell", 6)).join(F.broadcast(cells), "word", "left")
    hit = F.coalesce(F.expr("shiftright(bits, cast(cell & 63 as int)) & 1") == 1, F.lit(False))
    return held.where(hit if wanted else ~hit).drop("word", "cell", "bits")


def term_counts(found: DataFrame, docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(term, n_term): the number of different texts with each term, for the terms of `wanted` (and some that share their cells).

    A text that no other row repeats is counted where it is read, so only sums for each term are moved. Texts
    of which there may be more rows are first reduced to one each, within the tasks and then by their hash.
    """
    several = stored(found.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"), "several")
    cells, repeated = stored(cell_map(wanted, "term"), "cells"), stored(cell_map(several, "same"), "repeated")
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("same", F.xxhash64("text"))
    once = marked(texts, "same", repeated, wanted=False).select("text")
    again = marked(texts, "same", repeated).dropDuplicates(["same"]).select("text")

    def terms(rows: DataFrame) -> DataFrame:
        words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
        return marked(rows.select(F.explode(words).alias("term")).where(F.length("term").between(3, 40)), "term", cells)

    return terms(once).union(terms(again)).groupBy("term").agg(F.count("*").alias("n_term"))


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term): terms that reveal an entity, with p(c|t) smoothed by `support` texts at the rate p(c).

    A term's share of the information content is estimated for the entity's value and for its kind, and
    the two are mixed: the value has n / (n + support) of the weight if n texts have it. Everything counts
    different texts, so that a copied text is no evidence of its own.
    """
    judged = F.transform("near", lambda x, i: F.struct(F.get("base", i)["kind"].alias("kind"), x["entity"].alias("entity"), F.array_distinct(x["words"]["value"]).alias("terms")))
    near = found.where(F.size("near") > 0).select("same", F.explode(judged).alias("n")).select("same", "n.*")
    pairs = near.select("same", "kind", "entity", F.explode("terms").alias("term"))
    texts = lambda name: F.count_distinct("same").alias(name)
    n = F.lit(float(max(found.agg(F.count_distinct("same")).first()[0], 2)))
    terms = term_counts(found, docs, text_col, pairs)

    def share(whole: Column, both: str) -> Column:
        """Mutual information as a share of the information content of what `whole` texts have."""
        p = whole / n
        given = (F.col(both) + support * p) / (F.greatest("n_term", both) + support)
        return F.when(p < 1, F.log(given / p) / -F.log(p)).otherwise(0.0)

    kinds = stored(near.groupBy("kind").agg(texts("n_kind")), "kinds")  # four rows
    of_kind = pairs.groupBy("kind", "term").agg(texts("n_kind_term")).join(terms, "term", "left").withColumn("n_term", F.coalesce("n_term", "n_kind_term")).join(kinds, "kind")
    of_kind = of_kind.select(F.struct("kind", "term").alias("pair"), "n_term", share(F.col("n_kind"), "n_kind_term").alias("kind_share"))
    values = near.groupBy("entity").agg(texts("n_entity"))
    of_value = pairs.groupBy("entity", F.struct("kind", "term").alias("pair")).agg(texts("n_both"))
    rows = salted_join(salted_join(of_value, of_kind, "pair", by="entity"), values, "entity", by="pair")
    weight = F.col("n_entity") / (F.col("n_entity") + support)
    return rows.where(weight * share(F.col("n_entity"), "n_both") + (1 - weight) * F.col("kind_share") >= disclosure).select("entity", "pair.term")


def personal_data(docs: DataFrame, keep: list[str], text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """For each row of docs: struct `row` of `keep`, base and spans, both array<struct<start, kind, end>> by start, then kind (a place in KINDS). spans: the base ones and all places of the terms that disclose an entity of the text.

    Null texts are taken as empty and have no spans. Rows are told apart by a stored number, so repeated
    rows or null identifiers get their own spans. An empty table gives no rows. A share right on
    `disclosure` discloses.
    """
    found = find_entities(docs, keep, text_col)
    terms = stored(disclosing_terms(found, docs, text_col, support, disclosure), "terms")
    some = found.where(F.size("base") > 0)
    words = some.select("uid", F.explode("words").alias("w")).select("uid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.value").alias("term"))
    entities = some.select("uid", F.explode(F.array_distinct("near.entity")).alias("entity"))
    # by term first: a term discloses few entities, while a text may have many of both
    held = salted_join(words.select("uid", "term").distinct(), terms, "term", by="uid").join(entities, ["uid", "entity"], "left_semi").select("uid", "term").distinct()
    more = words.join(held, ["uid", "term"]).groupBy("uid").agg(F.collect_set(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")).alias("terms"))  # words of one row
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = lambda rows, terms: rows.select("row", base.alias("base"), F.array_sort(F.concat(base, terms)).alias("spans"))
    # a text without an entity has no term: it needs no join, so its row is not shuffled
    return spans(found.where(F.size("base") == 0), empty).union(spans(some.join(more, "uid", "left"), F.coalesce("terms", empty)))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised_text(text: Column, spans: Column) -> Column:
    """The text with every entity generalised to <kind> and every disclosing term removed. Spans that overlap are replaced together, by the name of the one that starts first."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS[:-1]], F.lit(""))

    def walk(ends: Column, size: Column) -> Column:
        """The text piece by piece: before each span what lies behind all spans before it. The farthest of their ends is looked up in blocks."""
        highest = F.transform(F.sequence(F.lit(0), F.size(ends) - 1, size), lambda at: F.array_max(F.slice(ends, at + 1, size)))
        return let(highest, lambda of: let(F.transform(of, lambda _, k: F.array_max(F.slice(of, F.lit(1), k))), lambda before: F.concat(F.array_join(F.transform(spans, lambda m, i: piece(m, i, ends, size, before)), ""), tail(F.array_max(ends)))))

    def piece(m: Column, i: Column, ends: Column, size: Column, before: Column) -> Column:
        block = F.floor(i / size).cast("int")
        behind = F.greatest(F.get(before, block), F.array_max(F.slice(ends, block * size + 1, i - block * size)), F.lit(0))
        return let(behind, lambda b: F.when(m["start"] < b, F.lit("")).otherwise(F.concat(F.substring(text, b + 1, m["start"] - b), F.get(names, m["kind"]))))

    tail = lambda at: F.substring(text, at + 1, F.greatest(F.length(text) - at, F.lit(0)))
    done = let(F.struct(F.transform(spans, lambda m: m["end"]).alias("ends"), F.ceil(F.sqrt(F.size(spans))).cast("int").alias("size")), lambda w: walk(w["ends"], w["size"]))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with sanitised texts; all other columns, and null texts, as they were."""
    found = personal_data(docs, docs.columns, text_col)
    fixed = F.when(F.col(f"row.`{text_col}`").isNotNull(), sanitised_text(F.col(f"row.`{text_col}`"), F.col("spans")))
    return found.select([fixed.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
