"""Query analysis (Q1, Q2, F5, Q7, Q8): measurements are lifted out of the text, compounds split, terms folded, spelling corrected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.measure import UNITS
from ..functions.text import edit_distance, looks_like_sku, normalise, singularise, tokenise, typo_budget, without_stopwords

# The axis that a letter or a word names; None: the words go, but name no axis.
AXIS_LETTERS = {"w": "width_in", "h": "height_in", "d": "height_in", "l": "length_in"}
AXIS_WORDS = {
    "long": "length_in", "length": "length_in", "lengths": "length_in", "wide": "width_in", "width": "width_in", "tall": "height_in", "high": "height_in", "height": "height_in",
    "deep": "height_in", "depth": "height_in", "thick": None, "thickness": None, "across": None, "diameter": None,
}
POSITIONS = ["width_in", "height_in", "length_in"]
CROSSES = ("x", "×")
#: Units in which a bare measurement is a length.
LONG_UNITS = ("ft", "foot", "feet", "'", "m")
# Words of questions and relations.
MARKERS = ["what", "which", "how", "where", "that", "for", "cover", "between", "need", "looking", "something", "instead", "go", "goes", "fit", "hide", "seam"]
LIFTED = "struct<rest:string,dimensions:array<struct<field:string,inches:double>>>"


@dataclass
class Token:
    text: str
    start: int
    end: int

    @property
    def number(self) -> bool:
        return self.text[0].isdigit()


def scan(text: str) -> list[Token]:
    """Numbers, runs of letters, and single marks. A cross that is written on to a unit or an axis letter ("4ftx6ft") is a token of its own."""
    out: list[Token] = []
    for m in re.finditer(r"\d+(?:\.\d+)?|[^\W\d_]+|\S", text):
        token = Token(m[0].lower(), *m.span())
        head = token.text[:-1]
        if len(token.text) > 1 and token.text[-1] in CROSSES and (head in UNITS or head in AXIS_LETTERS) and text[token.end : token.end + 1].isdigit():
            out += [Token(head, token.start, token.end - 1), Token(token.text[-1], token.end - 1, token.end)]
        else:
            out.append(token)
    return out


class Reader:
    """Reads measurements from the tokens of a query."""

    def __init__(self, text: str):
        self.text, self.tokens = text, scan(text)

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.tokens) and self.tokens[i].text in texts

    def whole(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i].text.isdigit()

    def fraction(self, i: int) -> bool:
        return self.whole(i) and self.is_(i + 1, "/") and self.whole(i + 2)

    def quantity(self, i: int) -> tuple[float | None, int] | None:
        """Value (None: a part of nothing) of the number that begins at token i, and the token after it."""
        if i >= len(self.tokens) or not self.tokens[i].number:
            return None
        added, at = 0.0, i
        if self.whole(i) and not self.fraction(i):
            after = i + 2 if self.is_(i + 1, "-") else i + 1
            if self.fraction(after):
                added, at = float(self.tokens[i].text), after
        if self.fraction(at):
            top, bottom = float(self.tokens[at].text), float(self.tokens[at + 2].text)
            return (added + top / bottom if bottom else None), at + 3
        return float(self.tokens[at].text), at + 1

    def begins_word(self, i: int) -> bool:
        return self.tokens[i].start == 0 or not self.text[self.tokens[i].start - 1].isalnum()

    def side(self, i: int) -> tuple[float | None, str | None, int] | None:
        """One side of a size: inches, axis letter, next token."""
        read = self.quantity(i)
        if read is None:
            return None
        value, i = read
        unit = self.tokens[i].text if self.is_(i, *UNITS) else "in"
        i += self.is_(i, *UNITS)
        letter = self.tokens[i].text if self.is_(i, *AXIS_LETTERS) else None
        return inches(value, unit), letter, i + (letter is not None)

    def size(self, i: int) -> tuple[list[tuple[str, float]], int] | None:
        """Two or three sides with crosses between them; sides without a letter are width, height and length in turn."""
        found: list[tuple[str, float]] = []
        read, sides = (self.side(i) if self.begins_word(i) else None), 0
        while read:
            value, letter, i = read
            sides += 1
            if value is not None:
                found.append((AXIS_LETTERS[letter] if letter else POSITIONS[len(found)], value))
            read = self.side(i + 1) if sides < len(POSITIONS) and self.is_(i, *CROSSES) else None
        return (found, i) if len(found) > 1 else None

    def single(self, i: int) -> tuple[str, float, int] | None:
        """A number with a unit, with the word for its axis before it or behind it."""
        named = None
        if self.is_(i, *AXIS_WORDS):
            named = self.tokens[i].text
            i += 1 + self.is_(i + 1, ":")
        read = self.quantity(i) if i < len(self.tokens) and self.begins_word(i) else None
        if read is None or read[0] is None or not self.is_(read[1], *UNITS):
            return None
        value, i = read
        unit = self.tokens[i].text
        behind = i + 2 if self.is_(i + 1, "in") and self.is_(i + 2, *AXIS_WORDS) else i + 1
        if self.is_(behind, *AXIS_WORDS):
            named, i = self.tokens[behind].text, behind
        axis = AXIS_WORDS.get(named) if named else None
        return axis or ("length_in" if unit in LONG_UNITS else "any_dimension_in"), inches(value, unit), i + 1


def inches(value: float | None, unit: str) -> float | None:
    """In sixteenths of an inch, halves upwards."""
    return None if value is None else int(value * UNITS[unit] * 16 + 0.5) / 16


def lift(query: str) -> tuple[str, list[tuple[str, float]]]:
    """What is left of a query, and its measurements as (axis, inches): sizes such as 4x6 first, then single ones with a unit."""
    reader = Reader(query)
    sizes: list[tuple[str, float]] = []
    singles: list[tuple[str, float]] = []
    left, at, i = [], 0, 0
    while i < len(reader.tokens):
        begin = reader.tokens[i].start
        if size := reader.size(i):
            sizes += size[0]
            i = size[1]
        elif single := reader.single(i):
            singles.append(single[:2])
            i = single[2]
        else:  # a fraction of nothing is passed over whole
            read = reader.quantity(i)
            i = read[1] if read and read[0] is None else i + 1
            continue
        left.append(query[at:begin])
        at = reader.tokens[i - 1].end
    return " ".join(" ".join([*left, query[at:]]).split()), sizes + singles


def lift_batches(queries: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in queries:
        rows = [lift(q) for q in batch.fillna("")]
        yield pd.DataFrame({"rest": [r for r, _ in rows], "dimensions": [[{"field": a, "inches": v} for a, v in d] for _, d in rows]})


def lift_dimensions(query: Column) -> Column:
    """Measurements use up their text in order, which built-in functions can't say: an Arrow UDF, meant for distinct queries."""
    return F.pandas_udf(lift_batches, returnType=LIFTED)(query)


def analyse_queries(log: DataFrame, column: str = "query") -> DataFrame:
    """(query, type, terms, dimensions, sku) of the different queries of a log.

    A single token that looks like a part number is `sku`; nothing is `empty`; long queries, or such with
    relation words, that name no measurement are natural_language; with measurements dimensional; else
    keyword. Null is like empty.
    """
    q = log.select(F.col(column).alias("query")).distinct().withColumn("text", normalise(F.coalesce("query", F.lit(""))))
    tokens = tokenise(F.col("text"))
    q = q.withColumn("tokens", tokens).withColumn("is_sku", (F.size("tokens") == 1) & F.coalesce(looks_like_sku(F.get("tokens", 0)), F.lit(False)))
    q = q.withColumn("lifted", lift_dimensions(F.when(F.col("is_sku"), F.lit("")).otherwise(F.col("text"))))
    terms = F.when(F.col("is_sku"), F.col("tokens")).otherwise(F.transform(without_stopwords(tokenise(F.col("lifted.rest"))), singularise))
    n = F.size("tokens")
    kind = (
        F.when(F.col("text") == "", "empty").when(F.col("is_sku"), "sku").when(F.size("lifted.dimensions") > 0, "dimensional")
        .when((n >= 6) | ((n >= 4) & F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in MARKERS]))), "natural_language").otherwise("keyword")
    )
    return q.select("query", kind.alias("type"), terms.alias("terms"), F.col("lifted.dimensions").alias("dimensions"), F.when(F.col("is_sku"), F.upper(F.get("tokens", 0))).alias("sku"))


def split_compounds(words: DataFrame, vocabulary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(word, left, right and the columns `by`): words of eight letters or more that are not known but are two known words of three or more; the first such cut. Columns `by`, such as site_id, must be equal in word and vocabulary."""
    by = by or []
    unknown = words.distinct().where(F.length("word") >= 8).join(vocabulary.select(*by, F.col("token").alias("word")), [*by, "word"], "left_anti")
    cuts = unknown.select(*by, "word", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("i"))
    cuts = cuts.select(*by, "word", "i", F.expr("substring(word, 1, i)").alias("left"), F.expr("substring(word, i + 1)").alias("right"))
    known = lambda side: vocabulary.select(*by, F.col("token").alias(side)).distinct()
    found = cuts.join(known("left"), [*by, "left"]).join(known("right"), [*by, "right"]).groupBy(*by, "word").agg(F.min(F.struct("i", "left", "right")).alias("b"))
    return found.select(*by, "word", "b.left", "b.right")


def suggest_corrections(terms: DataFrame, vocabulary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(term, correction, distance and the columns `by`): for terms that are not known the nearest known word with their first letter, within the typo budget; then the shortest, then by name.

    Words meet on shared bigrams of their first letter's neighbourhood and beyond, as for fuzzy terms: a
    word within the budget shares at least max(1, bigrams - 2 * budget) of them.
    """
    by = by or []
    unknown = terms.select(*by, "term").distinct().join(vocabulary.select(*by, F.col("token").alias("term")), [*by, "term"], "left_anti").withColumn("budget", typo_budget(F.col("term"))).where("budget > 0")
    wanted = unknown.select(*by, "term", "budget", F.explode(grams(F.col("term"))).alias("gram"))
    known = vocabulary.select(*by, "token").distinct().select(*by, "token", F.explode(grams(F.col("token"))).alias("gram"))
    near = wanted.join(known.hint("merge"), [*by, "gram"]).where(F.abs(F.length("term") - F.length("token")) <= F.col("budget")).select(*by, "term", "budget", "token").distinct()
    near = near.withColumn("distance", edit_distance(F.col("term"), F.col("token"), 2)).where("distance <= budget")
    rank = F.row_number().over(W.partitionBy(*by, "term").orderBy("distance", F.length("token"), "token"))
    return near.withColumn("n", rank).where("n = 1").select(*by, "term", F.col("token").alias("correction"), "distance")


def grams(word: Column) -> Column:
    """The first letter joined with each bigram. Words of the same first letter and four letters or more within one edit, or eight within two, share one: an edit spoils two bigrams, and there are three, or seven."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.concat(F.substring(word, 1, 1), F.substring(word, i, F.lit(2)))))


def relax_terms(terms: Column) -> Column:
    """Terms without the first of the shortest; null if there are fewer than two."""
    keyed = F.transform(terms, lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i")))
    drop = F.array_min(keyed)["i"]
    return F.when(F.size(terms) >= 2, F.filter(terms, lambda t, i: i != drop))
