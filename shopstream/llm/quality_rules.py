"""Operator 7, quality rules with robust multivariate outliers (native: DataFrame functions only).

Statistics of each text are array expressions on its row. Transformed, they form a vector; for each
language and source the location and covariance of the bulk of its vectors are estimated by minimum
covariance determinant. There are three starts: medians with median absolute deviations, mean with
covariance, and the covariance of the directions from the median. Concentration steps keep the share of
rows with the smallest Mahalanobis distance and take their mean and covariance; after two of them each
group goes on with the start of the smallest determinant, until no group's determinant falls any more.
The estimate of a group is shrunk towards that of its language, which is shrunk towards that of the corpus,
the more the fewer rows it has, so each row is judged. Rows are rejected if their distance is over a
quantile of the chi-square distribution. All group results are partial aggregates; a language and source
with a third of all rows costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

#: White space of words, as a Java character class and as a string.
SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
VECTOR = ["v0", "v1", "v2", "v3"]
#: Key of the group of all rows; those of groups start with a brace, those of languages with "language".
ALL = "all"
#: Least standard deviation of each component: differences below it are never odd (fixed values, in units of the log scales).
FLOOR = [0.35, 0.08, 0.6, 0.6]
#: Share of rows in the concentrated part, most concentration steps, fall of the log determinant below which a group has converged, rows that the estimate of the level above counts as.
SHARE, STEPS, CONVERGED, PRIOR_ROWS = 0.75, 20, 1e-3, 20
#: Quantiles of the chi-square distribution with four degrees of freedom: 0.999999, over which a squared distance is rejected, and the median, to make distances comparable.
CUTOFF, CHI2_MEDIAN = 33.3768, 3.3567


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(windows: Column) -> Column:
    """Words inside windows of WINDOW words whose hash occurs twice or more; windows is the array of hashes by first word."""

    def count(ordered: Column) -> Column:
        same = lambda x, i, k: (i + k >= 0) & (i + k < F.size(ordered)) & (F.get(ordered, i + k)["h"] == x["h"])
        places = F.array_sort(F.transform(F.filter(ordered, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")))["n"]

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, count))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the struct `stats`: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Null and empty texts have zeros everywhere.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("__w", F.filter(F.split(text, f"{SPACE}+"), lambda x: x != ""))
    n = F.size("__w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("__h", windows).withColumn("__l", lines)
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__h")).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("stats", stats).drop("__w", "__h", "__l")


def vector_of(stats: str = "stats") -> list[Column]:
    """The transformed statistics: length, mean word length, symbols for each word, repeated lines for each line, on log scales."""
    s = F.col(stats)
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return [
        F.log1p(s["n_words"].cast("double")).alias("v0"),
        F.log1p(s["word_chars"] / words).alias("v1"),
        F.log1p(100.0 * s["n_symbols"] / words).alias("v2"),
        F.log1p(100.0 * s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1))).alias("v3"),
    ]


def squared_distance(prefix: str = "") -> Column:
    """Mahalanobis distance of a row's vector from the estimate joined to it: forward substitution with the Cholesky factor."""
    z: list[Column] = []
    for i, v in enumerate(VECTOR):
        rest = F.col(v) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


ENTRIES = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]
MEANS, FACTOR = [f"m{i}" for i in range(len(VECTOR))], [f"l{i}{j}" for i, j in ENTRIES]


def with_factor(groups: DataFrame, keep: tuple[str, ...] = ("g", "n")) -> DataFrame:
    """`keep`, means, the Cholesky factor l<i><j> of the covariance c<i><j>, whose diagonal is at least the squared floor, and log_det."""
    for i, j in ENTRIES:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        entry = F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}")
        groups = groups.withColumn(f"l{i}{j}", entry)
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(VECTOR))), 2 * F.log("l00"))
    return groups.select(*keep, *MEANS, *FACTOR, log_det.alias("log_det"))


def floored(c: Column, i: int, j: int) -> Column:
    return F.greatest(c, F.lit(FLOOR[i] ** 2)) if i == j else c


def starts(rows: DataFrame) -> DataFrame:
    """(g, s, n, means, factor, log_det): the three starts s of each group."""
    medians = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(v, 0.5, 100_000).alias(f"o{i}") for i, v in enumerate(VECTOR)])
    spread = salted_join(rows, medians, "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(v) - F.col(f"o{i}")), 0.5, 100_000).alias(f"d{i}") for i, v in enumerate(VECTOR)])
    centre = medians.join(spread, "g").select("g", "n", *[f"o{i}" for i in range(4)], *[F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOOR[i])).alias(f"d{i}") for i in range(4)])
    centre = stored(centre, "mcd")
    x = [F.col(v) - F.col(f"o{i}") for i, v in enumerate(VECTOR)]
    length = F.greatest(sum((F.pow(x[i] / F.col(f"d{i}"), 2) for i in range(1, 4)), F.pow(x[0] / F.col("d0"), 2)), F.lit(1e-6))
    sums = salted_join(rows, centre, "g").groupBy("g").agg(*[F.avg(x[i]).alias(f"a{i}") for i in range(4)], *[F.avg(x[i] * x[j]).alias(f"p{i}{j}") for i, j in ENTRIES], *[F.avg(4 * x[i] * x[j] / length).alias(f"q{i}{j}") for i, j in ENTRIES])
    both = centre.join(sums, "g")
    medians_only = both.select("g", F.lit(0).alias("s"), "n", *[F.col(f"o{i}").alias(f"m{i}") for i in range(4)], *[(F.pow(f"d{i}", 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in ENTRIES])
    classical = both.select("g", F.lit(1), "n", *[F.col(f"o{i}") + F.col(f"a{i}") for i in range(4)], *[floored(F.col(f"p{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}"), i, j) for i, j in ENTRIES])
    directions = both.select("g", F.lit(2), "n", *[f"o{i}" for i in range(4)], *[floored(F.col(f"q{i}{j}"), i, j) for i, j in ENTRIES])
    return stored(with_factor(stored(medians_only.union(classical).union(directions), "mcd"), ("g", "s", "n")), "mcd")


def concentrated(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """One concentration step for each group and start of `now`."""
    limit = salted_join(rows, now, "g").groupBy("g", "s").agg(F.percentile_approx(squared_distance(), share, 100_000).alias("limit"))
    inner = salted_join(rows, now.join(limit, ["g", "s"]), "g").where(squared_distance() <= F.col("limit"))
    x = [F.col(v) - F.col(f"m{i}") for i, v in enumerate(VECTOR)]  # around the estimate before: no loss of digits
    sums = inner.groupBy("g", "s").agg(F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"o{i}") for i in range(4)], *[F.avg(x[i]).alias(f"a{i}") for i in range(4)], *[F.avg(x[i] * x[j]).alias(f"p{i}{j}") for i, j in ENTRIES])
    found = sums.select("g", "s", "n", *[(F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(4)], *[floored(F.col(f"p{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}"), i, j).alias(f"c{i}{j}") for i, j in ENTRIES])
    return stored(with_factor(stored(found, "mcd"), ("g", "s", "n")), "mcd")


def estimates(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """(g, n, m<i>, l<i><j>): for each group of rows (g, v0..v3), location and Cholesky factor of its minimum covariance determinant estimate, scaled so that the median squared distance is at least that of a normal distribution."""
    now = starts(rows)
    for _ in range(2):
        now = concentrated(rows, now, share)
    best = now.groupBy("g").agg(F.min(F.struct("log_det", "s")).alias("best")).select("g", F.col("best.s").alias("s"))
    now = stored(now.join(best, ["g", "s"]), "mcd")
    for _ in range(steps - 2):
        before, now = now, concentrated(rows, now, share)
        fall = before.select("g", F.col("log_det").alias("before")).join(now, "g").agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        if fall is None or fall < CONVERGED:
            break
    scale = salted_join(rows, now, "g").groupBy("g").agg(F.sqrt(F.greatest(F.percentile_approx(squared_distance(), 0.5, 100_000) / CHI2_MEDIAN, F.lit(1.0))).alias("scale"))
    return now.join(scale, "g").select("g", "n", *MEANS, *[(F.col(c) * F.col("scale")).alias(c) for c in FACTOR])


def shrunk(groups: DataFrame, above: DataFrame, on: str | None) -> DataFrame:
    """Estimates of groups (with the column `on`), each mixed with the one of `above` whose g is `on` (of the only one there, without `on`), which counts as PRIOR_ROWS rows."""
    above = above.select(F.col("g").alias("__up"), *[F.col(c).alias(f"a_{c}") for c in [*MEANS, *FACTOR]])
    both = groups.crossJoin(above) if on is None else groups.join(above, F.col(on) == F.col("__up"))
    own = F.col("n") / (F.col("n") + PRIOR_ROWS)
    mixed = lambda x, y: own * x + (1 - own) * y
    covariance = lambda a, i, j: sum((F.col(f"{a}l{i}{k}") * F.col(f"{a}l{j}{k}") for k in range(1, j + 1)), F.col(f"{a}l{i}0") * F.col(f"{a}l{j}0"))
    both = both.select("g", "n", *[mixed(F.col(f"m{i}"), F.col(f"a_m{i}")).alias(f"m{i}") for i in range(len(VECTOR))], *[mixed(covariance("", i, j), covariance("a_", i, j)).alias(f"c{i}{j}") for i, j in ENTRIES])
    return stored(with_factor(stored(both, "mcd")), "mcd")


def shrunk_estimates(rows: DataFrame) -> DataFrame:
    """(g, m<i>, l<i><j>): for each group of rows (g, lang, v0..v3; lang is the key of the group's language), its estimate shrunk towards that of its language and of all rows."""
    levels = F.explode(F.array("g", "lang", F.lit(ALL)))
    found = stored(estimates(rows.select(levels.alias("g"), *VECTOR)), "mcd")
    of_lang = shrunk(found.join(rows.select(F.col("lang").alias("g")).distinct(), "g"), found.where(F.col("g") == ALL), None)
    return shrunk(found.join(rows.select("g", "lang").distinct(), "g"), of_lang, "lang").drop("n", "log_det")


def quality_rules(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """For each row of docs: struct `row` of `keep`, struct `stats` (see text_statistics), base_failed, distance (squared, null only where no row of the group passes the base rules) and kept.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows. Other rows are
    kept unless their squared distance is over the cutoff (a row right on it is kept). The estimates are learned from rows that pass
    the base rules, for each language and source (null is a value like others); those of small groups are
    mostly the ones of their language and of the corpus. Equal rows count each.
    """
    # a group is a key that no value can be mistaken for, null included
    lang = F.col(lang_col).cast("string").alias("l")
    group = F.to_json(F.struct(lang, F.col(source_col).cast("string").alias("s")))
    rows = text_statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), group.alias("g"), F.concat(F.lit("language "), F.to_json(F.struct(lang))).alias("lang"), F.col(text_col).alias("text")))
    failed = (F.col("stats.n_words") < 20) | (100 * F.col("stats.n_repeat_words") > 30 * F.col("stats.n_words"))
    rows = stored(rows.select("row", "g", "lang", "stats", failed.alias("base_failed"), *vector_of()), "statistics")
    estimate = shrunk_estimates(rows.where("not base_failed").select("g", "lang", *VECTOR))
    found = salted_join(rows, estimate, "g", "left").withColumn("distance", squared_distance())
    return found.select("row", "stats", "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"))
