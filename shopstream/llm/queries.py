"""One query for each numbered operator, over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from .decontaminate import benchmark_matches
from .hard_negatives import hard_negatives
from .hilbert_shards import cut_runs, hilbert_places
from .language_id import fit_language_model, identify
from .license_scan import scan_licenses
from .ngram_join import ngram_components
from .packing import packed
from .pii import KINDS, count_of, listed, personal_data
from .quality_classifier import fit_subword_model, quality_scores
from .warc import read_archives, write_archives
from .quality_rules import quality_rules
from .toxicity import fit_toxicity_model, toxicity_scores
from .whitening import whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "detections.label")).alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(F.size("base") > 0, 0.4).otherwise(0.0)).alias("score"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity_model(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity_scores(docs, model, ["doc_id"]).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_language_model(docs), ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [count_of("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("row.doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words", "base_failed", "kept", "distance")


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return packing_digest(packed(table(spark, sf_dir, "documents"), tokenizer_path or word_tokenizer()))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return read.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_subword_model(docs, table(spark, sf_dir, "labels"), "quality")
    return quality_scores(docs, model, ["doc_id"]).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0)


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    keep = {"doc_id": F.col("doc_id"), "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "text_crc32": F.coalesce(F.crc32(text), F.lit(0).cast("long"))}
    placed = cut_runs(hilbert_places(table(spark, sf_dir, "documents"), SHARD_DIMENSIONS, "doc_id", keep), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


#: Metadata columns that readers of documents filter by.
SHARD_DIMENSIONS = ["lang", "source", "n_chars", "doc_id"]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("row_id", "vec_id")


QUERIES = {
    "op5_pii": op5_pii,
    "op7_quality_rules": op7_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op9_warc": op9_warc,
    "op8_packing": op8_packing,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op6_decontaminate": op6_decontaminate,
    "op1_ngram_join": op1_ngram_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_hilbert_shards": op12_hilbert_shards,
    "op13_whitening": op13_whitening,
}

OP1_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM docs),
toks AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM toks x JOIN toks y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON p.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

ALNUM_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM k),
ks AS (SELECT DISTINCT k FROM k),
pos AS (SELECT doc_id, ks.k, w, unnest(range(1, len(w) - ks.k + 2)) AS i FROM d, ks WHERE len(w) >= ks.k),
hit AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM pos) p JOIN win ON win.k = p.k AND win.g = p.g),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n),
v AS (SELECT p.*, f.first, list_transform(range(0, 8), lambda g: CAST(concat('0x', substr(p.h, CAST(g * 5 + 1 AS BIGINT), 5)) AS BIGINT)) AS g FROM p JOIN f USING (h, n)),
d AS (SELECT *, array_to_string(list_transform(g, lambda x: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1))), '') AS digest FROM v)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}),
e AS (SELECT vec_id, label, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM v),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.k = b.k AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score QUALIFY rank <= 10
"""

ORACLE_SQL = {
    "op11_hard_negatives": OP11_SQL,
    "op9_warc": OP9_SQL,
    "op6_decontaminate": OP6_SQL,
    "op1_ngram_join": OP1_SQL,
}
