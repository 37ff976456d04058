"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstream.llm.common import stored
from shopstream.llm.decontaminate import decontaminated
from shopstream.llm.language_id import with_language
from shopstream.llm.ngram_join import without_near_copies
from shopstream.llm.packing import packed
from shopstream.llm.pii import sanitised
from shopstream.llm.queries import word_tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    return with_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by shingles of five words at a similarity of 0.8 or more."""
    return without_near_copies(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with entities generalised to their kind and disclosing terms removed; n_chars follows the text."""
    clean = sanitised(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 tokens, with their ids."""
    return packed(docs, word_tokenizer())


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None  # the first stage is a trained classifier


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
