"""From raw documents to token ids: the stages, in order, each over all rows that its predecessor kept.

Learned language profiles and merges of a vocabulary are beyond SQL, so there is no
``ORACLE_SQL``; the tests hold the rows against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseries.llm import byte_bpe, decontaminate, language, line_dedup, near_dedup
from fieldseries.operators.materialize import materialize

ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (``und``: no text or no letter); fill null labels with the prediction."""
    profiles = language.fit_profiles(docs)
    known = language.predict(docs, profiles).where(F.col("lang_pred") != language.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that many documents share out of all but one of them; ``n_chars`` follows the text."""
    return line_dedup.drop_common_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id."""
    others = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the bytes decoded from them."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.tokens(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_leaks),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
