"""A corpus pipeline: quality, exact copies, near copies, mixing, encoding.

Each stage gets what the one before it kept, as a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm import golomb_dedup, piece_match, simhash_wide, source_mix, subword_quality
from loomtrace.llm.common import documents, written
from loomtrace.llm.queries import PIECE_MODEL, vocabulary

#: No SQL states the learned score, the fingerprints or the encoder.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return subword_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each distinct text."""
    return golomb_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash_wide.drop_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return source_mix.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether these decode to the text."""
    return piece_match.encode(docs, vocabulary(PIECE_MODEL), check="round_trip")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mixed), ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
