"""From documents to packed sequences: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of their input; columns beyond those of
documents are kept too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.llm import blocks, jaccard, kneser, langid, packing
from turnmill.llm.queries import word_bpe


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out; texts without a letter or in no learned language go."""
    filters = langid.fit(docs.filter(~langid.held_out()))
    return langid.accepted(docs, filters)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's threshold go."""
    return kneser.accepted(docs, kneser.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the first by id."""
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens, with the ids of each piece."""
    return packing.pack(docs, word_bpe())


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("pack", pack)]

#: Language filters, perplexities and retrieval packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = blocks.stored(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
