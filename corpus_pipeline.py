"""A training corpus from ``documents``: language, quality, near copies, mixture, subword samples.

Each stage is written as Parquet in the shared folder and read again by the next.  Stages decide on all rows that their
predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import langid, mixing, quality, simhash
from kestrel.llm import queries as llm_queries
from kestrel.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear.  Dictionaries are learned from a bounded sample of the labelled texts."""
    model = langid.fit(docs, langid.fold(3) != 1)
    kept = langid.identify(docs.withColumns({f"__in_{i}": F.col(c) for i, c in enumerate(docs.columns)}), model).filter(~F.col("rejected"))
    return kept.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their group's fences.  Short ones are no worse for it: they need a word, not the fifty of the base rule."""
    return quality.quality(docs, min_words=1).filter("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document may come back up to three times."""
    return mixing.repeat(docs)


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, as digests."""
    return llm_queries.subword_digests(docs)


STAGES = [("language ID", language), ("quality rules", quality_rules), ("SimHash near-dedup", near_copies), ("mixing", mixture), ("SentencePiece", subwords)]

#: zstandard, XXH64 fingerprints and the sampler have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
