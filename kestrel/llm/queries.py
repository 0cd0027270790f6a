"""The registered query of every operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, langid, mixing, order, pieces, quality, simhash, template, toxicity, urls
from .oracles import RULES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = quality.quality(table(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return t.select("doc_id", *quality.COUNTS[:3], "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def vocabulary_path(spark: SparkSession, name: str) -> str:
    """Folder of the public tokenizers: spark.kestrel.tokenizers, by default /opt/tokenizers.  Read on the driver only."""
    return f"{spark.conf.get('spark.kestrel.tokenizers', '/opt/tokenizers')}/{name}"


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = order.BytePairs.from_path(vocabulary_path(spark, "byte_bpe_50k.tiktoken"))
    shards = order.shards(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    t = order.records(shards)
    layout = order.Layout()
    at = F.col("slot") % layout.records * layout.stride
    return t.select("doc_id", "seq", "slot", F.floor(F.col("slot") / layout.records).alias("shard"), at.alias("byte_offset"), "n_tokens", F.md5("ids").alias("ids_md5"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return template.read_digests(template.format_conversations(rows))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=4, radius=4)


def subword_digests(docs: DataFrame) -> DataFrame:
    model = pieces.PieceModel.from_path(vocabulary_path(docs.sparkSession, "piece_bpe_32k.model"))
    return pieces.digests(docs, model, k=2)


def op5_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_digests(table(spark, sf_dir, "documents"))


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bm25.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0, k=10)
    return t.withColumn("score", F.round("score", 6))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    t = urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), [urls.Rule(*r) for r in RULES], labels)
    return t.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.fold(3) != 1)
    t = langid.identify(docs.select("doc_id", "text"), model)
    return t.select("doc_id", F.coalesce(langid.fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), langid.fold(5) != 0)
    t = toxicity.score(docs, model)
    return t.select("doc_id", F.coalesce(langid.fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_quality, op2_training_order, op3_chat, op4_simhash, op5_subwords, op6_search, op7_mixing, op8_urls, op9_language, op10_toxicity)}
