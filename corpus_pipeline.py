"""A corpus pipeline of five stages: what each keeps is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm.linededup import line_dedup
from concord.llm.minhash import near_duplicates
from concord.llm.mixing import label_domains, mix_documents
from concord.llm.quality import quality_rules
from concord.llm.scratch import Scratch, columns_of
from concord.llm.sentencepiece import Model, encode_column
from concord.llm.text import BLANKS

#: Ids that may be broadcast, in bytes; beyond it they are shuffled.
BROADCAST_BYTES = 8 << 20
#: The pieces of the last stage.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule accepts."""
    return quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document that had words and has none left goes with them."""
    had = docs.withColumn("_had", F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(BLANKS))) > 0)
    out = line_dedup(had)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    left = F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(BLANKS))) > 0
    return out.where(left | ~F.col("_had")).select(*columns_of(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that share an id are documents of their own if their texts differ, and one document if they are equal. One of
    the texts goes by the id, the others come after all ids. Rows without an id stay.
    """
    work = Scratch(spark, "near")
    twice = work.cut(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    text = F.xxhash64("text", F.lit(7), "text")
    if twice.limit(1).count():
        twice = work.cut(docs.join(_small(twice), "doc_id").groupBy("doc_id").agg(F.min(text).alias("_near_first")))
    else:
        twice = twice.withColumn("_near_first", F.lit(0).cast("long"))
    other = F.xxhash64("doc_id", text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    named = docs.join(_small(twice), "doc_id", "left").withColumn("_near_node", F.when(text != F.col("_near_first"), other).otherwise(F.col("doc_id")))
    lost = work.cut(near_duplicates(named, doc_id="_near_node").where(~F.col("kept")).select(F.col("doc_id").alias("_near_node")).distinct())
    kept = named.join(_small(lost), "_near_node", "left_anti")
    again = kept.where("_near_first is not null").dropDuplicates(["_near_node"])
    return kept.where("_near_first is null").unionByName(again).select(*columns_of(docs))


def _small(ids: DataFrame) -> DataFrame:
    """Ids to broadcast where they are few: a bound of 8 MB."""
    return F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    return mix_documents(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of every document."""
    out = encode_column(docs.select("doc_id", "source", "text"), Model.load(PIECES))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_dedup", near), ("mixing", mixing), ("sentencepiece", pieces)]

#: The last stages are no SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.cut(docs)
    return docs
