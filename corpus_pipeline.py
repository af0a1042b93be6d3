"""Stages that turn raw documents into tokens of clean, distinct text.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns the columns of documents; the last returns token counts and
digests. Every stage's result is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe_stream, decontaminate, minhash, suffix_dedup, toxicity
from rasterloom.llm.common import NO_ID, checkpoint, shared_folder

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate group."""
    found = minhash.near_duplicates(docs)
    gone = checkpoint(found.where("NOT kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_gone")).distinct())
    return docs.join(gone, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == gone["_gone"], "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that a document with a smaller id has too. Parts
    of characters that a cut leaves are dropped; a text that is all repeats
    stays as an empty one."""
    return suffix_dedup.cut_texts(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    encoded = bpe_stream.encode_documents(docs, public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("decontaminate", drop_leaks), ("encode", encode)]

#: No SQL can state the trained model, the latent search or the encoding; the
#: tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
