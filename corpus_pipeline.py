"""Cleaning a corpus for training: stages over the documents table, each on all the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm import byte_bpe, decontaminate, pii, simhash, toxicity
from phenogrid.session import materialise


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic (0.5 or more) go; the model learns from the labels of all documents it gets."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, into="_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="_hits")
    return found.where(F.col("_hits.n_hit") == 0).drop("_hits")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of personal data are replaced by their kind, and n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its token ids, their number and the text decoded from them."""
    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, into="_bpe")
    return coded.select(
        *docs.columns, F.col("_bpe.token_ids").alias("token_ids"), F.size("_bpe.token_ids").cast("long").alias("n_tokens"),
        F.decode("_bpe.decoded", "UTF-8").alias("decoded_text")).drop("_bpe")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("personal_data", personal_data), ("tokens", tokens)]
#: Fingerprints, the fitted model and the merges can't be written in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is stored and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
