"""Five stages from raw documents to token ids, each an operator of wickerwork.llm applied to all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerwork.llm.bpe import bpe_encode
from wickerwork.llm.line_dedup import dedup_lines
from wickerwork.llm.mixing import in_mixed_order
from wickerwork.llm.near_dedup import drop_near_duplicates
from wickerwork.llm.queries import vocabulary
from wickerwork.llm.shared import durable
from wickerwork.llm.toxicity import fit_toxicity

# No stage but mixing can be written in SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labelled ones outside the held-out fold, scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit_toxicity(docs, labels).keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages of 50 words and more are cut out; documents of which nothing is left go; n_chars follows."""
    cut = dedup_lines(docs, min_words=50, drop_empty=True)
    return cut.withColumn("n_chars", F.when(F.col("words_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those linked by a similarity of 0.8 and more on five-word shingles: that with the smallest id."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, range-partitioned and sorted so that the files read in order are the mixture: by shares of a period of 400 slots, or
    of four slots a source where that is more, in SQL functions only."""
    sources = docs.select(F.coalesce(F.col("source").cast("string"), F.lit(""))).distinct().count()
    return in_mixed_order(docs, period=max(400, 4 * sources))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number and digest, and the digest of their decoding."""
    return bpe_encode(docs, vocabulary(), digests=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; every stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
