"""A corpus from raw documents to token ids in five stages, each a Parquet table that the next one reads.

Defined results: a null or empty text has no words and goes with the quality rules; rows without doc_id stay in the line
dedup's order (they rank last), are not linked by the near dedup, and are drawn and encoded like others; repeated rows
of one doc_id and text count as one document where lines are compared and as rows of their own in the mix; texts of
any length are taken whole; extra columns are passed through up to the encoding; an empty table gives an empty table.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm import bpe, linedup, minhash, mix, quality
from rowtide.llm.queries import tokenizer_path
from rowtide.settings import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or are more likely bad than good by the rules' votes, go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line are taken out of their texts."""
    return linedup.keep_lines(docs, linedup.BY_LENGTH)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, 80 % alike or more, stays."""
    return minhash.keep_one(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shard by shard."""
    return mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix."""
    encoded = bpe.encode(docs, tokenizer_path(), keep=("doc_id", "source"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL has no counterpart of the fitted model, of minhashing's candidates within a budget, and of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
