"""A training-data pipeline over `documents`: filter, deduplicate, mix and tokenize.

Every stage takes (spark, docs, sf_dir) and works on all rows of `docs`, which its caller has
written as Parquet and read again. All but the last keep the columns of `docs`.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.llm import toxicity as toxic
from unitloom.llm.bpe import decode, encode, read_ranks
from unitloom.llm.linedups import drop_shared_lines
from unitloom.llm.minhash import near_duplicates
from unitloom.llm.mixing import mixed
from unitloom.llm.shared import saved, small, small_batches


# Characters of texts that a task of tokenize holds with their words; its workers run beside a heap that earlier stages have filled.
TOKEN_BLOCK_CHARS = 3_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels calls toxic go."""
    small_batches(spark)
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic.score(docs, model).filter("predicted = 0").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go; n_chars follows the text."""
    small_batches(spark)
    cut = drop_shared_lines(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    n_chars = F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Rows without a doc_id stay. Of rows that repeat a doc_id the least by all columns stays.
    """
    small_batches(spark)
    gone = saved(near_duplicates(docs, width=5, percent=80).filter("not kept").select("doc_id").distinct())
    left = docs.join(small(gone), "doc_id", "left_anti")
    again = saved(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    again = small(again)
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").select(docs.columns).union(one.select(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    small_batches(spark)
    return mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit) of every row and the bytes that they decode to."""
    small_batches(spark)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = decode(encode(docs, ranks, public_tokenizers.PATTERN, TOKEN_BLOCK_CHARS), ranks)
    return tokens.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokenize", tokenize),
]

# A fitted classifier, alignment and merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
