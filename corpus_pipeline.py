"""From raw documents to packed sequences of training tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.exact import drop_exact_duplicates
from feedloom.llm.minhash import drop_near_duplicates
from feedloom.llm.packing import pack
from feedloom.llm.passages import drop_repeated_passages
from feedloom.llm.quality import keep_quality
from feedloom.llm.queries import BYTE_BPE
from feedloom.session import materialize

#: A classifier and packing have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return drop_near_duplicates(docs, threshold=0.8, size=5)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay where they come first."""
    cleaned = drop_repeated_passages(docs, least=3, words=15, enough=50, report=None, anywhere=50)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of sequences of 1024 tokens, with their ids."""
    return pack(docs, BYTE_BPE, end_id=0, capacity=1024)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
