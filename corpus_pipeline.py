"""The documents table, cleaned and packed in stages; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.decontamination import drop_leaks
from pagemill.llm.jaccard import drop_near_duplicates
from pagemill.llm.lines import drop_near_lines
from pagemill.llm.packing import pack_documents
from pagemill.llm.quality import keep_good
from pagemill.operators.stage import Stage


def good_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return drop_near_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return drop_near_duplicates(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return pack_documents(docs).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_leaks),
    ("best-fit packing", packed),
]

# Packing has no SQL form; its result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = stage.save(step(spark, docs, folder), f"{k}")
    return docs
