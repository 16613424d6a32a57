"""A training corpus from raw documents: language, near duplicates, benchmark passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
documents. The first four return the columns of documents; rows that a stage rejects are gone for the next. The order that
the mixture gives is that of its files and rows, and the token stage writes the stream in this order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark.llm import decontaminate, language_id, mixing, ngram_join, tokens_out
from slipspark.llm.common import table, written

#: Near duplicates: words of a shingle, and the least Jaccard similarity in hundredths. op6 has those of its contract.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; operator 10."""
    return language_id.in_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links join; operator 6."""
    return ngram_join.distinct_documents(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; operator 2."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes sources by target weights; operator 9."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the stored order of the documents, and what reading them back says; operator 4."""
    file = F.col("_metadata.file_name")
    number = F.regexp_extract(file, r"^part-(\d+)", 1).cast("int")  # files of a write are numbered in order
    stored = docs.select("doc_id", "text", number.alias("number"), file.alias("file"), F.col("_metadata.row_index").alias("nth"))
    return tokens_out.encoded(stored, "pipeline-tokens", order=["number", "file", "nth"])


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_output", token_ids),
]

#: The stages learn models and search similar texts, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
