"""The named queries of this package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipspark.llm import collocations, cross_polytope, decontaminate, hard_negatives, language_id, line_dedup, mixing, ngram_join, pii, quality, token_counts, tokens_out, tool_calls
from slipspark.llm.common import table
from slipspark.llm.queries_sql import SQL as SQL


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.digest(tool_calls.link(calls, results, tool_calls.SCHEMAS))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_out.encoded(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.length("prefix_deltas").cast("long").alias("stored_bytes"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)
    return joined.select("doc_id", "n_shingles", "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.schedule(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.fit(docs.where(~language_id.held_out()))
    said = language_id.identify(docs.select("doc_id", "text"), filters)
    return said.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cross_polytope.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepared(vectors, label, F.col("vec_id") % 100 == 0))


QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_token_output": op4_token_output,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_nearest": op12_nearest,
    "op13_hard_negatives": op13_hard_negatives,
}
