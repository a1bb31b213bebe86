"""Queries over documents: encoding and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.llm import mixing, tokenizer
from pedlake.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"))


def p6_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and characters of each source."""
    docs = tokenizer.count_tokens(table(spark, folder, "documents"), keep=("doc_id", "source", "n_chars"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).select("doc_id", "source", "n_tokens", "copies")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


QUERIES = {"p6_ids": p6_ids, "p6_sizes": p6_sizes, "p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
