"""Queries of keyword-stuffed and link-list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.llm import spam
from pedlake.sources.tables import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.stuffed(table(spark, folder, "documents")).where("stuffed").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and cases by tenth of the score."""
    tenth = F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int")
    return spam.stuffed(table(spark, folder, "documents")).groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("stuffed").alias("n_stuffed"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores}
SQL: dict[str, str] = {}
