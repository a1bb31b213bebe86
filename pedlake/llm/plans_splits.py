"""Queries of splits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pedlake.llm import splits
from pedlake.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.tied_pairs(table(spark, folder, "samples"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign(table(spark, folder, "samples"), table(spark, folder, "split_targets")).select("sample_id", "split_name")


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    return splits.shares(table(spark, folder, "samples"), table(spark, folder, "split_targets"))


QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_shares": p2_shares}

_K = "upper(trim({0}, ' ' || chr(9)))"
SQL = {
    "p2_found": f"""
WITH RECURSIVE n AS (
  SELECT DISTINCT {_K.format('fid')} fid, {_K.format('iid')} p FROM samples WHERE fid IS NOT NULL AND iid IS NOT NULL
  UNION SELECT DISTINCT {_K.format('fid')}, {_K.format('pat')} FROM samples WHERE fid IS NOT NULL AND {_K.format('pat')} <> '0'
  UNION SELECT DISTINCT {_K.format('fid')}, {_K.format('mat')} FROM samples WHERE fid IS NOT NULL AND {_K.format('mat')} <> '0'),
e AS (SELECT DISTINCT a.fid a, b.fid b FROM n a JOIN n b ON a.p = b.p AND a.fid <> b.fid),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS fid_a, b AS fid_b FROM r WHERE a < b"""
}
