"""Queries of dangling references, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.operators import references as R
from pedlake.plans.scratch import Scratch
from pedlake.sources.tables import table


def _tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("samples", "phenotype", "genotype")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return R.dangling_rows(*_tables(spark, folder)).select("ref_table", "ref_id").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.dangling_report(*_tables(spark, folder))


def p1_current(spark: SparkSession, folder: str) -> DataFrame:
    """Keys without a record in force after all deltas, with their references by table and month."""
    scratch = Scratch(spark, "current")
    return R.current_orphans(scratch.cut(R.current_state(*_tables(spark, folder)))).select("ref_table", "month", "fid", "iid", F.col("refs").alias("n_refs"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_current": p1_current}

_K = "upper(trim({0}, ' ' || chr(9)))"
_S = f"(SELECT DISTINCT {_K.format('fid')} fid, {_K.format('iid')} iid, CASE WHEN {_K.format('pat')} <> '0' THEN {_K.format('pat')} END pat, CASE WHEN {_K.format('mat')} <> '0' THEN {_K.format('mat')} END mat, loaded_at, deleted_at, sample_id FROM samples)"
_FOUND = f"""
WITH s AS {_S},
r AS (SELECT 'phenotype' ref_table, pheno_id ref_id, {_K.format('fid')} fid, {_K.format('iid')} iid, loaded_at FROM phenotype
      UNION ALL SELECT 'genotype', geno_id, {_K.format('fid')}, {_K.format('iid')}, loaded_at FROM genotype),
bad AS (
  SELECT DISTINCT ref_table, ref_id, loaded_at FROM r WHERE fid IS NOT NULL AND iid IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM s WHERE s.fid = r.fid AND s.iid = r.iid AND s.loaded_at <= r.loaded_at AND (s.deleted_at IS NULL OR r.loaded_at < s.deleted_at))
  UNION
  SELECT DISTINCT 'samples', c.sample_id, c.loaded_at FROM (SELECT sample_id, loaded_at, pat p FROM s UNION SELECT sample_id, loaded_at, mat FROM s) c WHERE p IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM s WHERE s.iid = c.p AND s.loaded_at <= c.loaded_at AND (s.deleted_at IS NULL OR c.loaded_at < s.deleted_at)))
"""

SQL = {
    "p1_found": _FOUND + "SELECT DISTINCT ref_table, ref_id FROM bad",
    "p1_report": _FOUND
    + """, n AS (SELECT 'samples' ref_table, strftime(loaded_at, '%Y-%m') AS month, count(*) n_read FROM samples GROUP BY ALL
      UNION ALL SELECT 'phenotype', strftime(loaded_at, '%Y-%m'), count(*) FROM phenotype GROUP BY ALL
      UNION ALL SELECT 'genotype', strftime(loaded_at, '%Y-%m'), count(*) FROM genotype GROUP BY ALL),
  b AS (SELECT ref_table, strftime(loaded_at, '%Y-%m') AS month, count(*) n FROM bad GROUP BY ALL)
SELECT n.ref_table, n.month, n_read, coalesce(b.n, 0) n_dangling FROM n LEFT JOIN b ON n.ref_table = b.ref_table AND n.month IS NOT DISTINCT FROM b.month""",
    "p1_current": f"""
WITH s AS {_S},
r AS (SELECT 'phenotype' ref_table, {_K.format('fid')} fid, {_K.format('iid')} iid, loaded_at FROM (SELECT DISTINCT * FROM phenotype)
      UNION ALL SELECT 'genotype', {_K.format('fid')}, {_K.format('iid')}, loaded_at FROM (SELECT DISTINCT * FROM genotype)),
q AS (SELECT * FROM r WHERE fid IS NOT NULL AND iid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.fid = r.fid AND s.iid = r.iid AND s.deleted_at IS NULL AND s.loaded_at IS NOT NULL)
      UNION ALL SELECT 'samples', NULL, p, loaded_at FROM (SELECT pat p, loaded_at FROM s UNION ALL SELECT mat, loaded_at FROM s) c WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.iid = c.p AND s.deleted_at IS NULL AND s.loaded_at IS NOT NULL))
SELECT ref_table, strftime(loaded_at, '%Y-%m') AS month, fid, iid, count(*) n_refs FROM q GROUP BY ALL""",
}
