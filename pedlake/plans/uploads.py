"""Queries of uploaded lines: rows that fail to parse, and schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.operators import drift
from pedlake.sources import delimited
from pedlake.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return delimited.read_fam_lines(table(spark, folder, "fam_line")).where(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def p4_samples(spark: SparkSession, folder: str) -> DataFrame:
    return delimited.fam_samples(delimited.read_fam_lines(table(spark, folder, "fam_line")))


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    read = delimited.read_fam_lines(table(spark, folder, "fam_line"))
    return read.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_lines"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("quoting", "columns", "values")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "vcf_line")).select("file_id", "field_name", "change_kind")


def p5_log(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "vcf_line"))


def p5_calls(spark: SparkSession, folder: str) -> DataFrame:
    return drift.calls(table(spark, folder, "vcf_line"))


QUERIES = {"p4_found": p4_found, "p4_samples": p4_samples, "p4_reasons": p4_reasons, "p5_found": p5_found, "p5_log": p5_log, "p5_calls": p5_calls}

_READ = r"""
WITH l AS (SELECT DISTINCT line_id, file_name, regexp_replace(coalesce(raw_line, ''), '^\s+|\s+$', '', 'g') t FROM fam_line),
f AS (SELECT line_id, file_name, t,
  t = '' OR regexp_full_match(t, '(?:[^ \t"]+|"(?:[^"]|"")*")(?:[ \t]+(?:[^ \t"]+|"(?:[^"]|"")*"))*') ok,
  list_transform(regexp_extract_all(t, '"(?:[^"]|"")*"|[^ \t"]+'), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) fields FROM l),
m AS (SELECT file_name, CASE WHEN count(*) FILTER (len(fields) = 5) > count(*) FILTER (len(fields) = 6) THEN 5 ELSE 6 END width FROM f WHERE ok GROUP BY file_name),
r AS (SELECT line_id, f.file_name, fields, CASE WHEN NOT ok THEN 'quoting' WHEN len(fields) <> coalesce(width, 6) THEN 'columns'
  WHEN NOT list_bool_and(list_transform(fields[1:2], lambda x: regexp_full_match(x, '[A-Za-z0-9._ \-]+') AND regexp_matches(x, '[A-Za-z0-9]') AND upper(trim(x)) NOT IN ('0', '-9', 'NA', 'NULL'))) THEN 'values' END reason
  FROM f LEFT JOIN m ON f.file_name IS NOT DISTINCT FROM m.file_name)
"""
_FILES = r"""
WITH d AS (SELECT DISTINCT file_id, line_id, string_split(raw_line, chr(9)) c FROM vcf_line WHERE raw_line NOT LIKE '#%' AND len(string_split(raw_line, chr(9))) >= 9),
x AS (SELECT file_id, string_split(c[9], ':') fmt, unnest(CASE WHEN len(c) > 9 THEN c[10:] ELSE [''] END) cell FROM d),
v AS (SELECT file_id, unnest(fmt) field, unnest(list_transform(range(1, len(fmt) + 1), lambda i: string_split(cell, ':')[i])) val FROM x),
t AS (SELECT file_id, field, max(CASE WHEN coalesce(val, '') IN ('', '.', './.') THEN 1 WHEN regexp_full_match(val, '[+-]?[0-9]+') THEN 1
  WHEN regexp_full_match(val, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 2 ELSE 3 END) k FROM v GROUP BY ALL),
o AS (SELECT file_id, center, received_at, lag(file_id) OVER (PARTITION BY center ORDER BY received_at, file_id) before FROM (SELECT file_id, min(center) center, min(received_at) received_at FROM vcf_line GROUP BY file_id)),
p AS (SELECT * FROM o WHERE before IS NOT NULL),
gone AS (SELECT p.file_id, a.field, a.k FROM p JOIN t a ON a.file_id = before WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.file_id = p.file_id AND b.field = a.field)),
come AS (SELECT p.file_id, a.field, a.k FROM p JOIN t a ON a.file_id = p.file_id WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.file_id = p.before AND b.field = a.field)),
ren AS (SELECT g.file_id, g.field old, c.field new, g.k FROM gone g JOIN come c USING (file_id, k) WHERE file_id IN (SELECT file_id FROM gone GROUP BY 1 HAVING count(*) = 1) AND file_id IN (SELECT file_id FROM come GROUP BY 1 HAVING count(*) = 1)),
ch AS (SELECT file_id, old field_name, 'renamed' change_kind, k k1, k k2, new new_name FROM ren
  UNION ALL SELECT file_id, field, 'removed', k, NULL, NULL FROM gone WHERE file_id NOT IN (SELECT file_id FROM ren)
  UNION ALL SELECT file_id, field, 'added', NULL, k, NULL FROM come WHERE file_id NOT IN (SELECT file_id FROM ren)
  UNION ALL SELECT p.file_id, a.field, 'type_changed', a.k, b.k, NULL FROM p JOIN t a ON a.file_id = before JOIN t b ON b.file_id = p.file_id AND a.field = b.field WHERE a.k <> b.k)
"""
_T = "CASE {0} WHEN 1 THEN 'integer' WHEN 2 THEN 'float' WHEN 3 THEN 'string' END"

SQL = {
    "p4_found": _READ + "SELECT DISTINCT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p4_samples": _READ
    + r"""SELECT line_id, file_name, upper(trim(fields[1])) fid, upper(trim(fields[2])) iid, nullif(upper(trim(fields[3])), '0') pat, nullif(upper(trim(fields[4])), '0') mat,
  CAST(CASE WHEN fields[5] IN ('1', '2') THEN fields[5] END AS TINYINT) sex,
  CAST(CASE WHEN fields[6] <> '-9' AND regexp_full_match(fields[6], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN fields[6] END AS DOUBLE) trait FROM r WHERE reason IS NULL""",
    "p4_reasons": _READ + "SELECT file_name, count(*) n_lines, count(*) FILTER (reason = 'quoting') n_quoting, count(*) FILTER (reason = 'columns') n_columns, count(*) FILTER (reason = 'values') n_values FROM r GROUP BY file_name",
    "p5_found": _FILES + "SELECT file_id, field_name, change_kind FROM ch",
    "p5_log": _FILES + f"SELECT center, received_at, ch.file_id, before AS previous_file_id, field_name, change_kind, new_name, {_T.format('k1')} old_type, {_T.format('k2')} new_type FROM ch JOIN p USING (file_id)",
}
