"""Queries of hierarchies, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.operators.hierarchy import hierarchy
from pedlake.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(table(spark, folder, "person"), descendants=False).nodes().where("in_cycle").select("famid", "pid")


def p3_tree(spark: SparkSession, folder: str) -> DataFrame:
    nodes = hierarchy(table(spark, folder, "person")).nodes().where("has_row")
    return nodes.select("famid", "pid", F.array_join("path", "/").alias("path"), "depth", "root", "n_descendants", "in_cycle")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(table(spark, folder, "person")).pairs()


QUERIES = {"p3_found": p3_found, "p3_tree": p3_tree, "p3_descendants": p3_descendants}

_K = "upper(trim({0}, ' ' || chr(9)))"
_UP = f"""
WITH RECURSIVE n AS (SELECT DISTINCT {_K.format('famid')} famid, {_K.format('pid')} pid, nullif({_K.format('fatid')}, '0') fatid, nullif({_K.format('motid')}, '0') motid FROM person WHERE famid IS NOT NULL AND pid IS NOT NULL),
e AS (SELECT famid, pid c, fatid p FROM n WHERE fatid IS NOT NULL UNION SELECT famid, pid, motid FROM n WHERE motid IS NOT NULL),
r(famid, d, a) AS (SELECT famid, c, p FROM e UNION SELECT r.famid, r.d, e.p FROM r JOIN e ON e.famid = r.famid AND e.c = r.a),
f AS (SELECT famid, pid, min(fatid) fatid FROM n GROUP BY ALL),
l(famid, pid, top, path, n) AS (SELECT DISTINCT famid, pid, pid, pid, 0 FROM n
  UNION ALL SELECT l.famid, l.pid, f.fatid, l.path || '/' || f.fatid, n + 1 FROM l JOIN f ON f.famid = l.famid AND f.pid = l.top WHERE f.fatid IS NOT NULL AND n < 1000 AND NOT list_contains(string_split(l.path, '/'), f.fatid))
"""

SQL = {
    "p3_found": _UP + "SELECT famid, d AS pid FROM r WHERE d = a",
    "p3_descendants": _UP + "SELECT famid, a AS pid, d AS descendant FROM r",
    "p3_tree": _UP
    + """, t AS (SELECT l.famid, l.pid, path, n AS depth, top AS root FROM l LEFT JOIN f ON f.famid = l.famid AND f.pid = l.top WHERE f.fatid IS NULL),
  k AS (SELECT famid, a, count(*) n FROM r GROUP BY ALL)
SELECT p.famid, p.pid, path, CAST(depth AS INTEGER) depth, root, coalesce(k.n, 0) n_descendants, r.d IS NOT NULL in_cycle
FROM (SELECT DISTINCT famid, pid FROM n) p LEFT JOIN t USING (famid, pid) LEFT JOIN k ON k.famid = p.famid AND k.a = p.pid LEFT JOIN r ON r.famid = p.famid AND r.d = p.pid AND r.a = p.pid""",
}
