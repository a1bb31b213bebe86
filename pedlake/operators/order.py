"""Places in an order within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.plans.scratch import Scratch


def numbered(df: DataFrame, group: str, *order: str, name: str = "i") -> DataFrame:
    """df with each row's place, from 1, in the order of its group; rows with a null group have places too.

    Rows are sorted by ranges of (group, order) and written once with their running number in their part. A row per (part, group),
    of which there are at most parts + groups, tells where a group begins in a part and how many rows it has in the parts before.
    """
    spark = df.sparkSession
    t = Scratch(spark, "order").cut(df.orderBy(group, *order).withColumn("at_", F.monotonically_increasing_id()))
    part, mask = F.shiftright("at_", 33), (1 << 33) - 1
    t = t.withColumn("part_", part).withColumn("in_", F.col("at_").bitwiseAND(F.lit(mask)))
    seen: dict = {}
    rows = []
    for r in sorted(t.groupBy("part_", group).agg(F.min("in_").alias("a"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part_"]):
        rows.append((r["part_"], r[group], r["a"], seen.get(r[group], 0)))
        seen[r[group]] = seen.get(r[group], 0) + r["n"]
    if not rows:
        return t.drop("at_", "part_", "in_").withColumn(name, F.lit(0).cast("int"))
    kind = dict(df.dtypes)[group]
    start = F.broadcast(spark.createDataFrame(rows, f"p_ long, g_ {kind}, a_ long, before_ long"))
    t = t.join(start, (F.col("part_") == F.col("p_")) & F.col(group).eqNullSafe(F.col("g_")))
    return t.withColumn(name, (F.col("in_") - F.col("a_") + 1 + F.col("before_")).cast("int")).drop("at_", "part_", "in_", "p_", "g_", "a_", "before_")
