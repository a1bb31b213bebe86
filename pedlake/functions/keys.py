"""Equality of ids: surrounding blanks and tabs and letter case do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_id(col: str | Column) -> Column:
    """The id trimmed of blanks and tabs, in upper case. Null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.btrim(c, F.lit(" \t")))


def parent_id(col: str | Column) -> Column:
    """As same_id, but null for the codes that mean "no parent" (null and 0)."""
    k = same_id(col)
    return F.when(k != F.lit("0"), k)


def natural_key(col: str | Column) -> Column:
    """A key that sorts numbers inside a name by their value: v2 before v10. Numbers of more than 20 digits sort by their last 20."""
    parts = F.regexp_extract_all(F.lower(col), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), 20, "0")).otherwise(x)), "")


def numbered_names(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with repeated names told apart: the second and later of one name, in the order given, get _2, _3 and so on."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("k_", k).withColumn(name, F.when(F.col("k_") > 1, F.concat(F.col(name), F.lit("_"), F.col("k_").cast("string"))).otherwise(F.col(name))).drop("k_")
