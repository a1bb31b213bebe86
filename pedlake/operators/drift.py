"""Schemas that drift between files: field types by file, changes in order, and one table of all calls.

The type of a field in a file is folded over all its values through the lattice
integer < float < string, per line first and then per file, so lines are the unit of parallelism and a
file of any size is only ever summed. Files of a center are compared in order of arrival. That order is
taken per (center, month) and carried over months by a table of one row per month, so a center
that sends most files isn't sorted in one task.

Cases: header lines and null lines declare nothing; a line with fewer than nine columns has no FORMAT;
empty, `.` and `./.` values are missing, and a field without any value is an integer (nothing speaks
against it); fields left off the end of a cell are missing; a file without data lines has no fields;
files that arrive at one time are ordered by file_id; exact duplicate lines count once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedlake.plans.scratch import Scratch

#: The lattice, lowest first. Rank 0 is a missing value.
TYPES = ("integer", "float", "string")
SPARK_TYPES = {"integer": "bigint", "float": "double", "string": "string"}
WHOLE, SINGLE = r"^[+-]?[0-9]+\z", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def missing(v: Column) -> Column:
    return v.isNull() | v.isin("", ".", "./.")


def rank(v: Column) -> Column:
    """Place of one value in the lattice, from 1; 0 if missing."""
    return F.when(missing(v), 0).when(v.rlike(WHOLE), 1).when(v.rlike(SINGLE), 2).otherwise(3)


def _data_lines(lines: DataFrame) -> DataFrame:
    cols = F.split("raw_line", "\t")
    data = lines.where(~F.startswith(F.col("raw_line"), F.lit("#"))).withColumn("c", cols).where(F.size("c") >= 9)
    return data.withColumn("fmt", F.split(F.get("c", F.lit(8)), ":")).withColumn("cells", F.transform(F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0))), lambda x: F.split(x, ":")))


def file_fields(lines: DataFrame) -> DataFrame:
    """(center, file_id, received_at, fields array<struct<name,rank,wide>>), a row per file; wide tells of values that
    are too long for a 64-bit number."""
    ranks = F.transform("fmt", lambda f, i: F.struct(f.alias("name"), F.coalesce(F.array_max(F.transform("cells", lambda x: rank(F.get(x, i)))), F.lit(0)).alias("rank"), F.exists("cells", lambda x: F.coalesce(F.length(F.get(x, i)) > 18, F.lit(False))).alias("wide")))
    found = _data_lines(lines).select("file_id", F.explode(ranks).alias("f")).groupBy("file_id", F.col("f.name").alias("name")).agg(F.greatest(F.max("f.rank"), F.lit(1)).alias("rank"), F.bool_or("f.wide").alias("wide"))
    fields = found.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("name", "rank", "wide"))).alias("fields"))
    files = lines.groupBy("file_id").agg(F.min("center").alias("center"), F.min("received_at").alias("received_at"))
    nothing = F.array().cast(dict(fields.dtypes)["fields"])
    return files.join(fields, "file_id", "left").select("center", "file_id", "received_at", F.coalesce("fields", nothing).alias("fields"))


def with_previous(files: DataFrame) -> DataFrame:
    """Each file but the first of its center, with the file before it."""
    what = F.struct("file_id", "fields")
    f = files.withColumn("month", F.trunc("received_at", "month"))
    inside = Window.partitionBy("center", "month").orderBy("received_at", "file_id")
    last = f.groupBy("center", "month").agg(F.max_by(what, F.struct("received_at", "file_id")).alias("last"))
    carried = last.select("center", "month", F.lag("last").over(Window.partitionBy("center").orderBy("month")).alias("carried"))
    here = f.withColumn("before", F.lag(what).over(inside)).alias("f").join(carried.alias("c"), F.col("f.center").eqNullSafe(F.col("c.center")) & F.col("f.month").eqNullSafe(F.col("c.month")))
    return here.select("f.center", "f.file_id", "f.received_at", "f.fields", F.coalesce("f.before", "c.carried").alias("before")).where(F.col("before").isNotNull())


def _names(col: str) -> Column:
    return F.transform(col, lambda x: x["name"])


def _type(r: Column) -> Column:
    return F.get(F.array(*map(F.lit, TYPES)), r - 1)


def compare(files: DataFrame) -> DataFrame:
    """The changes of each file against the one before it, from ``file_fields``."""
    pair = with_previous(files).withColumns({"old": F.col("before.fields"), "new": F.col("fields")})
    only = lambda a, b: F.filter(a, lambda x: ~F.array_contains(_names(b), x["name"]))
    pair = pair.withColumns({"gone": only("old", "new"), "come": only("new", "old")})
    g, c = F.get("gone", F.lit(0)), F.get("come", F.lit(0))
    renamed = (F.size("gone") == 1) & (F.size("come") == 1) & (g["rank"] == c["rank"])
    row = lambda name, kind, new, old_rank, new_rank: F.struct(name.alias("field_name"), F.lit(kind).alias("change_kind"), new.alias("new_name"), _type(old_rank).alias("old_type"), _type(new_rank).alias("new_type"))
    no_name, no_rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    swap = F.when(renamed, F.array(row(g["name"], "renamed", c["name"], g["rank"], c["rank"])))
    moves = F.concat(F.transform("gone", lambda x: row(x["name"], "removed", no_name, x["rank"], no_rank)), F.transform("come", lambda x: row(x["name"], "added", no_name, no_rank, x["rank"])))
    both = F.filter(F.transform("old", lambda x: F.struct(x.alias("o"), F.get(F.filter("new", lambda y: y["name"] == x["name"]), F.lit(0)).alias("n"))), lambda p: p["n"].isNotNull() & (p["o"]["rank"] != p["n"]["rank"]))
    typed = F.transform(both, lambda p: row(p["o"]["name"], "type_changed", no_name, p["o"]["rank"], p["n"]["rank"]))
    out = pair.select("center", "received_at", "file_id", F.col("before.file_id").alias("previous_file_id"), F.explode(F.concat(F.coalesce(swap, moves), typed)).alias("r"))
    return out.select("center", "received_at", "file_id", "previous_file_id", "r.*")


def changes(lines: DataFrame) -> DataFrame:
    """Each change of a field between a file and the file before it of the same center."""
    return compare(Scratch(lines.sparkSession, "drift").cut(file_fields(lines)))


def _merge_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """Names of one center that are one field under several names.

    A rename joins two names unless two names of the joined group ever occur in one file. The name
    kept is the one used by most files of all centers. The input is a set of pairs of names.
    """
    group = {n: {n} for n in set(pdf["a"]) | set(pdf["b"])}
    apart = {frozenset(x) for x in pdf.loc[~pdf["renamed"], ["a", "b"]].itertuples(index=False)}
    weight = dict(zip(pdf["a"], pdf["n_a"])) | dict(zip(pdf["b"], pdf["n_b"]))
    for a, b in sorted(pdf.loc[pdf["renamed"], ["a", "b"]].itertuples(index=False, name=None)):
        x, y = group[a], group[b]
        if x is not y and not any(frozenset((p, q)) in apart for p in x for q in y):
            x |= y
            for n in y:
                group[n] = x
    kept = {n: max(g, key=lambda m: (weight[m], m)) for n, g in group.items()}
    center = pdf["center"].iloc[0]
    return pd.DataFrame([(center, n, k) for n, k in sorted(kept.items()) if n != k], columns=["center", "name", "kept"])


def one_name(files: DataFrame) -> DataFrame:
    """(center, names map<raw, kept>) for centers that renamed fields.

    What a center sends to one task is its set of pairs of field names, whose size depends on the
    vocabulary of field names and not on the number of files or calls.
    """
    pairs = files.select("center", F.explode(_names("fields")).alias("a"), _names("fields").alias("all")).select("center", "a", F.explode("all").alias("b"), F.lit(False).alias("renamed")).where("a < b").distinct()
    swaps = compare(files).where(F.col("change_kind") == "renamed").select("center", F.col("field_name").alias("a"), F.col("new_name").alias("b"), F.lit(True).alias("renamed")).distinct()
    use = files.select(F.explode(_names("fields")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    known = pairs.join(swaps.select("center").distinct(), "center", "left_semi").unionByName(swaps)
    known = known.join(use.select(F.col("name").alias("a"), F.col("n").alias("n_a")), "a").join(use.select(F.col("name").alias("b"), F.col("n").alias("n_b")), "b")
    merged = known.groupBy("center").applyInPandas(_merge_names, "center string, name string, kept string")
    return merged.groupBy("center").agg(F.map_from_entries(F.collect_list(F.struct("name", "kept"))).alias("names"))


def calls(lines: DataFrame) -> DataFrame:
    """One row per sample cell of all files, with a typed column for each field of the union schema.

    Columns center, file_id, line_id, sample_no, chrom, pos, variant, ref, alt, then the fields by
    name, cast to the lowest type of the lattice that holds all values of all files; whole numbers that don't fit
    64 bits make a field a string, a position that is no number is null. Names that a
    center changed are read under the name most files use. The driver learns the names of the fields and
    their types only: the schema of the result.
    """
    scratch = Scratch(lines.sparkSession, "calls")
    files = scratch.cut(file_fields(lines))
    names = scratch.cut(one_name(files))
    kept = F.coalesce(F.try_element_at("names", F.col("f.name")), F.col("f.name"))
    union = files.join(names, "center", "left").select("names", F.explode("fields").alias("f")).groupBy(kept.alias("name")).agg(F.max("f.rank").alias("rank"), F.bool_or("f.wide").alias("wide"))
    schema = sorted((r["name"], "string" if r["rank"] == 1 and r["wide"] else TYPES[r["rank"] - 1]) for r in union.collect())
    fixed = ["center", "file_id", "line_id"]
    data = _data_lines(lines.select(*fixed, "raw_line").distinct()).join(names, "center", "left")
    data = data.withColumn("fmt", F.when(F.col("names").isNull(), F.col("fmt")).otherwise(F.transform("fmt", lambda f: F.coalesce(F.try_element_at("names", f), f))))
    cell = data.select(*fixed, "c", "fmt", F.posexplode("cells").alias("sample_no", "cell"))
    at = lambda i: F.get("c", F.lit(i))

    def value(name: str, kind: str) -> Column:
        v = F.get("cell", F.array_position("fmt", name).cast("int") - 1)
        v = F.when((F.array_position("fmt", name) > 0) & ~missing(v), v)
        return v.try_cast(SPARK_TYPES[kind]).alias(name)

    taken = {"center", "file_id", "line_id", "sample_no", "chrom", "pos", "variant", "ref", "alt"}
    fields = []
    for n, k in schema:  # column names differ by more than letter case
        column = n
        while column.lower() in taken:
            column = f"field_{column}"
        taken.add(column.lower())
        fields.append(value(n, k).alias(column))
    return cell.select(*fixed, "sample_no", at(0).alias("chrom"), at(1).try_cast("bigint").alias("pos"), at(2).alias("variant"), at(3).alias("ref"), at(4).alias("alt"), *fields)
