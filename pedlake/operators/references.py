"""References to records that do not exist, from signed counts per key.

Every change is a delta row (key, at, refs, exists): a referring row counts +1 reference, a record
coming into force +1 existence, a record going out of force -1. Summed per key they are a state that
later deltas are added to (``fold``); summed along time they tell, for each reference, whether its
target was in force at that moment (``dangling``). Positive references with zero existence are orphans.

Scale: references are counted per (key, moment) before anything is shuffled, so a hot key arrives as
one row per moment. Running sums are taken per (key, month) and carried over months by a small table
of month totals: no task holds the whole history of a key. Rows come back by a semi join on the
orphan (key, moment) pairs, in which AQE splits a hot key.

Cases: exact duplicates count once; a record is in force from its start (included) to its end
(excluded), never if the start is null or not before the end; a null moment of a reference precedes
all records, so it dangles; keys holding a null are no references. Empty tables give empty reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedlake.functions.keys import parent_id, same_id
from pedlake.plans.scratch import Scratch

#: A moment before all others, for references without a time.
NEVER = "0001-01-01 00:00:00"


def existence_deltas(records: DataFrame, keys: list[str], start: str = "loaded_at", end: str = "deleted_at") -> DataFrame:
    """+1 where a record comes into force and -1 where it goes."""
    live = records.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))).where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    steps = F.filter(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d"))), lambda s: s["at"].isNotNull())
    return live.select(*keys, F.explode(steps).alias("s")).select(*keys, "s.at", F.lit(0).cast("long").alias("refs"), F.col("s.d").cast("long").alias("exists"))


def reference_deltas(refs: DataFrame, keys: list[str]) -> DataFrame:
    """+1 per referring row. refs has the key columns and ``at``."""
    return refs.select(*keys, "at", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"))


def fold(keys: list[str], *deltas: DataFrame) -> DataFrame:
    """State of signed counts per key: the sum of an earlier state and any number of deltas."""
    parts = [d.select(*keys, "refs", "exists") for d in deltas]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))


def orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and no existence."""
    return state.where((F.col("refs") > 0) & (F.col("exists") <= 0))


def dangling(keys: list[str], refs: DataFrame, records: DataFrame) -> DataFrame:
    """The distinct (key, at) of references whose target is not in force at that moment.

    The summed deltas and the result are written tables: each is far smaller than the references, and
    is read more than once.
    """
    scratch = Scratch(refs.sparkSession, "dangling")
    both = scratch.cut(reference_deltas(refs, keys).unionByName(existence_deltas(records, keys)).groupBy(*keys, "at").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))).withColumn("month", F.trunc("at", "month"))
    within = Window.partitionBy(*keys, "month").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    now = both.withColumn("run", F.sum("exists").over(within))
    totals = both.where(F.col("exists") != 0).groupBy(*keys, "month").agg(F.sum("exists").alias("net"))
    upto = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    # months in which something changed, each valid until the next such month
    spans = totals.select(*keys, F.col("month").alias("since"), F.sum("net").over(upto).alias("carry"), F.lead("month").over(Window.partitionBy(*keys).orderBy("month")).alias("until"))
    same = reduce(lambda a, b: a & b, (F.col(f"n.{k}") == F.col(f"c.{k}") for k in keys))
    held = now.where(F.col("refs") > 0).alias("n").join(spans.alias("c"), same & (F.col("c.since") < F.col("n.month")) & (F.col("c.until").isNull() | (F.col("n.month") <= F.col("c.until"))), "left")
    return scratch.cut(held.where(F.col("run") + F.coalesce("carry", F.lit(0)) <= 0).select(*(f"n.{k}" for k in keys), "n.at"))


def _rows(df: DataFrame, name: str, ref_id: str, fid: Column, iid: Column) -> DataFrame:
    at = F.coalesce(F.col("loaded_at"), F.lit(NEVER).cast("timestamp_ntz").cast(dict(df.dtypes)["loaded_at"]))
    return df.select(F.lit(name).alias("ref_table"), F.col(ref_id).alias("ref_id"), fid.alias("fid"), iid.alias("iid"), at.alias("at"))


def sample_references(phenotype: DataFrame, genotype: DataFrame) -> DataFrame:
    """Rows that name an individual by fid and iid, both not null."""
    rows = [_rows(df, name, ref_id, same_id("fid"), same_id("iid")) for df, name, ref_id in ((phenotype, "phenotype", "pheno_id"), (genotype, "genotype", "geno_id"))]
    return rows[0].unionByName(rows[1]).where(F.col("fid").isNotNull() & F.col("iid").isNotNull())


def parent_references(samples: DataFrame) -> DataFrame:
    """Rows of samples, one per named parent; ``iid`` is the parent's id."""
    parents = samples.withColumn("parent", F.explode(F.filter(F.array(parent_id("pat"), parent_id("mat")), lambda p: p.isNotNull())))
    return _rows(parents, "samples", "sample_id", same_id("fid"), F.col("parent"))


def dangling_rows(samples: DataFrame, phenotype: DataFrame, genotype: DataFrame) -> DataFrame:
    """(ref_table, ref_id, at), distinct: every row with a reference that dangles at its own moment."""
    recorded = samples.select(same_id("fid").alias("fid"), same_id("iid").alias("iid"), "loaded_at", "deleted_at", "sample_id").distinct()
    named, parents = sample_references(phenotype, genotype), parent_references(samples)
    by_person = named.join(dangling(["fid", "iid"], named, recorded), ["fid", "iid", "at"], "left_semi")
    by_parent = parents.join(dangling(["iid"], parents, recorded), ["iid", "at"], "left_semi")
    found = by_person.select("ref_table", "ref_id", "at").unionByName(by_parent.select("ref_table", "ref_id", "at"))
    return found.distinct()


def dangling_report(samples: DataFrame, phenotype: DataFrame, genotype: DataFrame) -> DataFrame:
    """Dangling rows and their share of all rows, per table and month of loaded_at."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    ids = (("samples", "sample_id", samples), ("phenotype", "pheno_id", phenotype), ("genotype", "geno_id", genotype))
    sizes = reduce(DataFrame.unionByName, (df.groupBy(F.lit(name).alias("ref_table"), month).agg(F.count(F.lit(1)).alias("n_read")) for name, _, df in ids))
    bad = dangling_rows(samples, phenotype, genotype).groupBy("ref_table", F.when(F.col("at") > F.lit(NEVER), F.date_format("at", "yyyy-MM")).alias("month")).agg(F.count(F.lit(1)).alias("n_dangling"))
    return sizes.alias("s").join(bad.alias("b"), (F.col("s.ref_table") == F.col("b.ref_table")) & F.col("s.month").eqNullSafe(F.col("b.month")), "left").select("s.ref_table", "s.month", "n_read", F.coalesce("n_dangling", F.lit(0)).alias("n_dangling"))


def current_state(samples: DataFrame, phenotype: DataFrame, genotype: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Signed counts (ref_table, month, fid, iid, refs, exists) after all deltas, ``earlier`` states included.

    References stand under their table and month, existence under null ones, so a state can be stored and folded with the
    deltas of later rows. A parent is an individual of whatever family: its fid is null. Exact duplicates count once.
    """
    rows = sample_references(phenotype.distinct(), genotype.distinct()).unionByName(parent_references(samples.distinct()).withColumn("fid", F.lit(None).cast("string")))
    refs = rows.select("ref_table", F.when(F.col("at") > F.lit(NEVER), F.date_format("at", "yyyy-MM")).alias("month"), "fid", "iid", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"))
    recorded = samples.select(same_id("fid").alias("fid"), same_id("iid").alias("iid"), "loaded_at", "deleted_at", "sample_id").distinct()
    by_person = existence_deltas(recorded, ["fid", "iid"])
    by_parent = existence_deltas(recorded, ["iid"]).withColumn("fid", F.lit(None).cast("string"))
    exists = by_person.unionByName(by_parent.select(by_person.columns)).select(F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("month"), "fid", "iid", "refs", "exists")
    parts = [refs, exists] if earlier is None else [refs, exists, earlier.select(refs.columns)]
    return fold(["ref_table", "month", "fid", "iid"], *parts)


def current_orphans(state: DataFrame) -> DataFrame:
    """(ref_table, month, fid, iid, refs): references of the state whose key has no existence, by table and period."""
    exists = state.where("ref_table is null").groupBy("fid", "iid").agg(F.sum("exists").alias("e")).where("e > 0")
    refs = state.where("ref_table is not null and refs > 0").alias("r")
    gone = refs.join(exists.alias("e"), F.col("r.fid").eqNullSafe(F.col("e.fid")) & (F.col("r.iid") == F.col("e.iid")), "left_anti")
    return gone.select("ref_table", "month", "fid", "iid", "refs")
