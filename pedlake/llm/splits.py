"""Train, validation and test splits that keep related records together.

Families tied by an individual (as iid, pat or mat) form components, found by frontier breadth-first
search (``operators.components``). Components are laid out in the order of their hashes, and the line
of all rows is cut at the target shares. Components so large that one of them could spoil a share are
placed first, largest first, each into the split that lacks most; there are at most ``1 / big`` of them.

Scale: the order over all components is a prefix sum in two steps, totals of 4096 hash ranges and a
running sum inside each range, so no task sorts all components. Rows themselves are never shuffled
for the split but by family.

Cases: a row without fid is held together by its iid, one without both stands alone; exact duplicate
rows count once; without targets, or with no rows, the result is empty; shares are normalised to sum 1
and null or negative ones count as 0. The same rows always get the same split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pedlake.functions.keys import parent_id, same_id
from pedlake.operators.components import components
from pedlake.plans.scratch import Scratch

#: A component of more than this share of all rows is placed on its own.
BIG = 0.001
MOST_TARGETS = 1000
RANGE_BITS = 12


def units(samples: DataFrame) -> DataFrame:
    """Each distinct row's sample_id with the unit that must stay whole, and the individuals it names."""
    fid, iid = same_id("fid"), same_id("iid")
    unit = F.coalesce(F.concat(F.lit("F"), fid), F.concat(F.lit("I"), iid), F.concat(F.lit("R"), F.col("sample_id").cast("string")))
    return samples.distinct().select("sample_id", unit.alias("unit"), F.filter(F.array(iid, parent_id("pat"), parent_id("mat")), lambda x: x.isNotNull()).alias("persons"))


def ties(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between units that name one individual: a star around the person's least unit."""
    named = rows.select("unit", F.explode("persons").alias("person")).distinct()
    shared = named.groupBy("person").agg(F.min("unit").alias("a"), F.max("unit").alias("z")).where("a < z").select("person", "a")
    return named.join(shared, "person").where("unit != a").select("a", F.col("unit").alias("b")).distinct()


def family_components(samples: DataFrame) -> DataFrame:
    """(vertex, component) of all units that are tied to another one."""
    rows = Scratch(samples.sparkSession, "units").cut(units(samples).select("unit", "persons").distinct())
    return components(ties(rows))


def tied_pairs(samples: DataFrame) -> DataFrame:
    """Pairs of different families in one component, the lesser first."""
    c = family_components(samples).where(F.startswith(F.col("vertex"), F.lit("F"))).select(F.substring("vertex", 2, 1 << 30).alias("fid"), "component")
    c = Scratch(samples.sparkSession, "pairs").cut(c)
    return c.withColumnRenamed("fid", "fid_a").join(c.withColumnRenamed("fid", "fid_b"), "component").where("fid_a < fid_b").select("fid_a", "fid_b")


def assign(samples: DataFrame, targets: DataFrame, big: float = BIG) -> DataFrame:
    """(sample_id, unit, component, split_name) for every distinct row of samples."""
    spark = samples.sparkSession
    scratch = Scratch(spark, "splits")
    rows = scratch.cut(units(samples))
    total = scratch.rows
    named = targets.distinct().orderBy("split_name").limit(MOST_TARGETS + 1).collect()
    if len(named) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    goals = [(r["split_name"], max(0.0, r["target_share"] or 0.0)) for r in named]
    whole = sum(s for _, s in goals)
    joined = components(ties(rows)).select(F.col("vertex").alias("unit"), "component")
    sized = scratch.cut(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).join(joined, "unit", "left").select("unit", F.coalesce("component", "unit").alias("component"), "n"))
    comps = scratch.cut(sized.groupBy("component").agg(F.sum("n").alias("n")))
    if not total or not whole:
        return rows.select("sample_id", "unit", F.col("unit").alias("component"), F.lit(None).cast("string").alias("split_name")).limit(0)

    lack = {name: total * s / whole for name, s in goals}
    placed = []
    for r in comps.where(F.col("n") > total * big).orderBy(F.desc("n"), "component").collect():  # at most 1 / big rows
        name = max(lack, key=lambda k: (lack[k], k))
        lack[name] -= r["n"]
        placed.append((r["component"], name))

    small = comps.where(F.col("n") <= total * big).withColumn("h", F.xxhash64("component")).withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    sums = sorted((r["range"], r["n"]) for r in small.groupBy("range").agg(F.sum("n").alias("n")).collect())  # at most 2 ** RANGE_BITS rows
    starts, run = [], 0
    for k, n in sums:
        starts.append((k, run))
        run += n
    room = sum(max(0.0, x) for x in lack.values()) or 1.0
    ends, upto = [], 0.0
    for name, _ in goals:
        upto += max(0.0, lack[name]) / room * run
        ends.append((name, upto))
    begin = F.broadcast(spark.createDataFrame(starts, "range long, start long"))
    middle = F.col("start") + F.sum("n").over(Window.partitionBy("range").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2
    split = F.coalesce(*(F.when(F.col("at") <= end, F.lit(name)) for name, end in ends), F.lit(max(ends, key=lambda x: x[1])[0]))
    chosen = small.withColumn("range", F.col("range").cast("long")).join(begin, "range").withColumn("at", middle).select("component", split.alias("split_name"))
    if placed:
        chosen = chosen.unionByName(spark.createDataFrame(placed, "component string, split_name string"))
    return rows.select("sample_id", "unit").join(sized.select("unit", "component").join(chosen, "component"), "unit").select("sample_id", "unit", "component", "split_name")


def shares(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows and components of each split, with the share reached and the target."""
    got = assign(samples, targets).groupBy("split_name", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("split_name").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"))
    whole = Window.partitionBy()  # a row per split
    out = targets.distinct().join(got, "split_name", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.select("split_name", "target_share", "n_rows", (F.col("n_rows") / F.sum("n_rows").over(whole)).alias("share"), F.coalesce("n_components", F.lit(0)).alias("n_components"))
