"""A cohort: samples, calls, traits, variants and gene sets with one record per key.

Ids are compared trimmed and in upper case. Of several records of an individual the last loaded one
that isn't deleted counts, of several calls of a cell (vidx, iid) the last loaded, of several values of a
trait the last measured. All of it is map-side combined (``max_by``), so repeated records never leave
their task; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.functions.keys import parent_id, same_id
from pedlake.sources.tables import table

#: Code of a missing phenotype.
MISSING = -9.0


@dataclass(frozen=True)
class Cohort:
    """samples (iid, fid, pat, mat, sex, pop, weight, founder); calls (vidx, iid, g); traits (iid, trait,
    kind, val); variants (vidx, chrom, id, pos, major, minor, qual, filt, anno, info); sets (gene, vidx)."""

    samples: DataFrame
    calls: DataFrame
    traits: DataFrame
    variants: DataFrame
    sets: DataFrame

    def called(self) -> DataFrame:
        """Cells with a genotype."""
        return self.calls.where(F.col("g").isNotNull())

    def trait(self, name: str) -> DataFrame:
        return self.traits.where((F.col("trait") == name) & F.col("val").isNotNull()).select("iid", "val")

    # lookups of an explorer session
    def variant(self, vidx: int) -> DataFrame:
        return self.variants.where(F.col("vidx") == vidx)

    def sample(self, iid: str) -> DataFrame:
        return self.samples.where(F.col("iid") == iid.strip(" \t").upper())

    def sizes(self) -> DataFrame:
        """Rows of each part."""
        parts = {"samples": self.samples, "variants": self.variants, "calls": self.calls, "traits": self.traits, "sets": self.sets}
        rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out


def samples(df: DataFrame) -> DataFrame:
    rec = F.struct(same_id("fid").alias("fid"), parent_id("pat").alias("pat"), parent_id("mat").alias("mat"), "sex", "proband", "twin", "pop", "weight")
    live = df.where(F.col("deleted_at").isNull() & F.col("iid").isNotNull())
    last = live.groupBy(same_id("iid").alias("iid")).agg(F.max_by(rec, F.struct("loaded_at", "sample_id")).alias("r"))
    return last.select("iid", "r.*").withColumn("founder", F.col("pat").isNull() & F.col("mat").isNull())


def calls(df: DataFrame) -> DataFrame:
    named = df.where(F.col("iid").isNotNull() & F.col("vidx").isNotNull())
    return named.groupBy("vidx", same_id("iid").alias("iid")).agg(F.max_by("g", F.struct("loaded_at", "geno_id")).alias("g"))


def traits(df: DataFrame) -> DataFrame:
    named = df.where(F.col("iid").isNotNull() & F.col("trait").isNotNull())
    rec = F.struct("kind", F.when(F.col("val") != MISSING, F.col("val")).alias("val"))
    return named.groupBy(same_id("iid").alias("iid"), "trait").agg(F.max_by(rec, F.struct("measured_at", "loaded_at", "pheno_id")).alias("r")).select("iid", "trait", "r.*")


def load(spark: SparkSession, folder: str) -> Cohort:
    read = lambda name: table(spark, folder, name)
    return Cohort(samples(read("samples")), calls(read("genotype")), traits(read("phenotype")), read("variants").dropDuplicates(["vidx"]), read("geneset").distinct())


#: The same cohort for DuckDB: s samples, g calls, p traits, v variants, gs sets.
_K = "upper(trim({0}, ' ' || chr(9)))"
COHORT_SQL = f"""
s AS MATERIALIZED (SELECT iid, fid, CASE WHEN pat <> '0' THEN pat END pat, CASE WHEN mat <> '0' THEN mat END mat, sex, pop, weight, coalesce(pat, '0') = '0' AND coalesce(mat, '0') = '0' founder FROM (
  SELECT {_K.format('iid')} iid, {_K.format('fid')} fid, {_K.format('pat')} pat, {_K.format('mat')} mat, sex, pop, weight, row_number() OVER (PARTITION BY {_K.format('iid')} ORDER BY loaded_at DESC, sample_id DESC) k
  FROM samples WHERE deleted_at IS NULL AND iid IS NOT NULL) WHERE k = 1),
g AS MATERIALIZED (SELECT vidx, iid, g FROM (SELECT vidx, {_K.format('iid')} iid, g, row_number() OVER (PARTITION BY vidx, {_K.format('iid')} ORDER BY loaded_at DESC, geno_id DESC) k FROM genotype WHERE iid IS NOT NULL) WHERE k = 1),
p AS MATERIALIZED (SELECT iid, trait, kind, nullif(val, -9) val FROM (SELECT {_K.format('iid')} iid, trait, kind, val, row_number() OVER (PARTITION BY {_K.format('iid')}, trait ORDER BY measured_at DESC, loaded_at DESC, pheno_id DESC) k FROM phenotype WHERE iid IS NOT NULL AND trait IS NOT NULL) WHERE k = 1),
v AS MATERIALIZED (SELECT vidx, any_value(chrom) chrom, any_value(id) id, any_value(pos) pos, any_value(gdist) gdist, any_value(major) major, any_value(minor) minor, any_value(qual) qual, any_value(filt) filt, any_value(anno) anno, any_value(info) info FROM (SELECT DISTINCT * FROM variants) GROUP BY vidx),
gs AS MATERIALIZED (SELECT DISTINCT gene, vidx FROM geneset)
"""
