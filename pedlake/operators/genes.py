"""Gene sets and rare-variant tests.

Sets come from lists, from ranges or from consecutive variants. Per (gene, sample) collapses are partial
aggregations; test statistics are closed forms over one row per gene. Tests that need a gene's matrix of
variants are in ``gene_tests``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.operators.cohort import Cohort
from pedlake.operators.order import numbered
from pedlake.operators.qc import allele_freq

BIN = 1_000_000


def gene_summary(c: Cohort) -> DataFrame:
    """Chromosome, number of variants, first and last position of each gene."""
    t = c.sets.join(c.variants.select("vidx", "chrom", "pos"), "vidx")
    return t.groupBy("gene", "chrom").agg(F.count(F.lit(1)).alias("n_variant"), F.min("pos").alias("start"), F.max("pos").alias("end"))


def consecutive_sets(c: Cohort, k: int = 10, overlap: int = 0) -> DataFrame:
    """Sets of k variants in the order of position in each chromosome, the last may be shorter."""
    step = max(1, k - overlap)
    t = numbered(c.variants.where("chrom is not null and pos is not null").select("vidx", "chrom", "pos"), "chrom", "pos", "vidx").withColumn("i", F.col("i") - 1)
    last = F.floor(F.col("i") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - k + 1) / step))
    return t.select("chrom", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("set_no"), "vidx")


def range_join(points: DataFrame, ranges: DataFrame, width: int = BIN) -> DataFrame:
    """points (chrom, pos) within ranges (chrom, start, end), by bins: an equi join on (chrom, bin).

    A range is listed in each bin that it touches, a point in one, so every match is found once.
    """
    r = ranges.where("start <= end").withColumn("bin_", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))).withColumnRenamed("chrom", "chrom_")
    p = points.withColumn("bin__", F.floor(F.col("pos") / width))
    return p.join(r, (F.col("chrom") == F.col("chrom_")) & (F.col("bin_") == F.col("bin__")) & F.col("pos").between(F.col("start"), F.col("end"))).drop("chrom_", "bin_", "bin__")


def near_genes(c: Cohort, span: int = 50_000) -> DataFrame:
    """Variants within ``span`` bases of a gene's interval, with the distance (0 inside)."""
    genes = gene_summary(c).where("chrom is not null and start is not null").select("gene", "chrom", (F.col("start") - span).alias("start"), (F.col("end") + span).alias("end"))
    t = range_join(c.variants.where("pos is not null").select("vidx", "chrom", "pos"), genes)
    d = F.greatest(F.lit(0), F.col("start") + span - F.col("pos"), F.col("pos") - (F.col("end") - span))
    return t.select("vidx", "gene", d.cast("int").alias("distance"))


def annotated(c: Cohort, span: int = 50_000) -> DataFrame:
    """Each variant with its near genes in one text, or null: genic and intergenic variants."""
    t = near_genes(c, span).groupBy("vidx").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("distance") == 0, F.col("gene")).otherwise(F.concat("gene", F.lit("("), F.col("distance"), F.lit(")"))))), ",").alias("genes"))
    return c.variants.select("vidx").join(t, "vidx", "left")


def _minor(c: Cohort) -> DataFrame:
    """Cells with the minor count: flipped where the founder frequency is above one half."""
    f = allele_freq(c).select("vidx", "maf", "flipped")
    return c.called().join(f, "vidx").select("vidx", "iid", F.when(F.col("flipped"), 2 - F.col("g")).otherwise(F.col("g")).alias("m"), "maf")


def collapsed(c: Cohort, rare: float = 0.05) -> DataFrame:
    """Per gene and sample: whether it carries a rare allele (CMC) and its weighted count (burden).

    Weights are the Beta(p; 1, 25) density over 25.
    """
    t = _minor(c).where((F.col("maf") <= rare) & (F.col("maf") > 0)).join(c.sets, "vidx")
    return t.groupBy("gene", "iid").agg(F.max((F.col("m") > 0).cast("int")).alias("carrier"), F.sum(F.col("m") * F.pow(1 - F.col("maf"), 24)).alias("burden"), F.sum("m").cast("long").alias("n_allele"))


def burden_tests(c: Cohort, trait: str, rare: float = 0.05) -> DataFrame:
    """CMC and collapsing scores per gene: covariance of the collapsed genotype with the centred trait,
    over its standard deviation. Samples without calls in the gene are left out."""
    y = c.trait(trait)
    mean = y.agg(F.avg("val").alias("mean"))
    t = collapsed(c, rare).join(y.crossJoin(F.broadcast(mean)), "iid").withColumn("w", F.col("val") - F.col("mean"))  # one row
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum("n_allele").alias("mac")]
    for x in ("carrier", "burden"):
        aggs += [F.sum(x).cast("double").alias(f"s_{x}"), F.sum(F.col(x) * F.col(x)).cast("double").alias(f"ss_{x}"), F.sum(F.col(x) * F.col("w")).alias(f"w_{x}")]
    m = t.groupBy("gene").agg(*aggs)
    n = F.col("n").cast("double")

    def stat(x: str):
        s, ss, w = F.col(f"s_{x}"), F.col(f"ss_{x}"), F.col(f"w_{x}")
        var = (ss - s * s / n) * (F.col("ww") - F.col("sw") * F.col("sw") / n) / n
        u = w - s * F.col("sw") / n
        return F.when(var > 1e-12, u * u / F.when(var > 1e-12, var))

    return m.select("gene", "n", "mac", stat("carrier").alias("stat_cmc"), stat("burden").alias("stat_clp"))


def neighbours_ld(c: Cohort, k: int = 2) -> DataFrame:
    """r and r squared between each variant and the next k of its chromosome, over samples with both calls."""
    order = numbered(c.variants.where("chrom is not null and pos is not null").select("vidx", "chrom", "pos"), "chrom", "pos", "vidx").select("vidx", "chrom", "i")
    step = order.select("vidx", "chrom", F.explode(F.sequence(F.col("i") + 1, F.col("i") + k)).alias("i"))
    pairs = step.join(order.select(F.col("vidx").alias("vidx2"), "chrom", "i"), ["chrom", "i"]).select("vidx", "vidx2")
    g = c.called()
    t = g.join(pairs, "vidx").join(g.select(F.col("vidx").alias("vidx2"), "iid", F.col("g").alias("h")), ["vidx2", "iid"])
    x, y = F.col("g").cast("double"), F.col("h").cast("double")
    m = t.groupBy(F.col("vidx").alias("vidx1"), "vidx2").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n = F.col("n")
    vx, vy, cxy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy"), n * F.col("sxy") - F.col("sx") * F.col("sy")
    r = F.when((vx > 0) & (vy > 0), cxy / F.sqrt(vx * vy))
    return m.select("vidx1", "vidx2", "n", r.alias("r"), (r * r).alias("r2"))
