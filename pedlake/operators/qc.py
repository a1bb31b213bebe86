"""Quality control: frequencies, Hardy-Weinberg, missingness, heterozygosity, Mendelian errors, F_ST, densities.

Every operator is one or two partial aggregations over calls; what is joined to calls (sample flags,
variant frequencies) has a row per sample or per variant. Ratios with a zero denominator are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedlake.functions.stats import fisher_exact, hwe_exact
from pedlake.operators.cohort import Cohort


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def count_if(c: Column) -> Column:
    return F.count_if(c)


def _with_samples(c: Cohort, *cols: str) -> DataFrame:
    return c.called().join(c.samples.select("iid", *cols), "iid")


def allele_freq(c: Cohort) -> DataFrame:
    """Minor-allele frequency over all and over founders. A founder frequency above one half flips the
    variant; ``mac`` is the minor count after the flip, ``mac_raw`` before."""
    g = F.col("g").cast("long")
    f = F.when(F.col("founder"), g)
    t = _with_samples(c, "founder").groupBy("vidx").agg(F.sum(g).alias("a"), F.count("g").alias("n"), F.coalesce(F.sum(f), F.lit(0)).alias("fa"), F.count(f).alias("fn"))
    p, pf = ratio(F.col("a"), 2 * F.col("n")), F.coalesce(ratio(F.col("fa"), 2 * F.col("fn")), F.lit(0.0))
    flip = pf > 0.5
    return t.select("vidx", F.when(flip, 1 - p).otherwise(p).alias("maf"), F.when(flip, 2 * F.col("n") - F.col("a")).otherwise(F.col("a")).alias("mac"), F.col("a").alias("mac_raw"), F.when(flip, 1 - pf).otherwise(pf).alias("fmaf"), F.col("n").alias("nind"), F.col("fn").alias("nfounder"), flip.alias("flipped"))


def genotype_counts(c: Cohort, founders: bool = False) -> DataFrame:
    """n0, n1, n2 and n per variant."""
    t = _with_samples(c, "founder")
    t = t.where("founder") if founders else t
    return t.groupBy("vidx").agg(*(count_if(F.col("g") == k).alias(f"n{k}") for k in (0, 1, 2)), F.count("g").alias("n"))


def hwe(c: Cohort, founders: bool = False) -> DataFrame:
    """Observed and expected heterozygosity with the chi-square statistic of Hardy-Weinberg equilibrium."""
    t = genotype_counts(c, founders)
    n = F.col("n").cast("double")
    p = (F.col("n1") + 2 * F.col("n2")) / (2 * n)
    e = [n * (1 - p) * (1 - p), 2 * n * p * (1 - p), n * p * p]
    chi = sum(((F.col(f"n{k}") - e[k]) * (F.col(f"n{k}") - e[k]) / F.nullif(e[k], F.lit(0.0)) for k in (0, 1, 2)), F.lit(0.0))
    return t.select("vidx", "n0", "n1", "n2", (F.col("n1") / n).alias("o_het"), (2 * p * (1 - p)).alias("e_het"), F.when((p > 0) & (p < 1), chi).alias("stat_hwe"))


def hwe_test(c: Cohort, founders: bool = False) -> DataFrame:
    """``hwe`` with the exact two-sided p-value."""
    return hwe(c, founders).withColumn("p_exact", hwe_exact("n0", "n1", "n2"))


def variant_missing(c: Cohort) -> DataFrame:
    return c.calls.groupBy("vidx").agg(F.count(F.lit(1)).alias("n_cells"), count_if(F.col("g").isNull()).alias("n_missing")).withColumn("call_rate", 1 - ratio(F.col("n_missing"), F.col("n_cells")))


def sample_counts(c: Cohort) -> DataFrame:
    """Genotype counts of each sample."""
    return c.calls.groupBy("iid").agg(*(count_if(F.col("g") == k).alias(f"n{k}") for k in (0, 1, 2)), count_if(F.col("g").isNull()).alias("n_missing")).withColumn("het_hom", ratio(F.col("n1"), F.col("n0") + F.col("n2")))


def heterozygosity(c: Cohort) -> DataFrame:
    """Observed and expected homozygosity and F = (O - E) / (N - E), over autosomal variants with MAF > 0."""
    freq = _with_samples(c).groupBy("vidx").agg(F.sum(F.col("g").cast("long")).alias("a"), F.count("g").alias("n"))
    p = F.col("a") / (2.0 * F.col("n"))
    auto = c.variants.where("chrom between 1 and 22").select("vidx")
    expect = freq.where((F.col("a") > 0) & (F.col("a") < 2 * F.col("n"))).join(auto, "vidx").select("vidx", (1 - 2 * p * (1 - p) * (2.0 * F.col("n") / (2.0 * F.col("n") - 1))).alias("e"))
    t = _with_samples(c).join(expect, "vidx").groupBy("iid").agg(count_if(F.col("g") != 1).alias("o_hom"), F.sum("e").alias("e_hom"), F.count("g").alias("n"))
    return t.withColumn("f", F.when(F.abs(F.col("n") - F.col("e_hom")) > 1e-9, (F.col("o_hom") - F.col("e_hom")) / (F.col("n") - F.col("e_hom"))))


def _trios(c: Cohort) -> DataFrame:
    """(fid, iid, vidx, child, pa, ma) where the child and at least one parent are called."""
    kids = c.samples.where(F.col("pat").isNotNull() | F.col("mat").isNotNull()).select("iid", "fid", "pat", "mat")
    g = c.called()
    kid = g.withColumnRenamed("g", "child").join(kids, "iid")
    pa = g.select("vidx", F.col("iid").alias("pat"), F.col("g").alias("pa"))
    ma = g.select("vidx", F.col("iid").alias("mat"), F.col("g").alias("ma"))
    return kid.join(pa, ["vidx", "pat"], "left").join(ma, ["vidx", "mat"], "left").where(F.col("pa").isNotNull() | F.col("ma").isNotNull())


def mendel_cells(c: Cohort) -> DataFrame:
    """Each checked cell with whether it is a Mendelian error; one missing parent may have any genotype."""
    gives = lambda x: (F.when(x == 2, 1).otherwise(0), F.when(x == 0, 0).otherwise(1))
    (pl, ph), (ml, mh) = gives(F.col("pa")), gives(F.col("ma"))
    bad = (F.col("child") < pl + ml) | (F.col("child") > ph + mh)
    return _trios(c).select("fid", "iid", "vidx", F.col("pa").alias("g_pat"), F.col("ma").alias("g_mat"), F.col("child").alias("g"), bad.alias("error"))


def mendel(c: Cohort, by: str) -> DataFrame:
    """Errors, checked cells and their ratio by fid, iid or vidx."""
    return mendel_cells(c).groupBy(by).agg(count_if(F.col("error")).alias("n_error"), F.count(F.lit(1)).alias("n_avail")).withColumn("prop", ratio(F.col("n_error"), F.col("n_avail")))


def _fst_parts(c: Cohort) -> DataFrame:
    per = _with_samples(c, "pop").where("pop is not null").groupBy("vidx", "pop").agg(F.count("g").cast("double").alias("n"), F.sum(F.col("g").cast("long")).alias("a"))
    per = per.withColumn("p", F.col("a") / (2 * F.col("n")))
    t = per.groupBy("vidx").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("p")).alias("np"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("npp"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).cast("double").alias("k"), F.sum("a").alias("a"))
    t = t.where("a > 0 and k > 1 and N > k")
    mean = F.col("np") / F.col("N")
    msp = (F.col("npp") - F.col("N") * mean * mean) / (F.col("k") - 1)
    msg = (F.col("np") - F.col("npp")) / (F.col("N") - F.col("k"))
    nc = (F.col("N") - F.col("nn") / F.col("N")) / (F.col("k") - 1)
    return t.select("vidx", F.col("k").cast("long").alias("n_pop"), (msp - msg).alias("num"), (msp + (nc - 1) * msg).alias("den"))


def fst(c: Cohort) -> DataFrame:
    """Weir's theta per variant over populations, with called counts as group sizes."""
    return _fst_parts(c).select("vidx", "n_pop", F.when(F.col("den") != 0, F.col("num") / F.col("den")).alias("fst"))


def fst_by_gene(c: Cohort) -> DataFrame:
    """Theta per gene, numerators and denominators summed over its variants."""
    t = _fst_parts(c).join(c.sets, "vidx").groupBy("gene").agg(F.count(F.lit(1)).alias("n_variant"), F.sum("num").alias("num"), F.sum("den").alias("den"))
    return t.select("gene", "n_variant", F.when(F.col("den") != 0, F.col("num") / F.col("den")).alias("fst"))


def density(c: Cohort, width: int = 10_000_000) -> DataFrame:
    """Variants per bin of ``width`` bases, empty bins inside a chromosome's span included."""
    v = c.variants.where("pos is not null and chrom is not null").withColumn("bin", F.floor(F.col("pos") / F.lit(width)).cast("long"))
    n = v.groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = n.groupBy("chrom").agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select("chrom", F.explode(F.sequence("a", "b")).alias("bin"))
    return bins.join(n, ["chrom", "bin"], "left").select("chrom", "bin", F.coalesce("n", F.lit(0)).alias("n_variant"))


def _snv() -> Column:
    return F.col("major").isin("A", "C", "G", "T") & F.col("minor").isin("A", "C", "G", "T") & (F.col("major") != F.col("minor"))


def tstv(c: Cohort) -> DataFrame:
    """Transitions, transversions and their ratio by chromosome."""
    ts = F.concat("major", "minor").isin("AG", "GA", "CT", "TC")
    t = c.variants.where(_snv() & F.col("chrom").isNotNull()).groupBy("chrom").agg(count_if(ts).alias("n_ts"), count_if(~ts).alias("n_tv"))
    return t.withColumn("tstv", ratio(F.col("n_ts"), F.col("n_tv")))


def rare_lists(c: Cohort) -> DataFrame:
    """Variants that are monomorphic, singletons or doubletons by the minor count of all samples."""
    mac = F.least(F.col("mac_raw"), 2 * F.col("nind") - F.col("mac_raw"))
    kind = F.when(mac == 0, "monomorphic").when(mac == 1, "singleton").when(mac == 2, "doubleton")
    return allele_freq(c).select("vidx", kind.alias("kind")).where("kind is not null")


def unique_to(c: Cohort, by: str) -> DataFrame:
    """Variants whose carriers all belong to one family (fid) or population (pop), with carrier counts."""
    t = _with_samples(c, by).where((F.col("g") > 0) & F.col(by).isNotNull())
    return t.groupBy("vidx").agg(F.min(by).alias(by), F.max(by).alias("top"), F.count(F.lit(1)).alias("n_carrier")).where(F.col(by) == F.col("top")).drop("top")


def variant_summary(c: Cohort) -> DataFrame:
    """Per chromosome and over all (chrom null): positions, kinds of variants, monomorphic, single, double."""
    v = c.variants.join(rare_lists(c), "vidx", "left")
    size = (F.length("minor") - F.length("major")).cast("long")
    ins, dele = F.when(size > 0, size), F.when(size < 0, -size)
    t = v.where("chrom is not null").rollup("chrom").agg(F.count(F.lit(1)).alias("n_variant"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), count_if(_snv()).alias("n_snv"), *(count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("monomorphic", "singleton", "doubleton")), F.count(ins).alias("n_ins"), F.max(ins).alias("max_ins"), F.avg(ins).alias("avg_ins"), F.count(dele).alias("n_del"), F.max(dele).alias("max_del"), F.avg(dele).alias("avg_del"))
    return t


def missing_traits(c: Cohort) -> DataFrame:
    """(trait, iid) of samples with a record of the trait but no value."""
    return c.traits.where("val is null").join(c.samples.select("iid"), "iid", "left_semi").select("trait", "iid")


def missing_sex(c: Cohort) -> DataFrame:
    return c.samples.where("sex is null or sex not in (1, 2)").select("fid", "iid")


def missing_by_status(c: Cohort, trait: str) -> DataFrame:
    """2 x 2 counts of missing calls and case status (values 1 control, 2 case) per variant."""
    y = c.trait(trait)
    t = c.calls.join(y, "iid")
    m, case = F.col("g").isNull(), F.col("val") == 2
    return t.groupBy("vidx").agg(count_if(m & case).alias("case_missing"), count_if(~m & case).alias("case_called"), count_if(m & ~case).alias("control_missing"), count_if(~m & ~case).alias("control_called"))


def top_variants(c: Cohort, k: int = 10) -> DataFrame:
    """The k variants of greatest frequency in each chromosome, ties by vidx, with their rank."""
    w = Window.partitionBy("chrom").orderBy(F.desc("maf"), "vidx")
    return allele_freq(c).join(c.variants.select("vidx", "chrom"), "vidx").where("chrom is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("chrom", "rank", "vidx", "maf")


def inbreeding(c: Cohort, sex_chromosomes: bool = False) -> DataFrame:
    """Observed and expected homozygotes, minor alleles carried, and F per sample over autosomes, or over X of females."""
    freq = _with_samples(c).groupBy("vidx").agg(F.sum(F.col("g").cast("long")).alias("a"), F.count("g").alias("n"))
    p = F.col("a") / (2.0 * F.col("n"))
    where = "chrom = 23" if sex_chromosomes else "chrom between 1 and 22"
    t = freq.where((F.col("a") > 0) & (F.col("a") < 2 * F.col("n"))).join(c.variants.where(where).select("vidx"), "vidx").select("vidx", p.alias("p"), (1 - 2 * p * (1 - p)).alias("e"))
    cells = _with_samples(c, "sex").where("sex = 2" if sex_chromosomes else "true").join(t, "vidx")
    minor = F.when(F.col("p") > 0.5, 2 - F.col("g")).otherwise(F.col("g"))
    m = cells.groupBy("iid").agg(count_if(F.col("g") != 1).alias("obs_hom"), F.sum("e").alias("exp_hom"), F.sum(minor.cast("long")).alias("mac"), F.count("g").alias("n"))
    return m.withColumn("f", F.when(F.abs(F.col("n") - F.col("exp_hom")) > 1e-9, (F.col("obs_hom") - F.col("exp_hom")) / (F.col("n") - F.col("exp_hom"))))


def missing_test(c: Cohort, trait: str) -> DataFrame:
    """Fisher's p of missing calls by case status per variant."""
    return missing_by_status(c, trait).withColumn("p_missing", fisher_exact("case_missing", "case_called", "control_missing", "control_called"))


def marker_check(c: Cohort, reference: DataFrame) -> DataFrame:
    """Variants that a reference (id, chrom, pos, major, minor) doesn't confirm, with the reason: id, position or alleles."""
    r = reference.select("id", F.col("chrom").alias("r_chrom"), F.col("pos").alias("r_pos"), F.array_sort(F.array("major", "minor")).alias("r_alleles")).dropDuplicates(["id"])
    t = c.variants.where("id is not null and id != '.'").join(r, "id", "left")
    place = ~(F.col("chrom").eqNullSafe(F.col("r_chrom")) & F.col("pos").eqNullSafe(F.col("r_pos")))
    why = F.when(F.col("r_alleles").isNull(), "id").when(place, "position").when(~F.array_sort(F.array("major", "minor")).eqNullSafe(F.col("r_alleles")), "alleles")
    return t.select("vidx", "id", why.alias("reason")).where("reason is not null")


def sample_dosages(c: Cohort, bins: int = 20) -> DataFrame:
    """Histogram of dosages, missing ones at the mean, for each sample."""
    freq = c.called().groupBy("vidx").agg(F.avg("g").alias("mean"))
    d = F.coalesce(F.col("g").cast("double"), F.col("mean"))
    t = c.calls.join(freq, "vidx").select("iid", F.least(F.floor(d * bins / 2), F.lit(bins - 1)).cast("int").alias("bin"))
    return t.groupBy("iid", "bin").agg(F.count(F.lit(1)).alias("n"))
