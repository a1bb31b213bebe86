"""Filters of variants, samples and cells. Each rule marks rows with its reason; one pass applies all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedlake.functions.predicates import expression, in_range, info
from pedlake.operators.cohort import Cohort
from pedlake.operators.genes import range_join
from pedlake.operators.qc import allele_freq, hwe, variant_missing


def reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``, the names of the rules that hold for a row; a null rule doesn't hold."""
    marks = F.array(*(F.when(c, F.lit(name)) for name, c in rules.items()))
    return df.withColumn("reasons", F.filter(marks, lambda r: r.isNotNull()))


def keep(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") == 0).drop("reasons")


def variant_rules(chromosomes: list[int] | None = None, snv_only: bool = False, indel_only: bool = False, min_qual: float | None = None, passed: bool = False, expr: str | None = None, name_regex: str | None = None, autosomes: bool = False) -> dict[str, Column]:
    """Rules over the columns of variants. ``expr`` is over INFO entries, and drops where it is true."""
    snv = (F.length("major") == 1) & (F.length("minor") == 1)
    rules = {
        "chromosome": ~F.col("chrom").isin(chromosomes) if chromosomes else None, "autosome": ~F.col("chrom").between(1, 22) if autosomes else None, "snv": ~snv if snv_only else None, "indel": snv if indel_only else None,
        "qual": F.col("qual").isNull() | (F.col("qual") < min_qual) if min_qual is not None else None, "filter": F.coalesce(F.col("filt") != "PASS", F.lit(True)) if passed else None,
        "expression": expression(expr, info) if expr else None, "name": ~F.col("id").rlike(name_regex) if name_regex else None,
    }
    return {k: v for k, v in rules.items() if v is not None}


def filtered_variants(c: Cohort, maf: str | None = None, mac: str | None = None, call_rate: str | None = None, max_hwe: float | None = None, **rules) -> DataFrame:
    """All variants with their reasons: rules of their own columns, and ranges that MAF, MAC or call rate must be in."""
    v = c.variants
    own = variant_rules(**rules)
    if maf or mac:
        v = v.join(allele_freq(c).select("vidx", "maf", "mac"), "vidx", "left")
        own |= {k: ~in_range(F.coalesce(k, F.lit(0)), t) for k, t in (("maf", maf), ("mac", mac)) if t}
    if call_rate:
        v = v.join(variant_missing(c).select("vidx", "call_rate"), "vidx", "left")
        own["call_rate"] = ~in_range(F.coalesce("call_rate", F.lit(0.0)), call_rate)
    if max_hwe is not None:
        v = v.join(hwe(c).select("vidx", "stat_hwe"), "vidx", "left")
        own["hwe"] = F.col("stat_hwe") > max_hwe
    return reasons(v, own)


def select(df: DataFrame, key: str, names: DataFrame, drop: bool = False) -> DataFrame:
    """Rows whose key is (or isn't) in a list of names with the same column."""
    return df.join(names.select(key).distinct(), key, "left_anti" if drop else "left_semi")


def in_regions(variants: DataFrame, regions: DataFrame, drop: bool = False) -> DataFrame:
    """Variants inside (or outside) regions (chrom, start, end)."""
    hit = range_join(variants.where("pos is not null").select("vidx", "chrom", "pos"), regions.select("chrom", "start", "end")).select("vidx").distinct()
    return variants.join(hit, "vidx", "left_anti" if drop else "left_semi")


def near_filtered(variants: DataFrame, filtered: DataFrame, window: int) -> DataFrame:
    """Variants within ``window`` bases of a filtered one."""
    around = filtered.where("pos is not null").select("chrom", (F.col("pos") - window).alias("start"), (F.col("pos") + window).alias("end"))
    return in_regions(variants, around)


def _thin(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    kept, last = [], None
    for pos in pdf.sort_values(["run", "pos", "vidx"])[["run", "pos"]].itertuples(index=False):
        take = last is None or last[0] != pos[0] or pos[1] - last[1] > distance
        kept.append(take)
        if take:
            last = pos
    return pdf.sort_values(["run", "pos", "vidx"])[kept][["vidx"]]


def thin(variants: DataFrame, distance: int) -> DataFrame:
    """Keeps the next variant only if it lies farther than ``distance`` from the last kept one.

    A gap of more than ``distance`` starts a run whose first variant is kept in any case, so runs are
    independent; a task gets whole runs, and a run is as long as the variants are dense.
    """
    w = Window.partitionBy("chrom").orderBy("pos", "vidx")
    v = variants.where("chrom is not null and pos is not null").select("vidx", "chrom", "pos")
    tasks = 4 * int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.coalesce(F.col("pos") - F.lag("pos").over(w) > distance, F.lit(True))
    v = v.withColumn("first", first).withColumn("run", F.concat_ws(":", "chrom", F.sum(F.col("first").cast("int")).over(w)))
    return v.groupBy(F.pmod(F.xxhash64("run"), F.lit(tasks)).alias("task")).applyInPandas(lambda pdf: _thin(pdf, distance), "vidx long")


def sample_rules(sexes: list[int] | None = None, founders: bool | None = None, populations: list[str] | None = None, families: list[str] | None = None) -> dict[str, Column]:
    rules = {"sex": ~F.coalesce(F.col("sex").isin(sexes), F.lit(False)) if sexes else None, "founder": F.col("founder") != founders if founders is not None else None, "population": ~F.coalesce(F.col("pop").isin(populations), F.lit(False)) if populations else None, "family": ~F.coalesce(F.col("fid").isin(families), F.lit(False)) if families else None}
    return {k: v for k, v in rules.items() if v is not None}


def mask(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Calls with the genotypes of the listed samples set to missing."""
    hit = samples.select("iid").distinct().withColumn("hit", F.lit(True))
    return calls.join(hit, "iid", "left").select("vidx", "iid", F.when(F.col("hit").isNull(), F.col("g")).alias("g"))


def recode_alleles(variants: DataFrame, table: str) -> DataFrame:
    """Alleles by a map: ``1234`` letters to digits, ``acgt`` digits to letters, ``flip`` the other strand."""
    a, b = {"1234": ("ACGT", "1234"), "acgt": ("1234", "ACGT"), "flip": ("ACGTacgt", "TGCAtgca")}[table]
    turn = lambda x: F.reverse(F.translate(x, a, b)) if table == "flip" else F.translate(x, a, b)
    return variants.withColumns({x: turn(F.col(x)) for x in ("major", "minor")})


def update(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Values of a column replaced where an update table (key, column) has one."""
    u = values.select(key, F.col(column).alias("new_")).dropDuplicates([key])
    return df.join(u, key, "left").withColumn(column, F.coalesce("new_", column)).drop("new_")


def random_subset(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """About ``share`` of the rows, the same ones whenever the key and seed are the same."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return df.where(u < share)


def standardized(traits: DataFrame) -> DataFrame:
    """Values over the standard deviation of their trait; the mean isn't removed."""
    sd = traits.groupBy("trait").agg(F.stddev_samp("val").alias("sd"))
    return traits.join(sd, "trait").select("iid", "trait", "kind", (F.col("val") / F.nullif("sd", F.lit(0.0))).alias("val"))


def _bound(text: str, names: set[str]) -> Column:
    text = text.strip()
    return F.col(text) if text in names else F.lit(float(text))


def variable_rule(rule: str, names: set[str]) -> Column:
    """Whether a sample is dropped by ``v < x < w`` (or one side): bounds are numbers or other variables; a missing value or bound keeps it."""
    import operator
    import re

    parts = re.split(r"(<=|>=|<|>|==|!=)", rule)
    if len(parts) not in (3, 5):
        raise ValueError(f"not a range: {rule}")
    op = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
    kept = F.lit(True)
    for i in range(0, len(parts) - 2, 2):
        kept = kept & F.coalesce(op[parts[i + 1]](_bound(parts[i], names), _bound(parts[i + 2], names)), F.lit(True))
    return ~kept


def filter_samples(c: Cohort, ranges: list[str] | None = None, status: str | None = None, trait: str | None = None, with_trait: bool = False, **rules) -> DataFrame:
    """Samples with their reasons: ranges over traits, ``status`` case or control of a trait, samples without the trait, and ``sample_rules``."""
    import re

    s, own = c.samples, sample_rules(**rules)
    names = {w.strip() for r in ranges or [] for w in re.split(r"<=|>=|<|>|==|!=", r) if not _number(w)}
    for name in sorted(names):
        s = s.join(c.trait(name).select("iid", F.col("val").alias(name)), "iid", "left")
    own |= {f"range {r}": variable_rule(r, names) for r in ranges or []}
    if trait:
        s = s.join(c.trait(trait).select("iid", F.col("val").alias("trait_")), "iid", "left")
        if status:
            own["status"] = ~F.coalesce(F.col("trait_") == {"case": 2.0, "control": 1.0}[status], F.lit(False))
        if with_trait:
            own["no trait"] = F.col("trait_").isNull()
    return reasons(s, own)


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def error_rules(c: Cohort, trait: str | None = None, mendel_share: str | None = None, missing_p: float | None = None, gdist: str | None = None, info_af: str | None = None) -> DataFrame:
    """Variants with their reasons by Mendelian error share and genetic distance that must be in ranges, by differential missingness of
    cases and controls, and by the frequency in INFO AF, folded at one half."""
    from pedlake.operators.qc import mendel, missing_test

    v, own = c.variants, {}
    if mendel_share:
        v = v.join(mendel(c, "vidx").select("vidx", "prop"), "vidx", "left")
        own["mendel"] = ~in_range(F.coalesce("prop", F.lit(0.0)), mendel_share)
    if missing_p is not None:
        v = v.join(missing_test(c, trait).select("vidx", "p_missing"), "vidx", "left")
        own["missing"] = F.col("p_missing") < missing_p
    if gdist:
        own["gdist"] = ~in_range(F.col("gdist"), gdist)
    if info_af:
        af = F.try_element_at("info", F.lit("AF")).try_cast("double")
        own["info_af"] = ~in_range(F.least(af, 1 - af), info_af)
    return reasons(v, own)


def filter_cells(cells: DataFrame, rule: str, genotype: str = "g") -> DataFrame:
    """Cells with their genotype set to missing where a rule over their own fields (GQ, DP and so on) is true."""
    hit = F.coalesce(expression(rule, lambda n: F.col(n).try_cast("double")), F.lit(False))
    return cells.withColumn(genotype, F.when(~hit, F.col(genotype)))


def random_count(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """The n rows of least hash of (key, seed): the same ones whatever the order of rows."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def random_missing(calls: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Calls with about ``share`` of the genotypes set to missing."""
    u = F.pmod(F.xxhash64("vidx", "iid", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return calls.select("vidx", "iid", F.when(u >= share, F.col("g")).alias("g"))


def random_missing_traits(traits: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Traits with about ``share`` of the values set to missing."""
    u = F.pmod(F.xxhash64("iid", "trait", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return traits.withColumn("val", F.when(u >= share, F.col("val")))
