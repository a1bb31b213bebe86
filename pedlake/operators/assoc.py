"""Single-variant association: tables, trends, regression, score tests, transmission, adjustment.

A test is a partial aggregation of calls joined with one value per sample, then closed forms over one
row per variant. p-values are added by Arrow functions over that small table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedlake.functions.stats import chi2_p, fisher_exact, t_p, z_p
from pedlake.operators.cohort import Cohort
from pedlake.operators.qc import _trios, allele_freq
from pedlake.plans.scratch import Scratch

CASE, CONTROL = 2.0, 1.0


def _null0(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def case_counts(c: Cohort, trait: str) -> DataFrame:
    """a0..a2 genotypes of cases and u0..u2 of controls per variant."""
    y = c.trait(trait).where(F.col("val").isin(CASE, CONTROL))
    t = c.called().join(y, "iid")
    return t.groupBy("vidx").agg(*(F.count_if((F.col("val") == v) & (F.col("g") == k)).alias(f"{x}{k}") for x, v in (("a", CASE), ("u", CONTROL)) for k in (0, 1, 2)))


def carrier_tables(c: Cohort, trait: str) -> DataFrame:
    """Carriers (g > 0) against non-carriers in cases and controls."""
    t = case_counts(c, trait)
    return t.select("vidx", (F.col("a1") + F.col("a2")).alias("case_carrier"), F.col("a0").alias("case_other"), (F.col("u1") + F.col("u2")).alias("control_carrier"), F.col("u0").alias("control_other"))


def fisher(c: Cohort, trait: str) -> DataFrame:
    return carrier_tables(c, trait).withColumn("p_fisher", fisher_exact("case_carrier", "case_other", "control_carrier", "control_other"))


def trend(c: Cohort, trait: str) -> DataFrame:
    """Cochran-Armitage, allelic and genotypic chi-squares; null where a margin is empty."""
    a, u = ([F.col(f"{x}{k}").cast("double") for k in (0, 1, 2)] for x in ("a", "u"))
    n1, n0 = sum(a), sum(u)
    n, col = n1 + n0, [x + y for x, y in zip(a, u)]
    mean = (col[1] + 2 * col[2]) / _null0(n)
    ss = sum(x * (F.lit(float(k)) - mean) * (F.lit(float(k)) - mean) for k, x in enumerate(col))
    num = sum(y * (F.lit(float(k)) - mean) for k, y in enumerate(u))
    phi = n0 / _null0(n)
    cat = num * num / _null0(phi * (1 - phi) * ss)
    p1, p0, p = (a[1] + 2 * a[2]) / _null0(2 * n1), (u[1] + 2 * u[2]) / _null0(2 * n0), (col[1] + 2 * col[2]) / _null0(2 * n)
    abt = (p1 - p0) * (p1 - p0) / _null0(p * (1 - p) * (1 / _null0(2 * n1) + 1 / _null0(2 * n0)))
    geno = sum((o - r * m / _null0(n)) * (o - r * m / _null0(n)) / _null0(r * m / _null0(n)) for row, r in ((a, n1), (u, n0)) for o, m in zip(row, col))
    return case_counts(c, trait).select("vidx", cat.alias("stat_trend"), abt.alias("stat_abt"), geno.alias("stat_geno"))


def trend_test(c: Cohort, trait: str) -> DataFrame:
    return trend(c, trait).withColumns({"p_trend": chi2_p("stat_trend", 1), "p_abt": chi2_p("stat_abt", 1), "p_geno2df": chi2_p("stat_geno", 2)})


def linear(c: Cohort, trait: str, weights: bool = False) -> DataFrame:
    """Linear regression of a trait on g per variant: beta, standard error, t. Residual df = n - 2.

    With ``weights`` the samples' weights enter the moments; samples without weight are left out.
    """
    t = c.called().join(c.trait(trait), "iid")
    w = F.lit(1.0)
    if weights:
        t, w = t.join(c.samples.select("iid", "weight").where("weight > 0"), "iid"), F.col("weight")
    x, y = F.col("g").cast("double"), F.col("val")
    m = t.groupBy("vidx").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"))
    c_ = F.col
    sxx, sxy, syy = (c_(f"s{p}{q}") - c_(f"s{p}") * c_(f"s{q}") / c_("w") for p, q in (("x", "x"), ("x", "y"), ("y", "y")))
    ok = (c_("n") > 2) & (sxx > 1e-9)
    beta = F.when(ok, sxy / sxx)
    se = F.when(ok, F.sqrt(F.greatest(syy - beta * sxy, F.lit(0.0)) / (c_("n") - 2) / sxx))
    return m.select("vidx", "n", beta.alias("beta"), se.alias("se"), (beta / F.nullif(se, F.lit(0.0))).alias("stat"))


def linear_test(c: Cohort, trait: str) -> DataFrame:
    return linear(c, trait).withColumn("p_regr", t_p("stat", F.col("n").cast("double") - 2))


def qls(c: Cohort, trait: str) -> DataFrame:
    """Quasi-likelihood score of unrelated samples (Phi = I): centred trait against genotype."""
    y = c.trait(trait)
    mean = y.agg(F.avg("val").alias("m"))
    t = c.called().join(y.crossJoin(F.broadcast(mean)), "iid").withColumn("w", F.col("val") - F.col("m"))  # one row
    m = t.groupBy("vidx").agg(F.count(F.lit(1)).alias("n"), F.avg("g").alias("gm"), F.sum(F.col("w") * F.col("g")).alias("wg"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    p = F.col("gm") / 2
    var = 2 * p * (1 - p) * (F.col("ww") - F.col("sw") * F.col("sw") / F.col("n"))
    return m.select("vidx", "n", ((F.col("wg") - F.col("sw") * F.col("gm")) / F.sqrt(F.when(var > 1e-12, var))).alias("stat"))


def qls_test(c: Cohort, trait: str) -> DataFrame:
    return qls(c, trait).withColumn("p_qls", z_p("stat"))


def tdt(c: Cohort, trait: str) -> DataFrame:
    """Transmissions from heterozygous parents to affected children, and their chi-square (b - c)^2 / (b + c).

    Only trios with both parents called. Of two heterozygous parents, a child's g minor alleles were
    transmitted out of two.
    """
    sick = c.trait(trait).where(F.col("val") == CASE).select("iid")
    t = _trios(c).where("pa is not null and ma is not null").join(sick, "iid", "left_semi")
    het = (F.col("pa") == 1).cast("int") + (F.col("ma") == 1).cast("int")
    fixed = F.when(F.col("pa") == 2, 1).otherwise(0) + F.when(F.col("ma") == 2, 1).otherwise(0)
    got = F.col("child") - fixed
    ok = (het > 0) & (got >= 0) & (got <= het)
    m = t.where(ok).groupBy("vidx").agg(F.sum(got).alias("n_transmitted"), F.sum(het - got).alias("n_not"))
    b, k = F.col("n_transmitted").cast("double"), F.col("n_not").cast("double")
    return m.withColumn("stat_tdt", (b - k) * (b - k) / _null0(b + k))


def tdt_test(c: Cohort, trait: str) -> DataFrame:
    return tdt(c, trait).withColumn("p_tdt", chi2_p("stat_tdt", 1))


RANGES = 256


def adjust(df: DataFrame, p: str = "p") -> DataFrame:
    """Bonferroni, Holm, Sidak (single step and step down), Benjamini-Hochberg and -Yekutieli.

    Null p-values are left out; equal ones are ranked by the other columns. Ranks and running extremes are
    taken inside ranges of p and carried from range to range by a table of at most RANGES rows, so no
    task orders all tests.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "adjust")
    t = scratch.cut(df.where(F.col(p).isNotNull()))
    m = scratch.rows
    names = ["bonferroni", "holm", "sidak_ss", "sidak_sd", "bh", "by"]
    if not m:
        return t.select("*", F.lit(0).cast("long").alias("rank"), *(F.lit(0.0).alias(x) for x in names))
    splits = sorted(set(t.approxQuantile(p, [i / RANGES for i in range(1, RANGES)], 0.001)))
    bucket = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s < F.col(p)))
    t = scratch.cut(t.withColumn("range_", bucket))
    count = {r["range_"]: r["n"] for r in t.groupBy("range_").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, run = [], 0
    for k in sorted(count):
        offset.append((k, run))
        run += count[k]
    inside = Window.partitionBy("range_")
    start = F.broadcast(spark.createDataFrame(offset, "range_ int, offset_ long"))
    order = inside.orderBy(p, *[c for c in df.columns if c != p])
    q, i = F.col(p), F.col("rank")
    t = t.join(start, "range_").withColumn("rank", F.col("offset_") + F.row_number().over(order)).drop("offset_")
    t = scratch.cut(t.withColumns({"h_": (m - i + 1) * q, "s_": 1 - F.pow(1 - q, F.lit(float(m)) - i + 1), "b_": float(m) * q / i}))
    ends = {r["range_"]: r for r in t.groupBy("range_").agg(F.max("h_").alias("h"), F.max("s_").alias("s"), F.min("b_").alias("b")).collect()}
    keys = sorted(ends)
    carry = [(k, max((ends[j]["h"] for j in keys if j < k), default=0.0), max((ends[j]["s"] for j in keys if j < k), default=0.0), min((ends[j]["b"] for j in keys if j > k), default=1.0)) for k in keys]
    t = t.join(F.broadcast(spark.createDataFrame(carry, "range_ int, ch double, cs double, cb double")), "range_")
    fore = inside.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    back = inside.orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    harmonic = sum(1 / j for j in range(1, m + 1)) if m < 10_000_000 else math.log(m) + 0.5772156649015329 + 1 / (2 * m)
    one = lambda c: F.least(c, F.lit(1.0))
    low = F.least(F.min("b_").over(back), F.col("cb"))
    return t.select(
        *df.columns, "rank", one(q * m).alias("bonferroni"), one(F.greatest(F.max("h_").over(fore), F.col("ch"))).alias("holm"), (1 - F.pow(1 - q, F.lit(float(m)))).alias("sidak_ss"),
        F.greatest(F.max("s_").over(fore), F.col("cs")).alias("sidak_sd"), one(low).alias("bh"), one(low * harmonic).alias("by"),
    )


def genomic_control(df: DataFrame, stat: str) -> DataFrame:
    """lambda = median of the statistics / 0.456, at least 1, and the number of statistics."""
    return df.where(F.col(stat).isNotNull()).agg(F.greatest(F.percentile(stat, 0.5) / 0.456, F.lit(1.0)).alias("lambda"), F.count(F.lit(1)).alias("n"))  # counts of distinct values are combined map-side


def epistasis_z(m: DataFrame) -> DataFrame:
    """Pair tables of cases and controls to allele tables and z, the difference of their log odds ratios."""
    alleles = {"11": lambda i, j: i * j, "10": lambda i, j: i * (2 - j), "01": lambda i, j: (2 - i) * j, "00": lambda i, j: (2 - i) * (2 - j)}
    d = {f"{s}_{k}": sum(F.col(f"{s}{i}{j}") * f(i, j) for i in range(3) for j in range(3) if f(i, j)) for s in "au" for k, f in alleles.items()}
    t = m.select("gene", "vidx1", "vidx2", *(x.alias(k) for k, x in d.items()))
    d = {k: F.col(k).cast("double") for k in d}
    lor = {s: F.log(d[f"{s}_11"] * d[f"{s}_00"] / (d[f"{s}_10"] * d[f"{s}_01"])) for s in "au"}
    return t.withColumn("z", F.when(F.least(*d.values()) > 0, F.abs(lor["a"] - lor["u"]) / F.sqrt(sum(1 / x for x in d.values()))))


def quick_epistasis(c: Cohort, trait: str) -> DataFrame:
    """Pairs of variants within a gene: difference of log odds ratios of allele tables in cases and controls."""
    from pedlake.operators.blocks import pair_tables

    return epistasis_z(pair_tables(c, trait))


def quick_epistasis_queries(c: Cohort, trait: str, queries: DataFrame, block: int = 512) -> DataFrame:
    """Each query variant against all other variants, whatever their genes: in one group if samples are called at ``block`` variants or
    fewer on average, as then only pairs called together are counted, else in blocks of about ``block`` variants."""
    from pedlake.operators.blocks import pair_tables

    called = Scratch(c.calls.sparkSession, "called").cut(c.called())
    c = Cohort(c.samples, called, c.traits, c.variants, c.sets)
    t = called.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("iid").alias("samples")).first()
    n = 1 if t["cells"] <= block * t["samples"] else max(1, -(-c.variants.count() // block))
    ids = c.variants.select("vidx", F.pmod(F.xxhash64("vidx"), F.lit(n)).cast("string").alias("gene"))
    asked = queries.select("vidx").distinct().join(ids.select("gene").distinct())  # the queries stand in each block once
    return epistasis_z(pair_tables(c, trait, ids.select("gene", "vidx").unionByName(asked.select("gene", "vidx")).distinct(), queries)).drop("gene").distinct()


def epistasis_summary(pairs: DataFrame, p: float = 0.0001) -> DataFrame:
    """Per variant: pairs tested, pairs below p, their share, and the best partner with its z."""
    both = pairs.select(F.col("vidx1").alias("vidx"), F.col("vidx2").alias("other"), "z").unionByName(pairs.select(F.col("vidx2").alias("vidx"), F.col("vidx1").alias("other"), "z")).where("z is not null").distinct()
    best = both.groupBy("vidx").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("z") > z_above(p)).alias("n_sig"), F.max_by("other", F.struct("z", -F.col("other"))).alias("best"), F.max("z").alias("best_z"))
    return best.select("vidx", "n_sig", "n_total", (F.col("n_sig") / F.col("n_total")).alias("prop"), "best", "best_z")


def z_above(p: float) -> float:
    """The z above which a two-sided normal p-value is below p."""
    from pedlake.functions.special import norm_quantile

    return float(-norm_quantile(p / 2))


def mdr(c: Cohort, trait: str, top: int = 20) -> DataFrame:
    """Two-way multifactor dimensionality reduction within genes: a cell of two genotypes is high-risk if it has
    more cases than controls; the score is the share classified right. The ``top`` pairs by score."""
    from pedlake.operators.blocks import CELLS, pair_tables

    m = pair_tables(c, trait)
    a, u = ({(i, j): F.col(f"{s}{i}{j}") for i, j in CELLS} for s in "au")
    score = m.select("gene", "vidx1", "vidx2", sum(a[k] + u[k] for k in CELLS).alias("n"), sum(F.greatest(a[k], u[k]) for k in CELLS).alias("n_right"))
    out = score.withColumn("score", F.col("n_right") / F.col("n"))
    return out.orderBy(F.desc("score"), F.desc("n"), "gene", "vidx1", "vidx2").limit(top)


def blue_freq(c: Cohort) -> DataFrame:
    """Frequency with the samples' weights: sum(w g) / sum(w) / 2."""
    t = c.called().join(c.samples.select("iid", "weight").where("weight is not null"), "iid")
    return t.groupBy("vidx").agg((F.sum(F.col("weight") * F.col("g")) / F.sum("weight") / 2).alias("p_weighted"), F.count(F.lit(1)).alias("n"))


def model_counts(c: Cohort) -> DataFrame:
    """Mean genotype code under the additive, dominant, recessive and multiplicative models."""
    g = F.col("g")
    return c.called().groupBy("vidx").agg(F.avg(g).alias("additive"), F.avg((g > 0).cast("int")).alias("dominant"), F.avg((g == 2).cast("int")).alias("recessive"), F.avg((g * g).cast("double")).alias("multiplicative"))


def weighted_mean_freq(c: Cohort) -> DataFrame:
    """Beta(p; 1, 25) density weights of variants, from the frequencies of all samples."""
    return allele_freq(c).select("vidx", "maf", (25 * F.pow(1 - F.col("maf"), 24)).alias("weight"))


def sdt(c: Cohort, trait: str) -> DataFrame:
    """Sibship disequilibrium test: sibships whose affected sibs carry more, or fewer, minor alleles on average than the unaffected."""
    y = c.trait(trait).where(F.col("val").isin(CASE, CONTROL)).select("iid", (F.col("val") == CASE).alias("case"))
    kids = c.samples.where("pat is not null and mat is not null").select("iid", "pat", "mat").join(y, "iid")
    per = c.called().join(kids, "iid").groupBy("vidx", "pat", "mat").agg(F.avg(F.when(F.col("case"), F.col("g"))).alias("a"), F.avg(F.when(~F.col("case"), F.col("g"))).alias("u")).where("a is not null and u is not null")
    m = per.groupBy("vidx").agg(F.count_if(F.col("a") > F.col("u")).alias("n_more"), F.count_if(F.col("a") < F.col("u")).alias("n_less"), F.count(F.lit(1)).alias("n_sibship"))
    b, k = F.col("n_more").cast("double"), F.col("n_less").cast("double")
    return m.withColumn("stat_sdt", (b - k) * (b - k) / _null0(b + k))


def corrected(df: DataFrame, stat: str, inflation: float | None = None) -> DataFrame:
    """Statistics divided by the genomic control factor, that of the data or a given one, with their p-values."""
    lam = genomic_control(df, stat) if inflation is None else df.sparkSession.createDataFrame([(float(inflation), 0)], "lambda double, n long")
    t = df.crossJoin(F.broadcast(lam.select("lambda")))  # one row
    return t.withColumn(f"{stat}_gc", F.col(stat) / F.col("lambda")).withColumn("p_gc", chi2_p(f"{stat}_gc", 1)).drop("lambda")


def reported(df: DataFrame, p: str, wanted: str = "[0,1]", drop_null: bool = False) -> DataFrame:
    """Rows whose p is in a range such as (0,0.05]; those without p stay unless ``drop_null``."""
    from pedlake.functions.predicates import in_range

    ok = in_range(F.col(p), wanted)
    return df.where(ok if drop_null else ok | F.col(p).isNull())


def pair_regression(c: Cohort, trait: str) -> DataFrame:
    """y ~ 1 + g1 + g2 + g1 g2 for pairs of variants within a gene: the interaction's beta, t and p, from sums over 9 genotype cells.

    A pair whose cells can't tell the interaction has null values.
    """
    import numpy as np
    import pandas as pd

    from pedlake.functions import special
    from pedlake.operators.blocks import CELLS, _dense, buckets

    g = buckets(c.called().join(c.sets, "vidx").join(c.trait(trait), "iid"), c.samples.count()).select("gene", "bucket", "vidx", "iid", "g", "val")
    names = [f"{s}{i}{j}" for s in "nyq" for i, j in CELLS]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        v, first, x = _dense(pdf)
        y = pdf["val"].to_numpy(float)[first]
        one, two = np.triu_indices(len(v), 1)
        hit = [(x == k).astype(float) for k in range(3)]
        out = {"gene": pdf["gene"].iloc[0], "vidx1": v[one], "vidx2": v[two]}
        for i, j in CELLS:
            for s, w in (("n", np.ones(len(y))), ("y", y), ("q", y * y)):
                out[f"{s}{i}{j}"] = (hit[i].T @ (hit[j] * w[:, None]))[one, two]
        return pd.DataFrame(out)

    part = g.groupBy("gene", "bucket").applyInPandas(count, "gene string, vidx1 long, vidx2 long, " + ", ".join(f"{n} double" for n in names))
    sums = part.groupBy("gene", "vidx1", "vidx2").agg(*(F.sum(n).alias(n) for n in names))
    design = np.array([(1.0, i, j, i * j) for i, j in CELLS])

    def solve(it):
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                n, y, q = (np.array(row[3 + 9 * k : 12 + 9 * k], float) for k in range(3))
                m, total = design.T @ (n[:, None] * design), n.sum()
                if total <= 4 or np.linalg.matrix_rank(design[n > 0]) < 4:
                    if total:
                        out.append((*row[:3], int(total), None, None, None))
                    continue
                inv = np.linalg.inv(m)
                b = inv @ (design.T @ y)
                se = np.sqrt(max(0.0, q.sum() - b @ (design.T @ y)) / (total - 4) * inv[3, 3])
                t = b[3] / se if se > 1e-12 else None
                out.append((*row[:3], int(total), float(b[3]), t, None if t is None else float(special.t_sf2(t, total - 4))))
            yield pd.DataFrame(out, columns=["gene", "vidx1", "vidx2", "n", "beta", "stat", "p"])

    return sums.mapInPandas(solve, "gene string, vidx1 long, vidx2 long, n long, beta double, stat double, p double")
