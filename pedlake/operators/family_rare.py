"""Family-based and permutation rare-variant tests per gene: transmitted scores, variable threshold, pooled kernels, joint regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.functions import special
from pedlake.operators.assoc import CASE
from pedlake.operators.cohort import Cohort
from pedlake.operators.genes import _minor
from pedlake.operators.qc import _trios
from pedlake.plans.scratch import Scratch


def family_scores(c: Cohort, trait: str, weight: bool = True) -> DataFrame:
    """Score g - E(g | parents) of each affected child with both parents called, per gene and child, weighted by Beta(p; 1, 25).

    Summed over the gene's variants; E is the mean of the parents' genotypes.
    """
    sick = c.trait(trait).where(F.col("val") == CASE).select("iid")
    t = _trios(c).where("pa is not null and ma is not null").join(sick, "iid", "left_semi")
    freq = t.groupBy("vidx").agg(((F.sum(F.col("pa") + F.col("ma")) + 1) / (4 * F.count(F.lit(1)) + 1)).alias("p"))
    w = 25 * F.pow(1 - F.col("p"), 24) if weight else F.lit(1.0)
    s = t.join(freq, "vidx").join(c.sets, "vidx").withColumn("u", w * (F.col("child") - (F.col("pa") + F.col("ma")) / 2))
    return s.where("u != 0").select("gene", "iid", "vidx", "u")


def family_burden(c: Cohort, trait: str) -> DataFrame:
    """Family-based burden and kernel statistics per gene, chi-squared scaled by the children's own variances.

    burden: (sum u)^2 / sum over children of (child's sum)^2, one df. kernel: sum over variants of squared
    sums, its null matched by mean and variance under independent signs of the children.
    """

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        gene = pdf["gene"].iloc[0]
        v, vi = np.unique(pdf["vidx"].to_numpy(), return_inverse=True)
        s, si = np.unique(pdf["iid"].to_numpy(), return_inverse=True)
        u = np.zeros((len(s), len(v)))
        np.add.at(u, (si, vi), pdf["u"].to_numpy(float))
        child = u.sum(1)
        var = float((child**2).sum())
        burden = float(child.sum() ** 2 / var) if var > 0 else np.nan
        q = float((u.sum(0) ** 2).sum())
        g = u.T @ u  # squared entries of u u' sum to those of u'u: V x V instead of children x children
        mean, spread = float(np.trace(g)), 2 * float((g**2).sum() - ((u**2).sum(1) ** 2).sum())
        df = 2 * mean * mean / spread if spread > 1e-12 else np.nan
        skat = q * df / mean if df == df else np.nan
        p = lambda x, d: float(special.chi2_sf(x, d)) if x == x else None
        none = lambda x: None if x != x else x
        return pd.DataFrame([(gene, len(v), len(s), none(burden), p(burden, 1), none(skat), none(df), p(skat, df))], columns=["gene", "n_variant", "n_child", "stat_burden", "p_burden", "stat_skat", "df_skat", "p_skat"])

    return family_scores(c, trait).groupBy("gene").applyInPandas(test, "gene string, n_variant int, n_child int, stat_burden double, p_burden double, stat_skat double, df_skat double, p_skat double")


def _block(pdf: pd.DataFrame) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, int]:
    v, vi = np.unique(pdf["vidx"].to_numpy(), return_inverse=True)
    s, si = np.unique(pdf["iid"].to_numpy(), return_inverse=True)
    g, w, maf = np.zeros((len(s), len(v))), np.zeros(len(s)), np.zeros(len(v))
    g[si, vi], w[si], maf[vi] = pdf["m"].to_numpy(float), pdf["w"].to_numpy(float), pdf["maf"].to_numpy(float)
    return pdf["gene"].iloc[0], g, w, maf, int(pdf["n"].iloc[0])


#: Distinct values of a trait that are sent to all tasks; a trait with more must be rounded first.
MOST_VALUES = 1_000_000


def threshold_tests(c: Cohort, trait: str, permutations: int = 500, rare: float = 0.05, seed: int = 1) -> DataFrame:
    """Variable-threshold test with its permutation p-value (x + 1) / (n + 1), burden z and kernel score of pedgene's form, per gene.

    Permuting the trait over all samples and looking at a gene's carriers only is drawing their values without
    replacement from the trait's values. Those are counted, and a task draws places in their order, so
    non-carriers never enter a task.
    """
    scratch = Scratch(c.samples.sparkSession, "threshold")
    y = scratch.cut(c.trait(trait))
    m = y.agg(F.avg("val").alias("mean"), F.stddev_samp("val").alias("sd"), F.count(F.lit(1)).alias("n"))
    counts = scratch.cut(y.groupBy("val").agg(F.count(F.lit(1)).alias("k")))
    if scratch.rows > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values: round the trait")
    values = sorted((r["val"], r["k"]) for r in counts.collect())
    t = rare_carriers(c, rare).join(y.crossJoin(F.broadcast(m)), "iid").where("sd > 0")  # one row
    block = t.select("gene", "vidx", "iid", "m", "maf", ((F.col("val") - F.col("mean")) / F.col("sd")).alias("w"), "n")
    val, upto = np.array([v for v, _ in values], float), np.cumsum([k for _, k in values])
    total = int(upto[-1]) if len(upto) else 0
    spread = float(np.sqrt(np.average((val - np.average(val, weights=np.diff(upto, prepend=0))) ** 2, weights=np.diff(upto, prepend=0)) * total / max(1, total - 1))) if total > 1 else 1.0
    centre = float(np.average(val, weights=np.diff(upto, prepend=0))) if total else 0.0
    scores = c.samples.sparkSession.sparkContext.broadcast(((val - centre) / (spread or 1.0), upto))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        gene, g, w, maf, n = _block(pdf)
        drawn_from, ends = scores.value
        cuts = np.unique(maf)
        sums = np.column_stack([g[:, maf <= x].sum(1) for x in cuts])
        scale = np.sqrt(np.array([(g[:, maf <= x] ** 2).sum() for x in cuts]))
        best = lambda y: np.max(np.abs(y @ sums) / scale, axis=-1)
        stat = float(best(w))
        rng = np.random.default_rng([seed, *gene.encode()])
        draw = lambda: drawn_from[np.searchsorted(ends, rng.choice(total, len(w), replace=False), side="right")]
        more = int((best(np.array([draw() for _ in range(permutations)])) >= stat - 1e-12).sum())
        f = np.sqrt(np.maximum(1e-12, maf * (1 - maf)))
        cov = g.T @ g - np.outer(g.sum(0), g.sum(0)) / n
        var = float((1 / f) @ cov @ (1 / f))
        z = float(w @ g @ (1 / f)) / np.sqrt(var) if var > 0 else None
        kernel = float((((w @ g) / f) ** 2).sum())
        lam = np.linalg.eigvalsh(cov / np.outer(f, f))
        lam = lam[lam > 1e-10 * max(1e-300, lam.max())]
        return pd.DataFrame([(gene, len(maf), stat, (more + 1) / (permutations + 1), z, kernel, float(special.davies_sf(kernel, lam)) if len(lam) else None)], columns=["gene", "n_variant", "stat_vt", "p_vt", "z_burden", "stat_kernel", "p_kernel"])

    return block.groupBy("gene").applyInPandas(test, "gene string, n_variant int, stat_vt double, p_vt double, z_burden double, stat_kernel double, p_kernel double")


def rare_carriers(c: Cohort, rare: float) -> DataFrame:
    """(vidx, iid, m, maf, gene) of cells that carry a rare minor allele."""
    return _minor(c).where((F.col("maf") <= rare) & (F.col("m") > 0)).join(c.sets, "vidx")
