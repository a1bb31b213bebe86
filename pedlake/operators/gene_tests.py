"""Kernel, burden and joint tests of a gene from scores and their covariance.

Every test here needs the score vector u of a gene's variants and its covariance under the null only. Both come
from moments over blocks of samples (``blocks.moments``), so a gene is V x V numbers whatever the cohort. For
unrelated samples u = X'y; for relatives y is replaced by the weights w = inv(Phi) y - k inv(Phi) 1, whose
variance over pedigrees is the number w'Phi w, and the covariance of genotypes does the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.functions import special
from pedlake.operators.assoc import CASE, CONTROL
from pedlake.operators.blocks import moments
from pedlake.operators.cohort import Cohort
from pedlake.operators.genes import _minor
from pedlake.operators.related import kinship_weights
from pedlake.plans.scratch import Scratch

RHO = (0.0, 0.01, 0.04, 0.09, 0.16, 0.25, 0.5, 1.0)
KERNELS = "n_variant int, n_sample int, stat_burden double, p_burden double, stat_skat double, p_skat double, p_skato double, rho double"


def rare_calls(c: Cohort, rare: float, weight: str | DataFrame = "beta", call_rate: float = 0.0) -> DataFrame:
    """(vidx, iid, g, maf, w): minor counts of variants with 0 < MAF <= rare and a call rate of at least ``call_rate``, with their weights:
    ``beta`` the Beta(1, 25) density, ``maf`` 1 / sqrt(2p(1 - p)), ``none``, or a table (vidx, value); variants it lacks have no weight and go."""
    t = _minor(c).where((F.col("maf") > 0) & (F.col("maf") <= rare)).select("vidx", "iid", F.col("m").cast("tinyint").alias("g"), "maf")
    if call_rate > 0:
        from pedlake.operators.qc import variant_missing

        t = t.join(variant_missing(c).where(F.col("call_rate") >= call_rate).select("vidx"), "vidx", "left_semi")
    if not isinstance(weight, str):
        return t.join(weight.select("vidx", F.col("value").cast("double").alias("w")), "vidx")
    p = F.col("maf")
    return t.withColumn("w", {"beta": 25 * F.pow(1 - p, 24), "maf": 1 / F.sqrt(2 * p * (1 - p)), "none": F.lit(1.0)}[weight])


def _positive(cov: np.ndarray) -> np.ndarray:
    val = np.linalg.eigvalsh(cov)
    return val[val > 1e-10 * max(1e-300, val.max(initial=0.0))]


def _liu_quantile(p: float, lam: np.ndarray) -> float:
    """The q with liu_sf(q) = p, by grids that close in."""
    lo, hi = 0.0, float(lam.sum()) + 1.0
    while special.liu_sf(hi, lam) > p:
        hi *= 2
    for _ in range(9):
        x = np.linspace(lo, hi, 33)
        k = int(np.searchsorted(-special.liu_sf_all(x, lam), -p))  # tails fall along the grid
        k = min(max(k, 1), 32)
        lo, hi = float(x[k - 1]), float(x[k])
    return (lo + hi) / 2


def skat_o(u: np.ndarray, cov: np.ndarray, grid: tuple[float, ...] = RHO) -> tuple[float, float]:
    """Integrated p-value of the least p over mixtures of kernel and burden statistics, and the best rho.

    Mixture rho is (1 - rho) sum u^2 + rho (sum u)^2. Given the burden direction, the statistics are a common
    weighted chi-square and one shared chi-square with one degree of freedom, over which is integrated.
    """
    m = len(u)
    one = np.ones(m)
    whole = float(one @ cov @ one)
    if m == 1 or whole <= 0:
        lam = _positive(cov)
        return (float(special.davies_sf(float(u @ u), lam)), 0.0) if len(lam) else (1.0, 0.0)
    grid = tuple(min(r, 0.999) for r in grid)
    ps, lams = [], []
    for rho in grid:
        root = np.linalg.cholesky((1 - rho) * np.eye(m) + rho + 1e-10 * np.eye(m))
        lam = _positive(root.T @ cov @ root)
        q = (1 - rho) * float(u @ u) + rho * float(u.sum()) ** 2
        lams.append(lam)
        ps.append(special.liu_sf(q, lam))
    least = max(min(ps), 1e-15)
    need = np.array([_liu_quantile(least, lam) for lam in lams])
    side = cov @ one
    rest = cov - np.outer(side, side) / whole
    lam = _positive(rest)
    shared = float((side @ side) / whole)  # sum of squared covariances with the burden, over its variance
    tau = np.array([rho * whole + (1 - rho) * shared for rho in grid])
    mean, var = lam.sum(), 2 * float((lam**2).sum())
    zeta = 4 * float(side @ rest @ side) / whole
    scale = np.sqrt(var / (var + zeta)) if var + zeta > 0 else 1.0
    if not len(lam):
        return float(special.chi2_sf(float(u.sum()) ** 2 / whole, 1)), grid[int(np.argmin(ps))]
    z = np.linspace(0, 7, 400)  # the shared part is a squared normal
    h = z[1] - z[0]
    x = z * z
    inner = ((need[:, None] - tau[:, None] * x) / (1 - np.array(grid))[:, None]).min(0)
    tail = np.where(inner <= 0, 1.0, special.liu_sf_all(np.maximum((inner - mean) * scale + mean, 0.0), lam))
    density = 2 * np.exp(-x / 2) / np.sqrt(2 * np.pi)
    f = tail * density
    p = float(h * (f[:-1] + f[1:]).sum() / 2) + 2 * float(special.norm_sf(7.0))
    return float(min(1.0, max(p, least), least * len(grid))), grid[int(np.argmin(ps))]


def kernels(u: np.ndarray, cov: np.ndarray) -> tuple:
    """stat and p of burden and SKAT, p of SKAT-O and its rho."""
    var = float(cov.sum())
    lam = _positive(cov)
    if not len(lam):
        return (None,) * 6
    q, burden = float(u @ u), float(u.sum()) ** 2 / var if var > 1e-12 else None
    return burden, None if burden is None else float(special.chi2_sf(burden, 1)), q, float(special.davies_sf(q, lam)), *skat_o(u, cov)


def skat(c: Cohort, trait: str, rare: float = 0.05, weight: str | DataFrame = "beta", call_rate: float = 0.0) -> DataFrame:
    """Burden, SKAT and SKAT-O of a gene's rare variants with weights as of ``rare_calls``; missing genotypes at the mean."""

    def fit(gene, v, n, xx, xy, yy, mean, rows):
        w = rows["w"].to_numpy(float)
        sigma2 = yy / max(1, n - 1)
        return [(gene, len(v), n, *kernels(xy * w, xx * np.outer(w, w) * sigma2))]

    return moments(rare_calls(c, rare, weight, call_rate), c.sets, c.trait(trait), fit, "gene string, " + KERNELS, ["w"])


def quasi_weights(c: Cohort, values: DataFrame, ped: DataFrame | None = None) -> tuple[DataFrame, float]:
    """(iid, w) with w = inv(Phi) y - k inv(Phi) 1, which sum to 0, and w'Phi w."""
    scratch = Scratch(c.samples.sparkSession, "weights")
    w = scratch.cut(kinship_weights(c, values, ped))
    t = w.agg(F.sum("a").alias("sa"), F.sum("one").alias("s1"), F.sum(F.col("a") * F.col("val")).alias("aa")).first()
    k = (t["sa"] or 0.0) / (t["s1"] or 1.0)
    return w.select("iid", (F.col("a") - k * F.col("one")).alias("w")), (t["aa"] or 0.0) - k * (t["sa"] or 0.0)


def family_kernels(c: Cohort, trait: str, rare: float = 0.05, weight: str | DataFrame = "beta", call_rate: float = 0.0) -> DataFrame:
    """Family-based burden, kernel and optimal tests of a gene's rare variants: weights by pedigree kinship."""
    w, scale = quasi_weights(c, c.trait(trait))

    def fit(gene, v, n, xx, xy, yy, mean, rows):
        b = rows["w"].to_numpy(float)
        return pd.DataFrame([(gene, len(v), n, *kernels(xy * b, xx / max(1, n - 1) * scale * np.outer(b, b)))], columns=["gene", *(x.split()[0] for x in KERNELS.split(", "))])

    return moments(rare_calls(c, rare, weight, call_rate), c.sets, w, fit, "gene string, " + KERNELS, ["w"])


def family_threshold(c: Cohort, trait: str, rare: float = 0.05, draws: int = 20_000) -> DataFrame:
    """Greatest |z| over frequency cuts of family-based sums, with the tail of the correlated normals of all cuts."""
    w, scale = quasi_weights(c, c.trait(trait))

    def fit(gene, v, n, xx, xy, yy, mean, rows):
        maf = rows["maf"].to_numpy(float)
        pick = np.array([maf <= x for x in np.unique(maf)], float)
        cov = pick @ (xx / max(1, n - 1) * scale) @ pick.T
        sd = np.sqrt(np.diag(cov))
        ok = sd > 1e-9
        if not ok.any():
            return [(gene, len(v), None, None)]
        z = np.abs(pick @ xy)[ok] / sd[ok]
        corr = cov[np.ix_(ok, ok)] / np.outer(sd[ok], sd[ok])
        return [(gene, len(v), float(z.max()), special.normal_max_sf(float(z.max()), corr, draws))]

    return moments(rare_calls(c, rare), c.sets, w, fit, "gene string, n_variant int, stat_famvt double, p_famvt double", ["maf"])


def _quadratic(u: np.ndarray, cov: np.ndarray) -> tuple[float, int]:
    val, vec = np.linalg.eigh(cov)
    keep = val > 1e-8 * max(1e-300, val.max(initial=0.0))
    return float((((vec[:, keep].T @ u) ** 2) / val[keep]).sum()), int(keep.sum())


def collapsed_rare(c: Cohort, rare: float) -> DataFrame:
    """(gene, vidx, iid, g): common variants of a gene as they are, and as vidx -1 whether any rare allele is carried."""
    m = _minor(c).join(c.sets, "vidx")
    common = m.where(F.col("maf") > rare).select("gene", "vidx", "iid", F.col("m").cast("tinyint").alias("g"))
    any_rare = m.where((F.col("maf") > 0) & (F.col("maf") <= rare)).groupBy("gene", "iid").agg(F.max((F.col("m") > 0).cast("tinyint")).alias("g"))
    return common.unionByName(any_rare.select("gene", F.lit(-1).cast("long").alias("vidx"), "iid", "g"))


def pedcmc(c: Cohort, trait: str, rare: float = 0.05) -> DataFrame:
    """Combined test of a gene's common variants and its rare indicator, adjusted for relatives: u' inv(cov) u."""
    w, scale = quasi_weights(c, c.trait(trait))

    def fit(gene, v, n, xx, xy, yy, mean):
        stat, df = _quadratic(xy, xx / max(1, n - 1) * scale)
        return pd.DataFrame([(gene, len(v), n, stat, df, float(special.chi2_sf(stat, df)) if df else None)], columns=["gene", "n_column", "n_sample", "stat_pedcmc", "df", "p_pedcmc"])

    return moments(collapsed_rare(c, rare), None, w, fit, "gene string, n_column int, n_sample int, stat_pedcmc double, df int, p_pedcmc double")


def multi_trait_scores(c: Cohort, traits: list[str], sets: DataFrame, max_variants: int = 2000) -> DataFrame:
    """Several traits against the variants of a set at once: v' (inv(Psi) x inv(T' A Phi A' T)) v, traits x variants df.

    Over samples with all traits. sets: (gene, vidx); a set of more than ``max_variants`` raises.
    """
    y = c.trait(traits[0]).select("iid")
    for t in traits[1:]:
        y = y.join(c.trait(t).select("iid"), "iid", "left_semi")
    scratch = Scratch(c.samples.sparkSession, "mfqls")
    y = scratch.cut(y)
    from pedlake.operators.related import pedigrees

    ped, all_w = pedigrees(c), None
    for k, t in enumerate(traits):
        w, _ = quasi_weights(c, c.trait(t).join(y, "iid", "left_semi"), ped)
        w = scratch.cut(w.join(c.trait(t), "iid").select("iid", F.col("w").alias(f"w{k}"), F.col("val").alias(f"v{k}")))
        all_w = w if all_w is None else all_w.join(w, "iid")
    # w_k' Phi w_l = w_k' y_l, as Phi w_k is y_k up to a constant and weights sum to 0
    cross = [[F.sum(F.col(f"w{k}") * F.col(f"v{m}")).alias(f"x{k}_{m}") for m in range(len(traits))] for k in range(len(traits))]
    row = all_w.agg(*(x for r in cross for x in r)).first()
    sigma = np.array([[row[f"x{k}_{m}"] or 0.0 for m in range(len(traits))] for k in range(len(traits))])
    sigma = (sigma + sigma.T) / 2
    inverse, rank_sigma = np.linalg.pinv(sigma, hermitian=True), np.linalg.matrix_rank(sigma, hermitian=True)

    def fit(gene, v, n, xx, xy, yy, mean):
        if len(v) > max_variants:
            raise ValueError(f"more than {max_variants} variants in {gene}")
        u = np.asarray(xy).reshape(len(v), -1)
        psi = xx / max(1, n - 1)
        if len(v) == 1:
            rank, psi = rank_sigma * int(psi[0, 0] != 0), np.array([[1 / psi[0, 0] if psi[0, 0] else 0.0]])
        else:
            rank, psi = np.linalg.matrix_rank(psi, hermitian=True) * rank_sigma, np.linalg.pinv(psi, rcond=1e-8, hermitian=True)
        stat = float(np.trace(inverse @ u.T @ psi @ u))
        return [(gene, len(v), n, stat, int(rank), float(special.chi2_sf(stat, rank)) if rank else None)]

    return moments(c.called(), sets, all_w.select("iid", *(f"w{k}" for k in range(len(traits)))), fit, "gene string, n_variant int, n_sample int, stat_mfqls double, df int, p_mfqls double")


def joint_scores(c: Cohort, trait: str, draws: int = 20_000) -> DataFrame:
    """Joint tests of a gene's variants from single-variant scores: inverse-variance pooled Q1 (1 df), decorrelated Q2,
    and the mixture Q3 that is best, its p from draws under the null.

    Of variants that are copies of another one (correlation 1) the first counts; genes need two variants.
    """

    def fit(gene, v, n, xx, xy, yy, mean):
        cols = ["gene", "n_variant", "stat_q1", "p_q1", "stat_q2", "p_q2", "p_q3"]
        d = np.sqrt(np.diag(xx))
        keep: list[int] = []
        for j in np.nonzero(d > 1e-9)[0]:
            if all(abs(xx[i, j]) < (1 - 1e-9) * d[i] * d[j] for i in keep):
                keep.append(int(j))
        if len(keep) < 2 or yy <= 0:
            return pd.DataFrame([], columns=cols)
        cov, u = xx[np.ix_(keep, keep)] * yy / max(1, n - 1), xy[keep]
        var = float(cov.sum())
        q1 = float(u.sum() ** 2 / var) if var > 1e-12 else None
        p1 = None if q1 is None else float(special.chi2_sf(q1, 1))
        q2, df = _quadratic(u, cov)
        p2 = float(special.chi2_sf(q2, df))
        p3 = p2 if q1 is None else special.best_mixture_p(q1, q2, df, draws)
        return pd.DataFrame([(gene, len(keep), q1, p1, q2, p2, p3)], columns=cols)

    return moments(_minor(c).select("vidx", "iid", F.col("m").cast("tinyint").alias("g")), c.sets, c.trait(trait), fit, "gene string, n_variant int, stat_q1 double, p_q1 double, stat_q2 double, p_q2 double, p_q3 double")


def score_export(c: Cohort, trait: str, rare: float = 0.05) -> DataFrame:
    """For meta-analysis, per gene: its variants, minor counts, scores and the lower triangle of their covariance."""

    def fit(gene, v, n, xx, xy, yy, mean, rows):
        sigma2 = yy / max(1, n - 1)
        return pd.DataFrame([(gene, n, v.tolist(), rows["maf"].tolist(), xy.tolist(), (xx * sigma2)[np.tril_indices(len(v))].tolist())], columns=["gene", "n_sample", "vidx", "maf", "score", "covariance"])

    return moments(rare_calls(c, rare), c.sets, c.trait(trait), fit, "gene string, n_sample int, vidx array<long>, maf array<double>, score array<double>, covariance array<double>", ["maf"])


def pattern_counts(c: Cohort, trait: str, rare: float = 0.05) -> DataFrame:
    """(gene, pattern, n_case, n_control): rare genotype patterns that samples carry in a gene; those without a rare allele have none."""
    y = c.trait(trait).where(F.col("val").isin(CASE, CONTROL)).select("iid", (F.col("val") == CASE).alias("case"))
    cells = rare_calls(c, rare).where("g > 0").join(c.sets, "vidx").join(y, "iid")
    per = cells.groupBy("gene", "iid", "case").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vidx", "g"))), lambda x: F.concat_ws(":", x["vidx"], x["g"])), ",").alias("pattern"))
    return per.groupBy("gene", "pattern").agg(F.count_if("case").alias("n_case"), F.count_if(~F.col("case")).alias("n_control"))


def kbac(c: Cohort, trait: str, rare: float = 0.05, permutations: int = 1000, two_sided: bool = False, seed: int = 1) -> DataFrame:
    """Kernel-based adaptive cluster test: patterns weighted by the hypergeometric probability of their cases, permutation p.

    Permuted labels give each pattern a hypergeometric number of cases, drawn from the counts: no sample is moved.
    """
    y = c.trait(trait).where(F.col("val").isin(CASE, CONTROL))
    t = y.agg(F.count_if(F.col("val") == CASE).alias("a"), F.count_if(F.col("val") == CONTROL).alias("u")).first()
    n1, n0 = t["a"], t["u"]

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        gene, a = pdf["gene"].iloc[0], pdf["n_case"].to_numpy(np.int64)
        k = a + pdf["n_control"].to_numpy(np.int64)
        x = np.arange(k.max() + 1)[:, None]
        log = lambda n, r: special.lgamma(n + 1.0) - special.lgamma(r + 1.0) - special.lgamma(n - r + 1.0)
        with np.errstate(all="ignore"):
            pmf = np.where((x <= k) & (x <= n1) & (k - x <= n0), np.exp(log(n1, np.minimum(x, n1)) + log(n0, np.clip(k - x, 0, n0)) - log(n1 + n0, k)), 0.0)
        weight = np.cumsum(pmf, 0) - pmf / 2  # probability of fewer cases, and half of as many

        def stat(cases: np.ndarray) -> float:
            gain = cases / n1 - (k - cases) / n0
            total = float((gain * weight[cases, np.arange(len(k))]).sum())
            return abs(total) if two_sided else total

        rng = np.random.default_rng([seed, *gene.encode()])
        best, more = stat(a), 0
        rest = n1 + n0 - int(k.sum())
        for _ in range(permutations):
            drawn = rng.multivariate_hypergeometric([*k, rest], n1, method="marginals")[:-1]
            more += stat(drawn) >= best - 1e-12
        return pd.DataFrame([(gene, len(k), int(k.sum()), best, (more + 1) / (permutations + 1))], columns=["gene", "n_pattern", "n_carrier", "stat_kbac", "p_kbac"])

    if not n1 or not n0:
        return pattern_counts(c, trait, rare).limit(0).select("gene", F.lit(0).alias("n_pattern"), F.lit(0).alias("n_carrier"), F.lit(0.0).alias("stat_kbac"), F.lit(0.0).alias("p_kbac"))
    return pattern_counts(c, trait, rare).groupBy("gene").applyInPandas(test, "gene string, n_pattern int, n_carrier int, stat_kbac double, p_kbac double")


def longitudinal(c: Cohort, measures: list[str], rare: float = 0.05) -> DataFrame:
    """Burden, SKAT and SKAT-O of repeated measures of a trait, over samples with all of them: scores of each measure side by side, their
    covariance the Kronecker product of that of the measures and that of the genotypes."""
    y = c.trait(measures[0]).withColumnRenamed("val", "m0")
    for k, name in enumerate(measures[1:], 1):
        y = y.join(c.trait(name).withColumnRenamed("val", f"m{k}"), "iid")

    def fit(gene, v, n, xx, xy, yy, mean, rows):
        w = rows["w"].to_numpy(float)
        u = np.asarray(xy).reshape(len(v), -1) * w[:, None]
        sigma = np.asarray(yy).reshape(u.shape[1], -1) / max(1, n - 1)
        return pd.DataFrame([(gene, len(v), n, *kernels(u.T.ravel(), np.kron(sigma, xx * np.outer(w, w))))], columns=["gene", *(x.split()[0] for x in KERNELS.split(", "))])

    return moments(rare_calls(c, rare), c.sets, y, fit, "gene string, " + KERNELS, ["w"])
