"""Linkage with a trait: LOD scores under penetrance models, homogeneity of pedigrees, and allele sharing of affected sibs.

The likelihood of a pedigree at a marker is a sum over haplotypes: each person has a paternal and a maternal one, of four kinds
(trait allele x marker allele). Founders draw them from the frequencies, a child's is one of its parent's two or a
recombinant, and phenotype and genotype bind a person's pair. The variables are eliminated one by one, least product first, for all
markers and recombination fractions of a pedigree at once, so pedigrees with loops are handled as well. A task
gets whole pedigrees; what is added up are log likelihoods per (pedigree, marker, theta).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.functions.stats import chi2_p, z_p
from pedlake.operators.assoc import CASE, CONTROL
from pedlake.operators.cohort import Cohort
from pedlake.operators.related import _task, pedigrees
from pedlake.plans.scratch import Scratch

THETAS = (0.0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4)
#: Variables that may meet in one factor; a pedigree so tangled that more would raises.
WIDEST = 9


def _transmission(theta: np.ndarray) -> np.ndarray:
    """P(child's haplotype | parent's paternal, maternal), over haplotypes 2 * trait allele + marker allele, for each theta."""
    out = np.zeros((len(theta), 4, 4, 4))
    for p in range(4):
        for m in range(4):
            for side, (a, b) in enumerate(((p, m), (m, p))):
                out[:, p, m, a] += (1 - theta) / 2  # trait and marker from the same haplotype
                out[:, p, m, (a & 2) | (b & 1)] += theta / 2
    return out


def log_likelihoods(members: list[tuple[str, str | None, str | None]], penetrance: np.ndarray, genotypes: np.ndarray, freq: np.ndarray, disease: float, thetas: np.ndarray) -> np.ndarray:
    """Natural log likelihoods, markers x thetas, of one pedigree whose parents all are members.

    penetrance: members x 3, P(phenotype | disease alleles); genotypes: members x markers, -1 unknown; freq: marker allele
    frequencies; disease: frequency of the disease allele.
    """
    m, t, n = len(freq), len(thetas), len(members)
    at = {k: i for i, (k, _, _) in enumerate(members)}
    trans = _transmission(thetas)[None]  # markers x thetas x 4 x 4 x 4
    hap = np.array([(disease if h & 2 else 1 - disease) * np.where(h & 1, freq, 1 - freq) for h in range(4)]).T[:, None, :]  # markers x 1 x 4
    factors: list[tuple[tuple[int, ...], np.ndarray]] = []
    d, g = np.array([[(a >> 1) + (b >> 1) for b in range(4)] for a in range(4)]), np.array([[(a & 1) + (b & 1) for b in range(4)] for a in range(4)])
    for i, (_, pat, mat) in enumerate(members):
        seen = (genotypes[i][:, None, None] < 0) | (genotypes[i][:, None, None] == g)
        factors.append(((2 * i, 2 * i + 1), (penetrance[i][d][None] * seen)[:, None]))
        for v, parent in ((2 * i, pat), (2 * i + 1, mat)):
            factors.append(((v,), hap) if parent is None else ((2 * at[parent], 2 * at[parent] + 1, v), trans))
    total = np.zeros((m, t))
    left = set(range(2 * n))
    while left:
        best = None
        for v in left:
            touch = set().union(*(vs for vs, _ in factors if v in vs)) or {v}
            if best is None or len(touch) < len(best[1]):
                best = (v, touch)
        v, touch = best
        if len(touch) > WIDEST:
            raise ValueError("too many loops in a pedigree")
        names = {x: chr(99 + k) for k, x in enumerate(sorted(touch))}
        use = [(vs, f) for vs, f in factors if v in vs]
        product = use[0][1]
        parts = [np.broadcast_to(f, np.broadcast_shapes(f.shape[:2], (m, t)) + f.shape[2:]) for _, f in use]
        keep = tuple(sorted(touch - {v}))
        product = np.einsum(",".join("ab" + "".join(names[x] for x in vs) for vs, _ in use) + "->ab" + "".join(names[x] for x in keep), *parts, optimize="greedy" if len(use) > 2 else False)
        size = product.reshape(m, t, -1).max(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.log(size)
            product = product / np.where(size > 0, size, 1.0).reshape(m, t, *[1] * len(keep))
        factors = [(vs, f) for vs, f in factors if v not in vs]
        if keep:
            factors.append((keep, product))
        left.discard(v)
    return total


def pedigree_lods(c: Cohort, trait: str, penetrances: tuple[float, float, float] = (0.05, 0.5, 0.9), disease: float = 0.05, thetas: tuple[float, ...] = THETAS, types: DataFrame | None = None) -> DataFrame:
    """(pedigree, vidx, theta, lod): base-10 log likelihood at theta against no linkage, for each pedigree and marker called in it.

    Affected persons have the penetrance of their number of disease alleles, unaffected one minus it, others 1; ``types`` (iid, p_aa, p_ab,
    p_bb) gives persons their own. Markers impossible in a pedigree (Mendelian errors) are left out of it.
    """
    y = c.trait(trait).where(F.col("val").isin(CASE, CONTROL)).select("iid", "val")
    own = ["p_aa", "p_ab", "p_bb"]
    rows = pedigrees(c).join(y, "iid", "left")
    rows = rows.join(types.select("iid", *own), "iid", "left") if types is not None else rows.withColumns({k: F.lit(None).cast("double") for k in own})
    freq = c.called().groupBy("vidx").agg((F.avg("g") / 2).alias("q")).where("q > 0 and q < 1")
    packed = c.called().join(freq, "vidx").groupBy("iid").agg(F.collect_list("vidx").alias("v"), F.collect_list("g").alias("g"), F.collect_list("q").alias("q"))
    grid = np.array([*thetas, 0.5])
    pen = np.array(penetrances)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, p in pdf.groupby("pedigree", sort=False):
            text = lambda v: v if isinstance(v, str) else None
            members = {i: (text(a), text(b)) for i, a, b in p[["iid", "pat", "mat"]].itertuples(index=False)}
            for a, b in list(members.values()):
                for x in (a, b):
                    if x is not None:
                        members.setdefault(x, (None, None))
            called = [(i, v, g, q) for i, v, g, q in p[["iid", "v", "g", "q"]].itertuples(index=False) if v is not None]
            if len(members) < 3 or not called:
                continue
            ids = np.unique(np.concatenate([v for _, v, *_ in called]))
            at = {k: n for n, k in enumerate(members)}
            geno, q = np.full((len(members), len(ids)), -1), np.zeros(len(ids))
            for i, v, g, f in called:
                k = np.searchsorted(ids, v)
                geno[at[i], k], q[k] = g, f
            use = (geno >= 0).sum(0) > 1  # one call tells nothing of linkage
            if not use.any():
                continue
            w = np.ones((len(members), 3))
            for i, val, *mine in p[["iid", "val", *own]].itertuples(index=False):
                if not any(x is None or x != x for x in mine):
                    w[at[i]] = mine
                elif val == CASE:
                    w[at[i]] = pen
                elif val == CONTROL:
                    w[at[i]] = 1 - pen
            ll = log_likelihoods([(k, *v) for k, v in members.items()], w, geno[:, use], q[use], disease, grid)
            ok = np.isfinite(ll[:, -1])
            lod = np.where(np.isfinite(ll[ok, :-1]), (ll[ok, :-1] - ll[ok, -1:]) / np.log(10), -np.inf)
            k = int(ok.sum())
            out.append(pd.DataFrame({"pedigree": name, "vidx": np.repeat(ids[use][ok], len(thetas)), "theta": np.tile(thetas, k), "lod": lod.ravel()}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["pedigree", "vidx", "theta", "lod"])

    return rows.join(packed, "iid", "left").groupBy(_task(c)).applyInPandas(score, "pedigree string, vidx long, theta double, lod double")


def lod_scores(lods: DataFrame) -> DataFrame:
    """(vidx, theta, n_pedigree, lod), summed over pedigrees."""
    return lods.groupBy("vidx", "theta").agg(F.count(F.lit(1)).alias("n_pedigree"), F.sum("lod").alias("lod"))


def linkage_test(lods: DataFrame) -> DataFrame:
    """Per marker the best theta of the grid, its LOD, and the one-sided likelihood-ratio p."""
    best = lod_scores(lods).groupBy("vidx").agg(F.max_by(F.struct("theta", "n_pedigree"), F.struct("lod", -F.col("theta"))).alias("b"), F.max("lod").alias("lod"))
    stat = 2 * F.ln(F.lit(10.0)) * F.greatest("lod", F.lit(0.0))
    t = best.select("vidx", F.col("b.theta").alias("theta"), F.col("b.n_pedigree").alias("n_pedigree"), "lod", stat.alias("stat"))
    return t.withColumn("p", F.when(F.col("stat") > 0, chi2_p("stat", 1) / 2).otherwise(0.5))


def homogeneity(lods: DataFrame, steps: int = 20) -> DataFrame:
    """Do all pedigrees have one theta? Morton: each pedigree's own best theta against the common one, chi-square with pedigrees - 1 df.
    Smith: a share alpha of linked pedigrees against all, over a grid of alpha and theta, 1 df one-sided."""
    ln10 = float(np.log(10))
    own = lods.groupBy("vidx", "pedigree").agg(F.max("lod").alias("best")).groupBy("vidx").agg(F.sum(F.greatest("best", F.lit(0.0))).alias("own"), F.count(F.lit(1)).alias("n_pedigree"))
    alphas = [i / steps for i in range(steps + 1)]
    mixed = lods.groupBy("vidx", "theta").agg(F.sum("lod").alias("lod"), *(F.sum(F.log10(a * F.pow(F.lit(10.0), "lod") + (1 - a))).alias(f"a{i}") for i, a in enumerate(alphas[:-1])))
    cells = F.array(*(F.struct(F.col(f"a{i}").alias("s"), F.lit(a).alias("alpha"), F.col("theta")) for i, a in enumerate(alphas[:-1])), F.struct(F.col("lod").alias("s"), F.lit(1.0).alias("alpha"), F.col("theta")))
    best = mixed.groupBy("vidx").agg(F.greatest(F.max("lod"), F.lit(0.0)).alias("common"), F.max(F.array_max(cells)).alias("m"))
    t = best.join(own, "vidx")
    t = t.select("vidx", "n_pedigree", (2 * ln10 * (F.col("own") - F.col("common"))).alias("stat_morton"), F.col("m.alpha").alias("alpha"), F.col("m.theta").alias("theta"), (2 * ln10 * F.greatest(F.col("m.s") - F.col("common"), F.lit(0.0))).alias("stat_smith"))
    t = t.withColumn("p_morton", F.when(F.col("n_pedigree") > 1, chi2_p("stat_morton", (F.col("n_pedigree") - 1).cast("double"))))
    return t.withColumn("p_smith", F.when(F.col("stat_smith") > 0, chi2_p("stat_smith", 1) / 2).otherwise(0.5))


def _sharing(g1: np.ndarray, g2: np.ndarray, gp: np.ndarray, gm: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected number of alleles shared by descent of two sibs, and whether the data tell of it, from genotypes (-1 unknown) and q."""
    like = np.zeros((3, len(q)))
    fit = lambda g, k: (g < 0) | (g == k)
    for code in range(16):
        a, b, c, d = (code >> 3) & 1, (code >> 2) & 1, (code >> 1) & 1, code & 1
        prior = np.ones(len(q))
        for x in (a, b, c, d):
            prior = prior * (q if x else 1 - q)
        prior = prior * fit(gp, a + b) * fit(gm, c + d)
        for s in range(16):
            p1, m1, p2, m2 = (s >> 3) & 1, (s >> 2) & 1, (s >> 1) & 1, s & 1
            one, two = (b if p1 else a) + (d if m1 else c), (b if p2 else a) + (d if m2 else c)
            like[(p1 == p2) + (m1 == m2)] += prior * fit(g1, one) * fit(g2, two) / 16
    total = like.sum(0)
    ok = total > 0
    share = np.where(ok, (like[1] + 2 * like[2]) / np.where(ok, total, 1), np.nan)
    return share, ok


def sharing_linkage(c: Cohort, trait: str, steps: int = 40) -> DataFrame:
    """Non-parametric linkage of affected sib pairs at single markers: Z per sibship from allele sharing, overall Z, and the linear
    allele-sharing model of Kong and Cox: delta, LOD and p.

    Pairs are formed inside sibships of recorded couples; parents' genotypes are used where called.
    """
    sick = c.trait(trait).where(F.col("val") == CASE).select("iid")
    kids = c.samples.where("pat is not null and mat is not null").select("iid", "pat", "mat").join(sick, "iid", "left_semi")
    g = c.called()
    k = g.join(kids, "iid")
    other = k.select("vidx", "pat", "mat", F.col("iid").alias("iid2"), F.col("g").alias("g2"))
    freq = g.groupBy("vidx").agg((F.avg("g") / 2).alias("q")).where("q > 0 and q < 1")
    t = k.join(other, ["vidx", "pat", "mat"]).where("iid < iid2").join(freq, "vidx")
    t = t.join(g.select("vidx", F.col("iid").alias("pat"), F.col("g").alias("gp")), ["vidx", "pat"], "left").join(g.select("vidx", F.col("iid").alias("mat"), F.col("g").alias("gm")), ["vidx", "mat"], "left")

    def expect(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            share, ok = _sharing(pdf["g"].to_numpy(int), pdf["g2"].to_numpy(int), pdf["gp"].fillna(-1).to_numpy(int), pdf["gm"].fillna(-1).to_numpy(int), pdf["q"].to_numpy(float))
            yield pdf[["vidx", "pat", "mat"]].assign(share=share)[ok]

    pairs = t.select("vidx", "pat", "mat", "g", "g2", "gp", "gm", "q").mapInPandas(expect, "vidx long, pat string, mat string, share double")
    # sharing has variance one half under no linkage, and pairs of a sibship are uncorrelated
    z = Scratch(c.samples.sparkSession, "sharing").cut(pairs.groupBy("vidx", "pat", "mat").agg((F.sum(F.col("share") - 1) / F.sqrt(F.count(F.lit(1)) / 2.0)).alias("z")).where("abs(z) > 1e-9"))
    ends = z.groupBy("vidx").agg(F.count(F.lit(1)).alias("n_sibship"), (F.sum("z") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("z_all"), F.max("z").alias("hi"), F.min("z").alias("lo"))
    grid = z.join(ends, "vidx").withColumn("d", F.explode(F.transform(F.sequence(F.lit(-steps + 1), F.lit(steps - 1)), lambda i: F.when(i >= 0, i / steps * F.when(F.col("lo") < 0, -1 / F.col("lo")).otherwise(1.0)).otherwise(i / steps * F.when(F.col("hi") > 0, 1 / F.col("hi")).otherwise(1.0)))))
    best = grid.groupBy("vidx", "d").agg(F.sum(2 * F.log1p(F.col("d") * F.col("z"))).alias("s")).groupBy("vidx").agg(F.max_by("d", F.struct("s", -F.abs("d"))).alias("delta"), F.max("s").alias("s"))
    out = ends.join(best, "vidx").select("vidx", "n_sibship", "z_all", "delta", (F.signum("delta") * F.col("s") / (2 * F.ln(F.lit(10.0)))).alias("lod"), "s")
    return out.withColumn("p_z", z_p("z_all")).withColumn("p_lod", F.when(F.col("s") > 0, chi2_p("s", 1) / 2).otherwise(0.5)).drop("s")
