"""Tests of related samples: kinship-weighted scores, family-based rare-variant tests, permutation tests, LD pruning.

Kinship is block diagonal by pedigree. Its inverse is only needed through its products with a trait or a
constant, which are computed once per pedigree inside tasks; per variant everything is a weighted sum of
calls again. A pedigree of at most ``MOST_MEMBERS`` is a dense matrix. Results don't depend on that size:
of a larger one, products with the inverse come from its sparse form in memory linear in the pedigree, and
pairs come by generation from joins of sparse rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedlake.functions import special
from pedlake.functions.stats import z_p
from pedlake.operators.assoc import CASE, CONTROL
from pedlake.operators.cohort import Cohort
from pedlake.operators.components import components
from pedlake.operators.genes import _minor
from pedlake.operators.models import kinship, peeled
from pedlake.operators.order import numbered
from pedlake.operators.qc import _trios
from pedlake.plans.scratch import Scratch

#: A pedigree of more members than this is computed with sparse rows.
MOST_MEMBERS = 2000


def _task(c: Cohort) -> Column:
    """Whole pedigrees, many to a task; tasks follow the session's number of partitions."""
    n = 4 * int(c.samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64("pedigree"), F.lit(n)).alias("task")


def pedigrees(c: Cohort) -> DataFrame:
    """(iid, pat, mat, pedigree): connected pedigrees, whatever the family ids."""
    scratch = Scratch(c.samples.sparkSession, "pedigrees")
    s = scratch.cut(c.samples.select("iid", "pat", "mat"))
    links = s.select(F.col("iid").alias("a"), F.explode(F.filter(F.array("pat", "mat"), lambda p: p.isNotNull())).alias("b"))
    part = s.join(components(links), F.col("iid") == F.col("vertex"), "left").select("iid", "pat", "mat", F.coalesce("component", "iid").alias("pedigree"))
    return scratch.cut(part)


def _sparse_weights(up: list[tuple[int, ...]], have: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """inv(Phi[have, have]) y for each y of ``values``, Phi being twice the kinship; ``up`` has the parents' places, which come before their children's.

    The inverse over all members is (I - P)' D (I - P) with half a unit at each parent in P; the members
    without a value are eliminated by conjugate gradients.
    """
    n = len(up)
    inbred = np.zeros(n)
    d = np.zeros(n)
    ties: dict[tuple[int, ...], float] = {}
    for i, ps in enumerate(up):
        d[i] = 1.0 - sum(0.25 * (1 + inbred[p]) for p in ps)
        if len(ps) < 2:
            continue
        if ps not in ties:
            # a person's inbreeding is half the parents' relationship: contributions of their ancestors, the youngest first
            left, right = {ps[0]: 1.0}, {ps[1]: 1.0}
            heap, tie = [-ps[0], -ps[1]] if ps[0] != ps[1] else [-ps[0]], 0.0
            heapq.heapify(heap)
            while heap:
                j = -heapq.heappop(heap)
                a, b = left.pop(j, 0.0), right.pop(j, 0.0)
                tie += a * b * d[j]
                for p in up[j]:
                    if p not in left and p not in right:
                        heapq.heappush(heap, -p)
                    if a:
                        left[p] = left.get(p, 0.0) + a / 2
                    if b:
                        right[p] = right.get(p, 0.0) + b / 2
            ties[ps] = tie
        inbred[i] = ties[ps] / 2
    kid = np.array([i for i, ps in enumerate(up) for _ in ps], dtype=int)
    par = np.array([p for ps in up for p in ps], dtype=int)

    def times(x: np.ndarray) -> np.ndarray:
        r = (x - np.bincount(kid, 0.5 * x[par], n)) / d
        return r - np.bincount(par, 0.5 * r[kid], n)

    free = np.ones(n, dtype=bool)
    free[have] = False
    scale = 1 / d + np.bincount(par, 0.25 / d[kid], n)
    out = []
    for y in values:
        x = np.zeros(n)
        x[have] = y
        r = np.where(free, -times(x), 0.0)
        z = r / scale
        q, rz = z.copy(), r @ z
        least, rounds = 1e-26 * rz, 0
        while rz > least:
            rounds += 1
            if rounds > 20 * n:
                raise ArithmeticError("conjugate gradients didn't converge")
            m = np.where(free, times(q), 0.0)
            step = rz / (q @ m)
            x, r = x + step * q, r - step * m
            z = r / scale
            before, rz = rz, r @ z
            q = z + rz / before * q
        out.append(times(x)[have])
    return out


def kinship_weights(c: Cohort, values: DataFrame, ped: DataFrame | None = None) -> DataFrame:
    """(iid, a, one): the samples with a value, with the entries of inv(Phi) y and of inv(Phi) 1.

    values: (iid, val). Phi is twice the kinship of the valued members of a pedigree; a pedigree with a
    cycle counts as unrelated. A task gets whole pedigrees.
    """
    rows = (pedigrees(c) if ped is None else ped).join(values, "iid", "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, ped in pdf.groupby("pedigree", sort=False):
            have = ped[ped["val"].notna()]
            if have.empty:
                continue
            ids, y = have["iid"].tolist(), have["val"].to_numpy(float)
            text = lambda v: v if isinstance(v, str) else None
            members = [(i, text(a), text(b)) for i, a, b in ped[["iid", "pat", "mat"]].itertuples(index=False)]
            try:
                if len(members) > MOST_MEMBERS:
                    order, up = peeled(members)
                    at = {k: j for j, k in enumerate(order)}
                    places, index = [tuple(sorted(at[p] for p in up[k])) for k in order], np.array([at[i] for i in ids])
                    a, one = _sparse_weights(places, index, y, np.ones(len(ids)))
                    out.append(pd.DataFrame({"iid": ids, "a": a, "one": one, "val": y}))
                    continue
                order, phi = kinship(members)
                at = {k: j for j, k in enumerate(order)}
                sub = phi[np.ix_([at[i] for i in ids], [at[i] for i in ids])]
            except ValueError:
                if len(members) > MOST_MEMBERS:
                    out.append(pd.DataFrame({"iid": ids, "a": y, "one": np.ones(len(ids)), "val": y}))
                    continue
                sub = np.eye(len(ids))
            inv = np.linalg.pinv(sub)
            out.append(pd.DataFrame({"iid": ids, "a": inv @ y, "one": inv.sum(1), "val": y}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["iid", "a", "one", "val"])

    return rows.groupBy(_task(c)).applyInPandas(solve, "iid string, a double, one double, val double")


def blue_freq(c: Cohort) -> DataFrame:
    """Best linear unbiased frequency: kinship-weighted mean of genotypes, half of it."""
    w = Scratch(c.samples.sparkSession, "blue").cut(kinship_weights(c, c.samples.select("iid", F.lit(1.0).alias("val"))).select("iid", "one"))
    return c.called().join(w, "iid").groupBy("vidx").agg((F.sum(F.col("one") * F.col("g")) / F.nullif(F.sum("one"), F.lit(0.0)) / 2).alias("p_blue"), F.count(F.lit(1)).alias("n"))


def qls_kinship(c: Cohort, trait: str) -> DataFrame:
    """Quasi-likelihood score with w = y'(Phi^-1 - Phi^-1 1 1'Phi^-1 / (1'Phi^-1 1)) over the trait's samples."""
    scratch = Scratch(c.samples.sparkSession, "qls")
    w = scratch.cut(kinship_weights(c, c.trait(trait)))
    total = w.agg(F.sum("a").alias("sa"), F.sum("one").alias("s1"), F.sum(F.col("a") * F.col("val")).alias("aa")).first()
    if not total["s1"]:
        return c.called().select("vidx", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("stat"), F.lit(1.0).alias("p_qls")).limit(0)
    k = total["sa"] / total["s1"]
    wy = total["aa"] - k * total["sa"]
    t = c.called().join(w.select("iid", (F.col("a") - k * F.col("one")).alias("w"), "one"), "iid")
    m = t.groupBy("vidx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("g")).alias("wg"), F.sum("w").alias("sw"), (F.sum(F.col("one") * F.col("g")) / F.nullif(F.sum("one"), F.lit(0.0)) / 2).alias("p"))
    var = 2 * F.col("p") * (1 - F.col("p")) * F.lit(wy)
    out = m.select("vidx", "n", ((F.col("wg") - 2 * F.col("p") * F.col("sw")) / F.sqrt(F.when(var > 1e-12, var))).alias("stat"))
    return out.withColumn("p_qls", z_p("stat"))


def coded_phenotype(c: Cohort, trait: str, prevalence: float = 0.1, plain: bool = False) -> DataFrame:
    """(iid, val) of every sample: cases 1, controls -K / (1 - K), unknown 0; ``plain``: 1, 0 and K."""
    y = c.trait(trait)
    case, control, unknown = (1.0, 0.0, prevalence) if plain else (1.0, -prevalence / (1 - prevalence), 0.0)
    return c.samples.select("iid").join(y, "iid", "left").select("iid", F.when(F.col("val") == CASE, case).when(F.col("val") == CONTROL, control).otherwise(unknown).alias("val"))


def mqls(c: Cohort, trait: str, prevalence: float = 0.1, plain: bool = False) -> DataFrame:
    """More powerful quasi-likelihood score of the coded phenotype a over called samples (``plain``: of 1, 0, K):

    T = sum a (g - p) / sqrt((a' Phi a - (sum a)^2 / (1' inv(Phi) 1)) p (1 - p / 2)), p the kinship-weighted mean.
    a' Phi a is summed over called pairs of relatives, which have a row each; nothing else meets in pairs.
    """
    coded = coded_phenotype(c, trait, prevalence, plain)
    scratch = Scratch(c.samples.sparkSession, "mqls")
    ped = pedigrees(c)
    w = scratch.cut(kinship_weights(c, coded, ped).select("iid", F.col("val").alias("a"), "one"))
    pairs = scratch.cut(kinship_pairs(c, ped))
    own = pairs.where("iid1 = iid2").select(F.col("iid1").alias("iid"), F.col("kinship2").alias("self"))
    t = scratch.cut(c.called().join(w, "iid").join(own, "iid"))
    m = t.groupBy("vidx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * F.col("g")).alias("xa"), F.sum("a").alias("sa"), F.sum(F.col("a") * F.col("a") * F.col("self")).alias("saa"), (F.sum(F.col("one") * F.col("g")) / F.nullif(F.sum("one"), F.lit(0.0))).alias("p"), F.sum("one").alias("s1"))
    with_a = t.where("a != 0").select("vidx", "iid", "a")
    kin = pairs.where("iid1 < iid2 and kinship2 != 0")
    two = with_a.join(kin.withColumnRenamed("iid1", "iid"), "iid").join(with_a.select("vidx", F.col("iid").alias("iid2"), F.col("a").alias("b")), ["vidx", "iid2"])
    off = two.groupBy("vidx").agg(F.sum(2 * F.col("a") * F.col("b") * F.col("kinship2")).alias("off"))
    m = m.join(off, "vidx", "left").withColumn("aa", F.col("saa") + F.coalesce("off", F.lit(0.0)))
    var = (F.col("aa") - F.col("sa") * F.col("sa") / F.nullif("s1", F.lit(0.0))) * F.col("p") * (1 - F.col("p") / 2)
    out = m.select("vidx", "n", ((F.col("xa") - F.col("p") * F.col("sa")) / F.sqrt(F.when(var > 1e-12, var))).alias("stat"))
    return out.withColumn("p_mqls", z_p("stat"))


def transmissions(c: Cohort, trait: str) -> DataFrame:
    """Per variant and affected child of two called parents: minor alleles passed (b) and not passed (n) by
    heterozygous parents, with the frequency among parents."""
    sick = c.trait(trait).where(F.col("val") == CASE).select("iid")
    t = _trios(c).where("pa is not null and ma is not null").join(sick, "iid", "left_semi")
    het = (F.col("pa") == 1).cast("int") + (F.col("ma") == 1).cast("int")
    got = F.col("child") - (F.col("pa") == 2).cast("int") - (F.col("ma") == 2).cast("int")
    freq = t.groupBy("vidx").agg((F.sum(F.col("pa") + F.col("ma")) / (4 * F.count(F.lit(1)))).alias("maf"))
    return t.where((het > 0) & (got >= 0) & (got <= het)).select("vidx", "iid", got.alias("b"), (het - got).alias("n")).join(freq, "vidx")


def rare_tdt(c: Cohort, trait: str, cuts: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """Rare-variant transmission test per gene and frequency cut: z = (passed - not) / sqrt(sum), one-sided."""
    t = transmissions(c, trait).join(c.sets, "vidx").withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).where("maf <= cut")
    m = t.groupBy("gene", "cut").agg(F.sum("b").alias("n_transmitted"), F.sum("n").alias("n_not"), F.countDistinct("vidx").alias("n_variant"))
    return m.withColumn("z", (F.col("n_transmitted") - F.col("n_not")) / F.sqrt((F.col("n_transmitted") + F.col("n_not")).cast("double")))


def weighted_sum(c: Cohort, trait: str, permutations: int = 1000, rare: float = 0.05, seed: int = 1) -> DataFrame:
    """Madsen-Browning rank sum per gene: weights from controls, normal p-value against permuted labels.

    A task gets the carriers of whole genes; samples that carry nothing are tied at rank zero, so only their
    numbers of cases and controls are needed.
    """
    y = c.trait(trait).where(F.col("val").isin(CASE, CONTROL)).select("iid", (F.col("val") == CASE).alias("case"))
    totals = y.agg(F.count_if("case").alias("n1"), F.count_if(~F.col("case")).alias("n0")).first()
    n1, n0 = totals["n1"], totals["n0"]
    t = _minor(c).join(y, "iid")
    w = t.groupBy("vidx").agg(F.sum(F.when(~F.col("case"), F.col("m")).otherwise(0)).alias("mu"), F.count_if(~F.col("case")).alias("nu"), F.count(F.lit(1)).alias("n"), F.max("maf").alias("maf"))
    q = (F.col("mu") + 1) / (2 * F.col("nu") + 2)
    w = w.where((F.col("maf") > 0) & (F.col("maf") <= rare)).select("vidx", F.sqrt(F.col("n") * q * (1 - q)).alias("w"))
    score = t.where("m > 0").join(w, "vidx").join(c.sets, "vidx").groupBy("gene", "iid", "case").agg(F.sum(F.col("m") / F.col("w")).alias("score"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        gene, s, case = pdf["gene"].iloc[0], pdf["score"].to_numpy(float), pdf["case"].to_numpy(bool)
        k, n = len(s), n1 + n0
        ranks = pd.Series(s).rank().to_numpy() + (n - k)
        zero = (n - k + 1) / 2
        stat = ranks[case].sum() + (n1 - case.sum()) * zero
        rng = np.random.default_rng([seed, *gene.encode()])
        drawn = []
        for _ in range(permutations):
            a = rng.hypergeometric(n1, n0, k) if 0 < k < n else min(k, n1)
            pick = rng.permutation(k)[:a]
            drawn.append(ranks[pick].sum() + (n1 - a) * zero)
        sd = float(np.std(drawn, ddof=1))
        z = (stat - float(np.mean(drawn))) / sd if sd > 0 else np.nan
        return pd.DataFrame([(gene, k, stat, z, float(2 * special.norm_sf(abs(z))) if z == z else None)], columns=["gene", "n_carrier", "stat_wsum", "z", "p_wsum"])

    return score.groupBy("gene").applyInPandas(test, "gene string, n_carrier int, stat_wsum double, z double, p_wsum double")


def prune(c: Cohort, window: int = 50, step: int = 5, r2: float = 0.5) -> DataFrame:
    """Variants kept by pairwise LD pruning: in each window the later of a pair above r2 goes.

    Windows of ``window`` variants start every ``step``; a pair is judged in the first window that holds
    both, if any does, and windows one after the other. Only pairs less than a window apart are correlated, by an equi join on (block, sample), where a
    block is twice a window long; the order-dependent part runs over the pairs found, per chromosome.
    """
    order = numbered(c.variants.where("chrom is not null and pos is not null").select("vidx", "chrom", "pos"), "chrom", "pos", "vidx").select("vidx", "chrom", "i")
    blocks = order.withColumn("block", F.explode(F.array(F.floor(F.col("i") / window), F.floor(F.col("i") / window) - 1)))
    g = c.called().join(c.samples.where("founder").select("iid"), "iid", "left_semi").join(blocks, "vidx")
    b = g.select("chrom", "block", "iid", F.col("vidx").alias("v2"), F.col("i").alias("j"), F.col("g").alias("h"))
    t = g.join(b, ["chrom", "block", "iid"]).where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") < window) & (F.floor(F.col("i") / window) == F.col("block")))
    x, y = F.col("g").cast("double"), F.col("h").cast("double")
    m = t.groupBy("chrom", "vidx", "i", "v2", "j").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n = F.col("n")
    vx, vy, cxy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy"), n * F.col("sxy") - F.col("sx") * F.col("sy")
    start = F.greatest(F.lit(0), F.ceil((F.col("j") - window) / F.lit(step)) * step)  # places count from 1, so j is the (j - 1)th
    pairs = m.where((vx > 0) & (vy > 0) & (cxy * cxy > F.lit(r2) * vx * vy)).select("chrom", "vidx", "i", "v2", "j", start.alias("s")).where("s <= i - 1")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for a, z in pdf.sort_values(["s", "i", "j"])[["vidx", "v2"]].itertuples(index=False):
            if a not in gone and z not in gone:
                gone.add(z)
        return pd.DataFrame({"vidx": sorted(gone)}, dtype="int64")

    dropped = pairs.groupBy("chrom").applyInPandas(walk, "vidx long")
    return order.select("vidx").join(dropped, "vidx", "left_anti")


def prune_vif(c: Cohort, window: int = 50, step: int = 5, most: float = 2.0) -> DataFrame:
    """Variants kept by variance inflation: in each window of founders' genotypes, one of a perfectly correlated pair goes (the rarer),
    then the variant of greatest inflation as long as that is above ``most``.

    Correlations come from one pass over pairs less than a window apart; the windows of a chromosome, which depend on each
    other, are walked over them.
    """
    from pedlake.operators.blocks import pair_tables

    order = numbered(c.variants.where("chrom is not null and pos is not null").select("vidx", "chrom", "pos"), "chrom", "pos", "vidx").select("vidx", "chrom", (F.col("i") - 1).alias("i"))
    block = F.floor(F.col("i") / window)
    sets = order.select("vidx", F.explode(F.array(F.concat_ws(":", "chrom", block), F.concat_ws(":", "chrom", block - 1))).alias("gene"))
    founders = c.calls.join(c.samples.where("founder").select("iid"), "iid", "left_semi")
    t = pair_tables(Cohort(c.samples, founders, c.traits, c.variants, c.sets), None, sets).drop("gene").dropDuplicates(["vidx1", "vidx2"])
    cell = {(i, j): F.col(f"a{i}{j}").cast("double") for i in range(3) for j in range(3)}
    n = sum(cell.values())
    sx, sy = sum(i * x for (i, _), x in cell.items()), sum(j * x for (_, j), x in cell.items())
    vx, vy = n * sum(i * i * x for (i, _), x in cell.items()) - sx * sx, n * sum(j * j * x for (_, j), x in cell.items()) - sy * sy
    r = F.when((vx > 0) & (vy > 0), (n * sum(i * j * x for (i, j), x in cell.items()) - sx * sy) / F.sqrt(vx * vy))
    place = order.select("vidx", "chrom", "i")
    freq = founders.where("g is not null").groupBy("vidx").agg((F.avg("g") / 2).alias("p"))
    pairs = t.select("vidx1", "vidx2", r.alias("r")).where("r is not null").join(place.withColumnsRenamed({"vidx": "vidx1", "i": "i1"}), "vidx1").join(place.drop("chrom").withColumnsRenamed({"vidx": "vidx2", "i": "i2"}), "vidx2").where(F.abs(F.col("i1") - F.col("i2")) < window)
    rows = pairs.select("chrom", "i1", "i2", "r").unionByName(place.join(freq, "vidx").select("chrom", F.col("i").alias("i1"), F.lit(-1).alias("i2"), F.least("p", 1 - F.col("p")).alias("r")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        single = pdf[pdf["i2"] < 0]
        maf = dict(zip(single["i1"], single["r"]))
        cor = {frozenset(x): v for *x, v in pdf[pdf["i2"] >= 0][["i1", "i2", "r"]].itertuples(index=False)}
        gone: set[int] = set()
        for s in range(0, int(max(maf, default=-1)) + 1, step):
            live = [i for i in range(s, s + window) if i not in gone and maf.get(i, 0.0) > 0]
            if len(live) < 2:
                continue
            m = np.array([[1.0 if a == b else cor.get(frozenset((a, b)), 0.0) for b in live] for a in live])
            for a in range(len(live)):
                for b in range(a):
                    if abs(m[a, b]) > 1 - 1e-9 and live[a] not in gone and live[b] not in gone:
                        gone.add(live[a] if maf[live[a]] <= maf[live[b]] else live[b])
            keep = [k for k, i in enumerate(live) if i not in gone]
            while len(keep) > 1:
                vif = np.diag(np.linalg.pinv(m[np.ix_(keep, keep)]))
                k = int(np.argmax(vif))
                if vif[k] <= most:
                    break
                gone.add(live[keep.pop(k)])
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "i": sorted(gone)}).astype({"i": "int32"})

    dropped = rows.groupBy("chrom").applyInPandas(walk, "chrom int, i int")
    return order.join(dropped, ["chrom", "i"], "left_anti").select("vidx")


def _lasso(gene: str, v: np.ndarray, n: int, xx: np.ndarray, xy: np.ndarray, lambdas: int) -> list[tuple]:
    """Coordinate descent on the moments of centred genotypes and trait."""
    norm = np.diag(xx)
    top = np.abs(xy).max(initial=0.0) / n
    beta, out = np.zeros(len(v)), []
    for lam in top * np.logspace(0, -2, lambdas):
        for _ in range(200):
            before = beta.copy()
            for j in np.nonzero(norm > 1e-9)[0]:
                z = xy[j] - xx[j] @ beta + norm[j] * beta[j]
                beta[j] = np.sign(z) * max(0.0, abs(z) - lam * n) / norm[j]
            if np.abs(beta - before).max(initial=0) < 1e-9:
                break
        out += [(gene, int(v[j]), float(lam), float(beta[j])) for j in np.nonzero(beta)[0]]
    return out


def lasso(c: Cohort, trait: str, lambdas: int = 10) -> DataFrame:
    """Lasso path per gene by coordinate descent, missing genotypes at the mean: the nonzero coefficients.

    The fit needs the moments of a gene's variants only: sums over blocks of samples, V x V numbers a gene.
    """
    from pedlake.operators.blocks import moments

    y = c.trait(trait)

    def fit(gene, v, n, xx, xy, yy, mean):
        return pd.DataFrame(_lasso(gene, v, n, xx, xy, lambdas), columns=["gene", "vidx", "lambda", "beta"])

    return moments(c.called(), c.sets, y, fit, "gene string, vidx long, lambda double, beta double")


def linkage(c: Cohort, thetas: tuple[float, ...] = (0.0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4)) -> DataFrame:
    """Two-point LOD scores of neighbouring variants from phase-known meioses.

    A meiosis is known if the parent is heterozygous at both variants and its own parents tell the phase, and
    the child's transmitted alleles are certain. Counts per pair come from joins; scores are closed forms.
    """
    order = numbered(c.variants.where("chrom is not null and pos is not null").select("vidx", "chrom", "pos"), "chrom", "pos", "vidx")
    nxt = order.select("vidx", "chrom", (F.col("i") + 1).alias("i")).join(order.select(F.col("vidx").alias("v2"), "chrom", "i"), ["chrom", "i"]).select("vidx", "v2")
    # transmitted minor allele of each parent, where certain
    t = _trios(c).where("pa is not null and ma is not null")
    sides = F.explode(F.array(F.struct(F.col("pat").alias("parent"), F.col("pa").alias("p"), F.col("ma").alias("o")), F.struct(F.col("mat").alias("parent"), F.col("ma").alias("p"), F.col("pa").alias("o"))))
    s = t.select("vidx", "iid", "child", sides.alias("s")).select("vidx", "iid", "child", "s.*")
    passed = F.when(F.col("p") != 1, F.col("p") / 2).when(F.col("o") != 1, F.col("child") - F.col("o") / 2).when(F.col("child") != 1, F.col("child") / 2)
    sent = s.select("vidx", "iid", "parent", F.col("p"), passed.cast("int").alias("a")).where("a in (0, 1)")
    # the grandparental origin of a parent's minor allele: 1 from the father, 0 from the mother
    pat = sent.join(c.samples.select("iid", F.col("pat").alias("father")), "iid").where(F.col("parent") == F.col("father")).select("vidx", F.col("iid").alias("parent"), F.col("a").alias("from_father"))
    known = sent.where("p = 1").join(pat, ["vidx", "parent"]).select("vidx", "iid", "parent", (F.col("a") == F.col("from_father")).cast("int").alias("origin"))
    pair = known.join(nxt, "vidx").join(known.select(F.col("vidx").alias("v2"), "iid", "parent", F.col("origin").alias("origin2")), ["v2", "iid", "parent"])
    m = pair.groupBy(F.col("vidx").alias("vidx1"), F.col("v2").alias("vidx2")).agg(F.count_if(F.col("origin") != F.col("origin2")).alias("n_rec"), F.count_if(F.col("origin") == F.col("origin2")).alias("n_non"))
    grid = m.withColumn("theta", F.explode(F.array(*(F.lit(float(x)) for x in thetas))))
    k, n, th = F.col("n_rec"), F.col("n_non"), F.col("theta")
    score = F.when((th == 0) & (k > 0), F.lit(None)).otherwise(F.when(k > 0, k * F.log10(F.when(th > 0, th))).otherwise(0.0) + n * F.log10(1 - th) + (k + n) * F.log10(F.lit(2.0)))
    return grid.withColumn("lod", score.cast("double"))


def linkage_verdict(c: Cohort) -> DataFrame:
    """The best recombination fraction of neighbouring variants in [0, 0.5], its LOD score and the verdict: LINKED from 3, POSSIBLE from 1.73,
    NOT_LINKED when the score at 0.05 is -2 or less, else AMBIGUOUS."""
    t = linkage(c, (0.05,))
    k, n = F.col("n_rec").cast("double"), (F.col("n_rec") + F.col("n_non")).cast("double")
    th = F.least(k / n, F.lit(0.5))
    log = lambda x, y: F.when(x > 0, x * F.log10(F.when(y > 0, y))).otherwise(0.0)
    best = log(k, th) + log(n - k, 1 - th) + n * F.log10(F.lit(2.0))
    t = t.select("vidx1", "vidx2", "n_rec", "n_non", F.col("lod").alias("lod_05"), th.alias("theta"), best.alias("lod"))
    verdict = F.when(F.col("lod") >= 3, "LINKED").when(F.col("lod") >= 1.73, "POSSIBLE").when(F.col("lod_05") <= -2, "NOT_LINKED").otherwise("AMBIGUOUS")
    return t.withColumn("verdict", verdict)


def genotype_elimination(c: Cohort) -> DataFrame:
    """(pedigree, vidx): variants whose calls no assignment of genotypes in a pedigree's nuclear families can explain.

    Sets of possible genotypes are narrowed from parents to children and back until nothing changes, for all variants of a
    pedigree at once. Complete in pedigrees without loops.
    """
    packed = c.called().groupBy("iid").agg(F.collect_list("vidx").alias("v"), F.collect_list("g").alias("g"))
    rows = pedigrees(c).join(packed, "iid", "left")
    # child sets by parents' genotypes, as bits 1, 2, 4
    child = np.array([[1, 3, 2], [3, 7, 6], [2, 6, 4]])

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, p in pdf.groupby("pedigree", sort=False):
            names = list(dict.fromkeys([*p["iid"], *(x for col in ("pat", "mat") for x in p[col] if isinstance(x, str))]))
            at = {k: i for i, k in enumerate(names)}
            called = [(at[i], v, g) for i, v, g in p[["iid", "v", "g"]].itertuples(index=False) if v is not None]
            if not called:
                continue
            ids, where = np.unique(np.concatenate([v for _, v, _ in called]), return_inverse=True)
            s = np.full((len(names), len(ids)), 7, dtype=np.int64)
            s[np.repeat([i for i, _, _ in called], [len(v) for _, v, _ in called]), where] = 1 << np.concatenate([g for *_, g in called]).astype(np.int64)
            trios = [(at[k], at.get(a), at.get(b)) for k, a, b in p[["iid", "pat", "mat"]].itertuples(index=False) if isinstance(a, str) or isinstance(b, str)]
            for _ in range(4 * len(names) + 4):
                before = s.copy()
                for k, a, b in trios:
                    fa = s[a] if a is not None else np.full(len(ids), 7)
                    mo = s[b] if b is not None else np.full(len(ids), 7)
                    new_k, new_a, new_b = (np.zeros(len(ids), dtype=np.int64) for _ in range(3))
                    for x in range(3):
                        for y in range(3):
                            ok = (fa >> x & 1) * (mo >> y & 1) * ((s[k] & child[x, y]) > 0)
                            new_k |= ok * (s[k] & child[x, y])
                            new_a |= ok << x
                            new_b |= ok << y
                    s[k] = new_k
                    if a is not None:
                        s[a] = new_a
                    if b is not None:
                        s[b] = new_b
                if (s == before).all():
                    break
            out.append(pd.DataFrame({"pedigree": name, "vidx": ids[(s == 0).any(0)]}))
        return pd.concat(out) if out else pd.DataFrame({"pedigree": pd.Series([], dtype=str), "vidx": pd.Series([], dtype="int64")})

    return rows.groupBy(_task(c)).applyInPandas(narrow, "pedigree string, vidx long")


def impute_mean(c: Cohort) -> DataFrame:
    """Missing genotypes at twice the frequency of the variant."""
    freq = c.called().groupBy("vidx").agg(F.avg("g").alias("mean"))
    return c.calls.join(freq, "vidx", "left").select("vidx", "iid", F.coalesce(F.col("g").cast("double"), F.col("mean")).alias("d"))


def inverse_normal(c: Cohort, trait: str, ranges: int = 256) -> DataFrame:
    """Ranks of a trait as normal quantiles, qnorm((rank - 1/2) / n); equal values are ranked by id.

    Ranks are taken within ranges of the value and shifted by a table of range counts.
    """
    from pedlake.functions.stats import norm_quantile

    spark = c.samples.sparkSession
    scratch = Scratch(spark, "ranks")
    y = scratch.cut(c.trait(trait))
    n = scratch.rows
    if not n:
        return y.select("iid", "val", F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("z"))
    splits = sorted(set(y.approxQuantile("val", [i / ranges for i in range(1, ranges)], 0.001)))
    y = y.withColumn("range_", F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s < F.col("val"))))
    rows, run = [], 0
    for r in sorted(y.groupBy("range_").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["range_"]):  # at most ``ranges`` rows
        rows.append((r["range_"], run))
        run += r["n"]
    start = F.broadcast(spark.createDataFrame(rows, "range_ int, start_ long"))
    rank = F.col("start_") + F.row_number().over(Window.partitionBy("range_").orderBy("val", "iid"))
    return y.join(start, "range_").withColumn("rank", rank).select("iid", "val", "rank", norm_quantile((F.col("rank") - 0.5) / n).alias("z"))


def kinship_pairs(c: Cohort, ped: DataFrame | None = None) -> DataFrame:
    """(iid1, iid2, kinship2): related pairs and each person with self, twice the kinship, within pedigrees."""
    rows = pedigrees(c) if ped is None else ped
    scratch = Scratch(c.samples.sparkSession, "large")
    large = scratch.cut(rows.groupBy("pedigree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_MEMBERS).select("pedigree"))
    any_large = scratch.rows > 0

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, ped in pdf.groupby("pedigree", sort=False):
            text = lambda v: v if isinstance(v, str) else None
            have = set(ped["iid"])
            try:
                order, phi = kinship([(i, text(a), text(b)) for i, a, b in ped[["iid", "pat", "mat"]].itertuples(index=False)])
            except ValueError:
                order, phi = list(have), np.eye(len(have))
            for i, j in zip(*np.nonzero(np.tril(phi))):
                if order[i] in have and order[j] in have:
                    a, b = sorted((order[i], order[j]))
                    out.append((a, b, phi[i, j]))
        return pd.DataFrame(out, columns=["iid1", "iid2", "kinship2"])

    small = rows.join(large, "pedigree", "left_anti") if any_large else rows
    out = small.groupBy(_task(c)).applyInPandas(solve, "iid1 string, iid2 string, kinship2 double")
    return out.unionByName(_large_pairs(rows.join(large, "pedigree", "left_semi"))) if any_large else out


def _large_pairs(rows: DataFrame) -> DataFrame:
    """``kinship_pairs`` by generation: the rows (i, j, k) of a generation with all before it come from its parents' rows.

    rows: (iid, pat, mat, pedigree). A round has two joins by a parent's id; only related pairs have rows. In a
    pedigree with a cycle everyone is related to self only.
    """
    scratch = Scratch(rows.sparkSession, "kinship")
    recorded = scratch.cut(rows)
    links = scratch.cut(recorded.select("pedigree", F.col("iid").alias("i"), F.explode(F.filter(F.array("pat", "mat"), lambda p: p.isNotNull())).alias("p")))
    named = recorded.select("pedigree", F.col("iid").alias("i")).unionByName(links.select("pedigree", F.col("p").alias("i"))).distinct()
    generations = [scratch.cut(named.join(links, "i", "left_anti"))]
    while scratch.rows:
        placed = reduce(DataFrame.unionByName, generations).select(F.col("i").alias("p"), F.lit(True).alias("placed"))
        ready = links.join(placed, "p", "left").groupBy("pedigree", "i").agg(F.count_if(F.col("placed").isNull()).alias("n")).where("n = 0").select("pedigree", "i")
        generations.append(scratch.cut(ready.join(placed.select(F.col("p").alias("i")), "i", "left_anti")))
    cyclic = scratch.cut(named.join(reduce(DataFrame.unionByName, generations), "i", "left_anti").select("pedigree").distinct())
    self = lambda df: df.select("i", F.col("i").alias("j"), F.lit(1.0).alias("k"))
    related: list[DataFrame] = []
    for g in generations[:-1]:
        g = g.join(cyclic, "pedigree", "left_anti")
        if not related:
            related.append(scratch.cut(self(g)))
            continue
        before = reduce(DataFrame.unionByName, related)
        ties = links.join(g.select("i"), "i", "left_semi").select("i", "p")
        older = scratch.cut(ties.join(before.select(F.col("i").alias("p"), "j", "k"), "p").groupBy("i", "j").agg((F.sum("k") / 2).alias("k")))
        same = older.join(ties.select(F.col("i").alias("j2"), F.col("p").alias("j")), "j").where("i <> j2").groupBy("i", F.col("j2").alias("j")).agg((F.sum("k") / 2).alias("k"))
        parents = recorded.join(g.select(F.col("i").alias("iid")), "iid", "left_semi").select("iid", "pat", "mat")
        own = parents.join(before.select(F.col("i").alias("pat"), F.col("j").alias("mat"), "k"), ["pat", "mat"], "left").select(F.col("iid").alias("i"), F.col("iid").alias("j"), (1 + F.coalesce("k", F.lit(0.0)) / 2).alias("k"))
        related.append(scratch.cut(older.unionByName(older.select(F.col("j").alias("i"), F.col("i").alias("j"), "k")).unionByName(same).unionByName(own)))
    pairs = reduce(DataFrame.unionByName, [*related, self(recorded.join(cyclic, "pedigree", "left_semi").select(F.col("iid").alias("i")))]).where("i <= j")
    for side in ("i", "j"):  # parents without a row of their own count but don't come out
        pairs = pairs.join(recorded.select(F.col("iid").alias(side)), side, "left_semi")
    return pairs.select(F.col("i").alias("iid1"), F.col("j").alias("iid2"), F.col("k").alias("kinship2"))


def conditional_variance(c: Cohort) -> DataFrame:
    """(iid, variance, rank): each sample's variance given all others of its pedigree, 1 / diag(inv(Phi)), and its rank, most independent first
    within the pedigree: those of least variance add least and go first from a selection."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, ped in pdf.groupby("pedigree", sort=False):
            if len(ped) > MOST_MEMBERS:
                raise ValueError(f"a pedigree of more than {MOST_MEMBERS} members")
            ids = ped["iid"].tolist()
            text = lambda v: v if isinstance(v, str) else None
            try:
                order, phi = kinship([(i, text(a), text(b)) for i, a, b in ped[["iid", "pat", "mat"]].itertuples(index=False)])
                at = {k: j for j, k in enumerate(order)}
                phi = phi[np.ix_([at[i] for i in ids], [at[i] for i in ids])]
            except ValueError:
                phi = np.eye(len(ids))
            d = np.diag(np.linalg.pinv(phi, hermitian=True))
            out.append(pd.DataFrame({"pedigree": name, "iid": ids, "variance": 1 / np.maximum(d, 1e-12)}))
        return pd.concat(out)

    t = pedigrees(c).groupBy(_task(c)).applyInPandas(solve, "pedigree string, iid string, variance double")
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("pedigree").orderBy(F.desc(F.round("variance", 9)), "iid"))).drop("pedigree")


def impute_relatives(c: Cohort) -> DataFrame:
    """(vidx, iid, d) for missing cells: the normal mean given the called relatives, 2p + Phi_mo inv(Phi_oo) (x_o - 2p), kept within 0 and 2;
    2p without any. Cells of a pedigree with one pattern of calls share an inverse."""
    freq = c.called().groupBy("vidx").agg(F.avg("g").alias("mean"))
    packed = c.calls.join(freq, "vidx").groupBy("iid").agg(F.collect_list("vidx").alias("v"), F.collect_list(F.coalesce(F.col("g").cast("int"), F.lit(-1))).alias("g"), F.collect_list("mean").alias("m"))
    rows = pedigrees(c).join(packed, "iid", "left")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, ped in pdf.groupby("pedigree", sort=False):
            some = ped[[v is not None for v in ped["v"]]]
            if some.empty:
                continue
            if len(ped) > MOST_MEMBERS:
                raise ValueError(f"a pedigree of more than {MOST_MEMBERS} members")
            ids, where = np.unique(np.concatenate(some["v"].tolist()), return_inverse=True)
            g = np.full((len(some), len(ids)), -2)
            mean = np.zeros(len(ids))
            row = np.repeat(np.arange(len(some)), [len(v) for v in some["v"]])
            g[row, where], mean[where] = np.concatenate(some["g"].tolist()), np.concatenate(some["m"].tolist())
            text = lambda v: v if isinstance(v, str) else None
            try:
                order, phi = kinship([(i, text(a), text(b)) for i, a, b in ped[["iid", "pat", "mat"]].itertuples(index=False)])
                at = [order.index(i) for i in some["iid"]] if len(order) < 50 else [{k: j for j, k in enumerate(order)}[i] for i in some["iid"]]
                phi = phi[np.ix_(at, at)]
            except ValueError:
                phi = np.eye(len(some))
            patterns: dict[bytes, list[int]] = {}
            for j in range(len(ids)):
                patterns.setdefault(g[:, j].clip(-2, 0).astype(np.int8).tobytes(), []).append(j)
            for cols in patterns.values():
                gap, have = np.nonzero(g[:, cols[0]] == -1)[0], np.nonzero(g[:, cols[0]] >= 0)[0]
                if not len(gap):
                    continue
                x = np.tile(mean[cols], (len(gap), 1))
                if len(have):
                    x = x + phi[np.ix_(gap, have)] @ np.linalg.pinv(phi[np.ix_(have, have)], hermitian=True) @ (g[np.ix_(have, cols)] - mean[cols])
                out.append(pd.DataFrame({"vidx": np.tile(ids[cols], len(gap)), "iid": np.repeat(some["iid"].to_numpy()[gap], len(cols)), "d": np.clip(x, 0, 2).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"vidx": pd.Series([], dtype="int64"), "iid": pd.Series([], dtype=object), "d": pd.Series([], dtype=float)})

    return rows.groupBy(_task(c)).applyInPandas(fill, "vidx long, iid string, d double")


def kinship_x(c: Cohort) -> DataFrame:
    """(iid1, iid2, kinship): probability that an X allele of each is the same by descent, within pedigrees; a male has his mother's alone.

    Persons without a recorded sex count as women; pairs that share nothing are left out.
    """
    rows = pedigrees(c).join(c.samples.select("iid", "sex"), "iid", "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, ped in pdf.groupby("pedigree", sort=False):
            if len(ped) > MOST_MEMBERS:
                raise ValueError(f"a pedigree of more than {MOST_MEMBERS} members")
            text = lambda v: v if isinstance(v, str) else None
            links = {i: (text(a), text(b)) for i, a, b in ped[["iid", "pat", "mat"]].itertuples(index=False)}
            men = set(ped.loc[ped["sex"] == 1, "iid"]) | {a for a, _ in links.values() if a is not None}
            try:
                order, _ = peeled([(i, a, b) for i, (a, b) in links.items()])
            except ValueError:
                continue
            at, phi = {k: i for i, k in enumerate(order)}, np.zeros((len(order), len(order)))
            for i, k in enumerate(order):
                a, b = links.get(k, (None, None))
                mother = phi[at[b], :i] if b is not None else np.zeros(i)
                father = phi[at[a], :i] if a is not None else np.zeros(i)
                row = mother if k in men else (mother + father) / 2
                phi[i, :i] = phi[:i, i] = row
                phi[i, i] = 1.0 if k in men else 0.5 + (phi[at[a], at[b]] / 2 if a is not None and b is not None else 0)
            for i, j in zip(*np.nonzero(np.tril(phi))):
                if order[i] in links and order[j] in links:
                    x, y = sorted((order[i], order[j]))
                    out.append((x, y, phi[i, j]))
        return pd.DataFrame(out, columns=["iid1", "iid2", "kinship"])

    return rows.groupBy(_task(c)).applyInPandas(solve, "iid1 string, iid2 string, kinship double")
