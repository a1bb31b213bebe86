"""Models with covariates and relatedness: regression by moments, logistic by Newton, mixed models, PCA.

What is per variant stays distributed. What is per sample pair (a relationship matrix and its
eigenvectors) is dense in the samples, so it is made for a stated list of samples of at most
``MOST_SAMPLES`` and then broadcast; beyond that use the relatives' relationship of ``pedigree``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.functions import special
from pedlake.operators.assoc import CASE, CONTROL, case_counts
from pedlake.operators.cohort import Cohort

MOST_SAMPLES = 10_000


def _singular(m: np.ndarray) -> bool:
    """Whether a matrix of sums of products is singular once its diagonal is scaled to 1."""
    d = np.sqrt(np.diag(m))
    if not np.all(d > 0):
        return True
    val = np.linalg.eigvalsh(m / np.outer(d, d))
    return val[0] < 1e-10 * val[-1]


def linear_covariates(c: Cohort, trait: str, covariates: list[str], interaction: bool = False) -> DataFrame:
    """y ~ 1 + covariates + g [+ g x covariates] per variant, from sums of products: beta, t and p of each term.

    A variant that can't be fitted has null values and the reason: too few ``samples`` or ``collinear`` terms.

    Sums are partial aggregates of k (k + 3) / 2 numbers per variant for k terms; a small solve per variant follows.
    """
    y = c.trait(trait).withColumnRenamed("val", "y")
    for i, name in enumerate(covariates):
        y = y.join(c.trait(name).withColumnRenamed("val", f"c{i}"), "iid")
    x = [F.lit(1.0), *(F.col(f"c{i}") for i in range(len(covariates))), F.col("g").cast("double")]
    terms = ["intercept", *covariates, "g"]
    if interaction:
        x += [F.col("g") * F.col(f"c{i}") for i in range(len(covariates))]
        terms += [f"g:{n}" for n in covariates]
    k = len(x)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = F.array(*(F.sum(x[i] * x[j]) for i, j in cells))
    t = c.called().join(y, "iid").groupBy("vidx").agg(F.count(F.lit(1)).alias("n"), sums.alias("xx"), F.array(*(F.sum(v * F.col("y")) for v in x)).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))

    none = lambda x: None if x != x else float(x)

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for vidx, n, xx, xy, yy in pdf.itertuples(index=False):
                m = np.zeros((k, k))
                for (i, j), s in zip(cells, xx):
                    m[i, j] = m[j, i] = s
                df = n - k
                reason = "samples" if df <= 0 else "collinear" if _singular(m) else None
                if reason:
                    out += [(vidx, n, name, None, None, None, reason) for name in terms]
                    continue
                inv = np.linalg.inv(m)
                b = inv @ xy
                s2 = max(0.0, yy - b @ xy) / df
                se = np.sqrt(s2 * np.diag(inv))
                stat = np.divide(b, se, out=np.full(k, np.nan), where=se > 0)
                out += [(vidx, n, name, b[i], none(stat[i]), none(p), None) for i, (name, p) in enumerate(zip(terms, special.t_sf2(stat, df)))]
            yield pd.DataFrame(out, columns=["vidx", "n", "term", "beta", "stat", "p_regr", "reason"]).astype({c: "Float64" for c in ("beta", "stat", "p_regr")})

    return t.mapInPandas(solve, "vidx long, n long, term string, beta double, stat double, p_regr double, reason string")


def logistic(c: Cohort, trait: str, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """case ~ 1 + g per variant by Newton steps on the 2 x 3 table, which is sufficient; Wald z and p.

    Where no fit exists, values are null and the reason is given: ``groups`` (no cases, no controls or one genotype
    only) or ``separation`` (steps that don't settle, as when carriers are all cases).
    """

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.array([0.0, 1.0, 2.0])
        for pdf in it:
            a, u = pdf[["a0", "a1", "a2"]].to_numpy(float), pdf[["u0", "u1", "u2"]].to_numpy(float)
            n = a + u
            b0, b1, turns = np.zeros(len(pdf)), np.zeros(len(pdf)), np.zeros(len(pdf), dtype=int)
            ok = (a.sum(1) > 0) & (u.sum(1) > 0) & ((n > 0).sum(1) > 1)
            live = ok.copy()
            with np.errstate(all="ignore"):
                for _ in range(rounds):
                    p = 1 / (1 + np.exp(-(b0[:, None] + b1[:, None] * g)))
                    w = n * p * (1 - p)
                    s0, s1 = (a - n * p).sum(1), ((a - n * p) * g).sum(1)
                    h00, h01, h11 = w.sum(1), (w * g).sum(1), (w * g * g).sum(1)
                    det = h00 * h11 - h01 * h01
                    d0, d1 = (h11 * s0 - h01 * s1) / det, (h00 * s1 - h01 * s0) / det
                    step = live & np.isfinite(d0) & np.isfinite(d1)
                    b0, b1 = np.where(step, b0 + d0, b0), np.where(step, b1 + d1, b1)
                    turns += step
                    live = step & (np.abs(d0) + np.abs(d1) > tolerance)
                    if not live.any():
                        break
                p = 1 / (1 + np.exp(-(b0[:, None] + b1[:, None] * g)))  # the information at the solution
                w = n * p * (1 - p)
                h00, h01, h11 = w.sum(1), (w * g).sum(1), (w * g * g).sum(1)
                z = b1 / np.sqrt(h00 / (h00 * h11 - h01 * h01))
            good = ok & ~live & np.isfinite(z) & (np.abs(b1) < 15)
            p = 2 * special.norm_sf(np.abs(np.where(good, z, 0)))
            value = lambda x: pd.array(np.where(good, x, 0.0), dtype="Float64").copy()
            out = pdf[["vidx"]].assign(n_iter=turns, beta=value(b1), stat=value(z), p_regr=value(p), reason=np.where(good, None, np.where(ok, "separation", "groups")))
            out.loc[~good, ["beta", "stat", "p_regr"]] = pd.NA
            yield out

    return case_counts(c, trait).mapInPandas(fit, "vidx long, n_iter int, beta double, stat double, p_regr double, reason string")


def _matrix(calls: DataFrame, order: dict[str, int]) -> DataFrame:
    """(vidx, x array<double>) standardized, a place per sample, missing NaN; variants with frequency in (0, 1)."""
    n = len(order)

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for vidx, cells in pdf.itertuples(index=False):
                i = np.array([order[r["iid"]] for r in cells])
                g = np.array([r["g"] for r in cells], float)
                p = g.mean() / 2
                if 0 < p < 1:
                    x = np.full(n, np.nan)
                    x[i] = (g - 2 * p) / np.sqrt(2 * p * (1 - p))
                    out.append((vidx, x))
            yield pd.DataFrame(out, columns=["vidx", "x"])

    ids = calls.sparkSession.createDataFrame([(k,) for k in order], "iid string")
    cells = calls.join(F.broadcast(ids), "iid").groupBy("vidx").agg(F.collect_list(F.struct("iid", "g")).alias("cells"))
    return cells.mapInPandas(rows, "vidx long, x array<double>")


def relationship(c: Cohort, iids: list[str]) -> np.ndarray:
    """Genomic relationship of the listed samples: the mean over variants of products of standardized genotypes.

    Blocks of variants are multiplied inside tasks; only sums of S x S numbers are added up.
    """
    if len(iids) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    order = {k: i for i, k in enumerate(iids)}
    n = len(iids)

    def block(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((n, n)), np.zeros((n, n))
        for pdf in it:
            if len(pdf):
                x = np.vstack(pdf["x"].to_numpy())
                seen = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                total += x.T @ x
                count += seen.T @ seen
        yield pd.DataFrame({"i": np.arange(n), "total": list(total), "count": list(count)})

    parts = _matrix(c.called(), order).mapInPandas(block, "i int, total array<double>, count array<double>")
    add = lambda col: F.array(*(F.sum(F.get(col, F.lit(j))) for j in range(n)))
    if n <= 200:
        rows = parts.groupBy("i").agg(add("total").alias("total"), add("count").alias("count")).collect()
    else:
        long = parts.select("i", F.posexplode(F.arrays_zip("total", "count")).alias("j", "z")).groupBy("i", "j").agg(F.sum("z.total").alias("t"), F.sum("z.count").alias("c"))
        rows = long.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "t"))), lambda s: s["t"]).alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda s: s["c"]).alias("count")).collect()
    out = np.zeros((n, n))
    for r in rows:
        out[r["i"]] = np.array(r["total"]) / np.maximum(1, np.array(r["count"]))
    return out


def principal_components(k: np.ndarray, n: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and scores, largest first, of the double-centred matrix (also multidimensional scaling)."""
    j = np.eye(len(k)) - 1 / len(k)
    val, vec = np.linalg.eigh(j @ k @ j)
    order = np.argsort(val)[::-1][:n]
    return val[order], vec[:, order] * np.sqrt(np.maximum(val[order], 0))


def heritability(y: np.ndarray, k: np.ndarray, reml: bool = True) -> dict[str, float]:
    """Variance components of y = mean + u + e with cov(u) = s2g K, by one-dimensional search on the eigenvalues of K."""
    val, vec = np.linalg.eigh(k)
    yr, xr = vec.T @ y, vec.T @ np.ones(len(y))

    def fit(h2: float) -> tuple[float, float, float]:
        d = h2 * np.maximum(val, 0) + (1 - h2)
        b = (xr * yr / d).sum() / (xr * xr / d).sum()
        r = yr - xr * b
        n = len(y) - reml
        s2 = (r * r / d).sum() / n
        ll = -0.5 * (n * np.log(2 * np.pi * s2) + np.log(d).sum() + n + (np.log((xr * xr / d).sum()) if reml else 0))
        return ll, b, s2

    grid = np.linspace(0, 0.999, 41)
    best = max(grid, key=lambda h: fit(h)[0])
    lo, hi = max(0.0, best - 0.025), min(0.999, best + 0.025)
    for _ in range(60):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if fit(a)[0] > fit(b)[0] else (a, hi)
    h2 = (lo + hi) / 2
    ll, b, s2 = fit(h2)
    return {"h2": h2, "sig2g": h2 * s2, "sig2": (1 - h2) * s2, "mean": b, "logl": ll}


def mixed_scan(c: Cohort, y: dict[str, float], k: np.ndarray, iids: list[str]) -> DataFrame:
    """Wald and score statistics per variant under y = mean + g beta + u + e, components held at the null fit.

    The rotation by the eigenvectors of K is broadcast once; each task rotates blocks of its variants.
    """
    yy = np.array([y[i] for i in iids])
    null = heritability(yy, k)
    val, vec = np.linalg.eigh(k)
    d = null["h2"] * np.maximum(val, 0) + 1 - null["h2"]
    spark = c.calls.sparkSession
    data = spark.sparkContext.broadcast((vec, d, vec.T @ yy, vec.T @ np.ones(len(iids))))
    n = len(iids)

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vec, d, yr, xr = data.value
        for pdf in it:
            if not len(pdf):
                continue
            g = np.nan_to_num(np.vstack(pdf["x"].to_numpy())) @ vec
            xx, xy = (xr * xr / d).sum(), (xr * yr / d).sum()
            gx, gg, gy = (g * xr / d).sum(1), (g * g / d).sum(1), (g * yr / d).sum(1)
            pxx, pxy = gg - gx * gx / xx, gy - gx * xy / xx
            pyy = (yr * yr / d).sum() - xy * xy / xx
            rest = np.maximum(pyy - pxy**2 / pxx, 1e-300)
            wald, score = (pyy - rest) * (n - 2) / rest, n * pxy**2 / (pyy * pxx)
            yield pd.DataFrame({"vidx": pdf["vidx"], "beta": pxy / pxx, "stat_wald": wald, "p_wald": special.f_sf(wald, 1, n - 2), "stat_score": score, "p_score": special.f_sf(score, 1, n - 2)})

    return _matrix(c.called(), {k: i for i, k in enumerate(iids)}).mapInPandas(scan, "vidx long, beta double, stat_wald double, p_wald double, stat_score double, p_score double")


def case_control(c: Cohort, trait: str) -> DataFrame:
    """Cases and controls of a binary trait."""
    return c.trait(trait).where(F.col("val").isin(CASE, CONTROL)).groupBy((F.col("val") == CASE).alias("case")).agg(F.count(F.lit(1)).alias("n"))


def peeled(samples: list[tuple[str, str | None, str | None]]) -> tuple[list[str], dict[str, list[str]]]:
    """The members of one pedigree (iid, pat, mat), parents before children, and their parents; a person on a cycle raises."""
    up = {i: [p for p in (a, b) if p] for i, a, b in samples}
    for ps in list(up.values()):
        for p in ps:
            up.setdefault(p, [])
    order, left = [], {i: len(p) for i, p in up.items()}
    kids: dict[str, list[str]] = {}
    for i, ps in up.items():
        for p in ps:
            kids.setdefault(p, []).append(i)
    todo = [i for i, n in left.items() if not n]
    while todo:
        i = todo.pop()
        order.append(i)
        for k in kids.get(i, ()):
            left[k] -= 1
            if not left[k]:
                todo.append(k)
    if len(order) < len(up):
        raise ValueError("the pedigree has a cycle")
    return order, up


def kinship(samples: list[tuple[str, str | None, str | None]]) -> tuple[list[str], np.ndarray]:
    """Twice the kinship coefficients of one pedigree (iid, pat, mat), parents before children by peeling; a person
    on a cycle raises. For a family that fits a task or the driver."""
    order, up = peeled(samples)
    at, phi = {k: i for i, k in enumerate(order)}, np.zeros((len(order), len(order)))
    for i, k in enumerate(order):
        ps = [at[p] for p in up[k]]
        row = sum((phi[p, :i] for p in ps), np.zeros(i)) / 2
        phi[i, :i] = phi[:i, i] = row
        phi[i, i] = 0.5 + (phi[ps[0], ps[1]] / 2 if len(ps) == 2 else 0)
    return order, 2 * phi
