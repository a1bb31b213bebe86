"""Distributions of traits and penalized models: mixtures of normals, ridge, partial least squares, k-means, event counts.

A trait enters as the number of samples per distinct value, at most ``MOST_VALUES`` rows; genes as their moments.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.operators.blocks import moments
from pedlake.operators.cohort import Cohort
from pedlake.operators.family_rare import MOST_VALUES
from pedlake.plans.scratch import Scratch


def value_counts(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs; more than ``MOST_VALUES`` raise."""
    scratch = Scratch(df.sparkSession, "values")
    t = scratch.cut(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k")))
    if scratch.rows > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values: round them")
    rows = sorted((r["v"], r["k"]) for r in t.collect())
    return np.array([v for v, _ in rows], float), np.array([k for _, k in rows], float)


def normal_mixture(x: np.ndarray, n: np.ndarray, k: int, one_variance: bool = True, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, weights, means and standard deviations of k normals fitted to counted values, started at quantiles."""
    total, mean = n.sum(), (n * x).sum() / n.sum()
    sd0 = np.sqrt(max((n * (x - mean) ** 2).sum() / total, 1e-12))
    upto = np.cumsum(n) / total
    mu = np.array([x[np.searchsorted(upto, (i + 0.5) / k)] for i in range(k)]) + 1e-3 * sd0 * np.arange(k)
    w, sd, last = np.full(k, 1 / k), np.full(k, sd0 / (1 if k == 1 else 2)), -np.inf
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            log = np.log(w) - np.log(sd) - 0.5 * np.log(2 * np.pi) - 0.5 * ((x[:, None] - mu) / sd) ** 2
        top = log.max(1, keepdims=True)
        dens = np.exp(log - top)
        ll = float((n * (np.log(dens.sum(1)) + top[:, 0])).sum())
        post = dens / dens.sum(1, keepdims=True) * n[:, None]
        size = np.maximum(post.sum(0), 1e-9)
        w, mu = size / total, (post * x[:, None]).sum(0) / size
        var = (post * (x[:, None] - mu) ** 2).sum(0)
        sd = np.sqrt(np.maximum((np.full(k, var.sum() / total) if one_variance else var / size), 1e-6 * sd0**2))
        if abs(ll - last) < 1e-9 * (1 + abs(ll)):
            break
        last = ll
    order = np.argsort(mu)
    return ll, w[order], mu[order], sd[order]


def commingling(c: Cohort, trait: str, most: int = 3) -> DataFrame:
    """Mixtures of one to ``most`` normals of common variance: log likelihood, AIC, and weight, mean and deviation of each component."""
    x, n = value_counts(c.trait(trait), "val")
    rows = []
    for k in range(1, most + 1):
        if len(x) < 2 * k:
            break
        ll, w, mu, sd = normal_mixture(x, n, k)
        rows += [(k, float(ll), float(2 * (2 * k) - 2 * ll), i + 1, float(w[i]), float(mu[i]), float(sd[i])) for i in range(k)]
    return c.samples.sparkSession.createDataFrame(rows, "n_component int, logl double, aic double, component int, weight double, mean double, sd double")


def ridge(c: Cohort, trait: str, penalties: int = 20) -> DataFrame:
    """Ridge regression of a gene's variants at the penalty of least generalized cross-validation error; coefficients whose z is below 1 are
    cut to null. Per variant: penalty, beta and z."""

    def fit(gene, v, n, xx, xy, yy, mean):
        val, vec = np.linalg.eigh(xx)
        val, u = np.maximum(val, 0.0), vec.T @ xy
        best = None
        for lam in n * np.logspace(-4, 1, penalties):
            shrunk = u / (val + lam)
            df = (val / (val + lam)).sum()
            rss = yy - 2 * shrunk @ u + (val * shrunk**2).sum()
            gcv = rss / n / max(1e-9, 1 - df / n) ** 2
            if best is None or gcv < best[0]:
                best = (gcv, lam, shrunk, rss / max(1.0, n - df))
        _, lam, shrunk, s2 = best
        b = vec @ shrunk
        se = np.sqrt(np.maximum(s2 * ((vec**2) @ (val / (val + lam) ** 2)), 0.0))
        z = np.divide(b, se, out=np.zeros_like(b), where=se > 1e-12)
        return pd.DataFrame({"gene": gene, "vidx": v, "penalty": lam, "beta": [float(x) if abs(t) >= 1 else None for x, t in zip(b, z)], "z": z})

    return moments(c.called(), c.sets, c.trait(trait), fit, "gene string, vidx long, penalty double, beta double, z double")


def partial_least_squares(c: Cohort, trait: str, components: int = 2) -> DataFrame:
    """Partial least squares of a trait on a gene's variants: each variant's coefficient with ``components`` components, and the share of the
    trait's variance that they explain."""

    def fit(gene, v, n, xx, xy, yy, mean):
        u, b, done = xy.copy(), np.zeros(len(v)), []
        for _ in range(min(components, len(v))):
            size = np.linalg.norm(u)
            if size < 1e-9:
                break
            w = u / size
            for r in done:  # directions that are uncorrelated with those before
                w = w - (r @ xx @ w) / (r @ xx @ r) * r
            tt = float(w @ xx @ w)
            if tt < 1e-9:
                break
            done.append(w)
            b = b + w * (w @ xy) / tt
            u = xy - xx @ b
        share = float((b @ xy) / yy) if yy > 0 else None
        return pd.DataFrame({"gene": gene, "vidx": v, "beta": b, "r2": share})

    return moments(c.called(), c.sets, c.trait(trait), fit, "gene string, vidx long, beta double, r2 double")


def k_means(df: DataFrame, columns: list[str], k: int, rounds: int = 20, seed: int = 1) -> DataFrame:
    """df with ``cluster``: Lloyd's rounds from the k rows of least hash, a partial aggregate each; rows with a null have none."""
    scratch = Scratch(df.sparkSession, "means")
    t = scratch.cut(df)
    ok = None
    for c in columns:
        ok = F.col(c).isNotNull() if ok is None else ok & F.col(c).isNotNull()
    x = [F.col(c).cast("double") for c in columns]
    start = t.where(ok).select(*x).distinct().orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(k).collect()
    centres = [list(r) for r in start]
    if not centres:
        return t.withColumn("cluster", F.lit(None).cast("int"))

    def nearest(cs):
        d = [sum((v - F.lit(float(m))) * (v - F.lit(float(m))) for v, m in zip(x, row)) for row in cs]
        return F.when(ok, (F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1).cast("int"))

    for _ in range(rounds):
        new = {r["k"]: list(r)[1:] for r in t.withColumn("k", nearest(centres)).where("k is not null").groupBy("k").agg(*(F.avg(v) for v in x)).collect()}
        moved = [new.get(i, row) for i, row in enumerate(centres)]
        still = np.allclose(np.array(moved), np.array(centres))
        centres = moved
        if still:
            break
    return t.withColumn("cluster", nearest(centres))
