"""Simulation by gene dropping, and power."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedlake.functions import special


def gene_drop(spark: SparkSession, pedigree: list[tuple[str, str | None, str | None]], n_variants: int, maf: tuple[float, float] = (0.05, 0.5), seed: int = 1) -> DataFrame:
    """(vidx, iid, g): founders draw two alleles by the variant's frequency, children one of each parent's.

    Variants are independent and spread over tasks; each has its own seed, so the result doesn't depend on
    the number of tasks. Members must come after their parents; an unnamed parent draws from the frequency.
    """
    place = {iid: i for i, (iid, _, _) in enumerate(pedigree)}
    names = [p[0] for p in pedigree]

    def run(it):
        for pdf in it:
            for v in pdf["id"]:
                r = np.random.default_rng([seed, int(v)])
                p = r.uniform(*maf)
                h = np.zeros((len(names), 2), dtype=np.int8)
                for i, (_, a, b) in enumerate(pedigree):
                    for k, parent in enumerate((a, b)):
                        h[i, k] = h[place[parent], r.integers(2)] if parent else r.random() < p
                yield pd.DataFrame({"vidx": v, "iid": names, "g": h.sum(1)})

    return spark.range(n_variants).mapInPandas(run, "vidx long, iid string, g tinyint")


def power(n: int, beta: float, maf: float, h2: float, alpha: float = 0.05) -> float:
    """Power of a one-degree test of n unrelated samples for an additive effect on a trait of variance 1.

    The variant explains 2 p (1 - p) beta^2 of the variance; n times the explained over the remaining part is
    the noncentrality.
    """
    explained = 2 * maf * (1 - maf) * beta * beta
    if explained >= 1 or h2 < explained:
        raise ValueError("the effect explains more than the heritability")
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(special.chi2_sf(mid, 1)) > alpha else (lo, mid)
    return 1 - special.ncx2_cdf((lo + hi) / 2, 1, n * explained / (1 - explained))


def power_range(spark: SparkSession, sizes: list[int], beta: float, maf: float, h2: float, alpha: float = 0.05) -> DataFrame:
    rows = [(n, power(n, beta, maf, h2, alpha)) for n in sizes]
    return spark.createDataFrame(rows, "n long, power double")


def permutations(ids: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """(perm_id, key, place): n random orders of the keys, each by the hash of (key, perm_id, seed)."""
    t = ids.select(key).distinct().withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return t.withColumn("place", F.xxhash64(key, "perm_id", F.lit(seed)))


def effective_samples(correlation: np.ndarray) -> float:
    """1 + (n - 1)(1 - var(eigenvalues) / n)."""
    val = np.linalg.eigvalsh(correlation)
    n = len(val)
    return 1 + (n - 1) * (1 - float(np.var(val, ddof=1)) / n) if n > 1 else float(n)


def lod(n_recombinant: int, n_nonrecombinant: int, theta: float) -> float:
    """Two-point LOD score of counted meioses at a recombination fraction."""
    if theta == 0 and n_recombinant:
        return -math.inf
    k, m = n_recombinant, n_nonrecombinant
    return (k * math.log10(theta) if k else 0.0) + m * math.log10(1 - theta) + (k + m) * math.log10(2)


TRIO = [("father", None, None), ("mother", None, None), ("child", "father", "mother")]


def replicate(family: list[tuple[str, str | None, str | None]], n: int) -> list[tuple[str, str | None, str | None]]:
    """n copies of a family, ids with the number of the copy before them: trios or larger templates for ``gene_drop``."""
    name = lambda k, x: None if x is None else f"{k}.{x}"
    return [(name(k, i), name(k, a), name(k, b)) for k in range(n) for i, a, b in family]
