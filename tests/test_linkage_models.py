"""Likelihoods of pedigrees against enumeration, and sharing of sibs."""

import itertools
import math

import numpy as np
import pytest

from pedlake.operators import linkage_models as L
from pedlake.operators.cohort import Cohort
from tests.test_models import cohort


def enumerated(members, pen, geno, q, disease, theta):
    """Sum over all haplotype pairs of all members."""
    at = {k: i for i, (k, _, _) in enumerate(members)}
    prior = [(disease if h & 2 else 1 - disease) * (q if h & 1 else 1 - q) for h in range(4)]

    def sent(pair, h):
        return sum(0.5 * ((1 - theta) * (a == h) + theta * (((a & 2) | (b & 1)) == h)) for a, b in (pair, pair[::-1]))

    total = 0.0
    for haps in itertools.product(itertools.product(range(4), repeat=2), repeat=len(members)):
        p = 1.0
        for i, (_, pat, mat) in enumerate(members):
            a, b = haps[i]
            if geno[i] >= 0 and (a & 1) + (b & 1) != geno[i]:
                p = 0.0
                break
            p *= pen[i][(a >> 1) + (b >> 1)]
            p *= prior[a] if pat is None else sent(haps[at[pat]], a)
            p *= prior[b] if mat is None else sent(haps[at[mat]], b)
        total += p
    return total


def test_likelihood_is_the_sum_over_haplotypes():
    members = [("a", None, None), ("b", None, None), ("c", "a", "b"), ("d", "a", "b")]
    pen = np.array([[0.95, 0.5, 0.1], [0.05, 0.5, 0.9], [0.05, 0.5, 0.9], [1.0, 1.0, 1.0]])
    geno = np.array([[1, -1], [0, 1], [1, 2], [0, -1]])
    q, thetas = np.array([0.3, 0.2]), np.array([0.0, 0.1, 0.5])
    got = L.log_likelihoods(members, pen, geno, q, 0.07, thetas)
    for m in range(2):
        for t, theta in enumerate(thetas):
            want = enumerated(members, pen, geno[:, m], q[m], 0.07, theta)
            assert abs(got[m, t] - math.log(want)) < 1e-9


def test_loops_and_parents_who_are_one():
    members = [("a", None, None), ("b", None, None), ("c", "a", "b"), ("d", "a", "b"), ("e", "c", "d")]
    geno = np.array([[1], [-1], [-1], [1], [2]])
    pen = np.array([[1.0] * 3, [1.0] * 3, [0.05, 0.5, 0.9], [1.0] * 3, [0.05, 0.5, 0.9]])
    small = L.log_likelihoods(members, pen, geno, np.array([0.4]), 0.1, np.array([0.2]))
    assert np.isfinite(small).all()
    one = L.log_likelihoods(members[:3], pen[:3], geno[:3], np.array([0.4]), 0.1, np.array([0.2]))
    assert abs(one[0, 0] - math.log(enumerated(members[:3], pen[:3], geno[:3, 0], 0.4, 0.1, 0.2))) < 1e-9


def test_impossible_genotypes():
    members = [("a", None, None), ("b", None, None), ("c", "a", "b")]
    got = L.log_likelihoods(members, np.ones((3, 3)), np.array([[0], [0], [2]]), np.array([0.4]), 0.1, np.array([0.1]))
    assert np.isneginf(got).all()


def test_sharing_of_sibs():
    one = lambda *x: L._sharing(*(np.array([v]) for v in x[:4]), np.array([x[4]]))[0][0]
    assert one(2, 2, 1, 1, 0.3) == 2 and one(0, 2, 1, 1, 0.3) == 0 and one(1, 1, 0, 0, 0.3) != one(1, 1, 0, 0, 0.3)  # impossible: nan
    assert abs(one(0, 0, 0, 0, 0.3) - 1) < 1e-12 and abs(one(-1, -1, -1, -1, 0.3) - 1) < 1e-12
    assert one(2, 2, -1, -1, 0.01) > 1.9 > 1.1 > one(0, 0, -1, -1, 0.01) > 1


@pytest.fixture(scope="module")
def c(spark):
    got = cohort(spark, n_fam=12, n_var=4, seed=2)[0]
    return Cohort(got.samples.cache(), got.calls.cache(), got.traits.cache(), got.variants.cache(), got.sets.cache())


def test_flat_penetrance_has_no_lod(c):
    rows = L.lod_scores(L.pedigree_lods(c, "D", (0.3, 0.3, 0.3))).collect()
    assert len(rows) == 4 * len(L.THETAS) and all(abs(r["lod"]) < 1e-9 for r in rows)
    test = L.linkage_test(L.pedigree_lods(c, "D", (0.3, 0.3, 0.3))).collect()
    assert all(r["p"] > 0.49 for r in test)


def test_linked_marker_scores(spark, c):
    """The trait is one of the markers' own genotypes: linked at 0, with a penetrance to match."""
    y = c.called().where("vidx = 1").selectExpr("iid", "'T' trait", "'binary' kind", "cast(if(g > 0, 2, 1) as double) val")
    d = Cohort(c.samples, c.calls, c.traits.unionByName(y.select(c.traits.columns)), c.variants, c.sets)
    lods = L.pedigree_lods(d, "T", (0.001, 0.999, 0.999), 0.25).cache()
    best = {r["vidx"]: r for r in L.linkage_test(lods).collect()}
    assert best[1]["theta"] == 0.0 and best[1]["lod"] > 1.5 and best[1]["lod"] > max(best[v]["lod"] for v in (0, 2, 3))
    het = {r["vidx"]: r for r in L.homogeneity(lods).collect()}
    assert het[1]["p_smith"] > 0.05 and het[1]["stat_morton"] >= 0 and all(0 <= r["p_morton"] <= 1 for r in het.values())
    z = {r["vidx"]: r for r in L.sharing_linkage(d, "T").collect()}
    assert all(r["n_sibship"] <= 12 and 0 <= r["p_lod"] <= 1 for r in z.values())
