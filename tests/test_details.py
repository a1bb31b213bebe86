"""Operators without SQL against brute force on small families."""

import math

import numpy as np
import pytest

from pedlake.operators import assoc, filters, interactions, mixed, pedigree, qc, related, traits
from pedlake.operators.cohort import Cohort
from pedlake.plans import details
from tests.test_models import cohort


@pytest.fixture(scope="module")
def c(spark):
    got = cohort(spark, n_fam=25, n_var=10, seed=4)[0]
    return Cohort(got.samples.cache(), got.calls.cache(), got.traits.cache(), got.variants.cache(), got.sets.cache())


def values(c, trait):
    return {r["iid"]: r["val"] for r in c.trait(trait).collect()}


def genotypes(c):
    return {(r["vidx"], r["iid"]): r["g"] for r in c.called().collect()}


def test_pair_regression(c):
    y, g = values(c, "Y"), genotypes(c)
    rows = {(r["vidx1"], r["vidx2"]): r for r in assoc.pair_regression(c, "Y").collect()}
    assert len(rows) == 20
    for a, b in ((0, 1), (6, 9)):
        ids = [i for i in y if (a, i) in g and (b, i) in g]
        x = np.array([(1, g[a, i], g[b, i], g[a, i] * g[b, i]) for i in ids], float)
        t = np.array([y[i] for i in ids])
        beta, *_ = np.linalg.lstsq(x, t, rcond=None)
        s2 = ((t - x @ beta) ** 2).sum() / (len(t) - 4)
        assert rows[a, b]["n"] == len(ids) and abs(rows[a, b]["beta"] - beta[3]) < 1e-8 and abs(rows[a, b]["stat"] - beta[3] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[3, 3])) < 1e-6


def test_loops_and_generations(spark, c):
    assert {r["n_loop"] for r in pedigree.pedigree_loops(c).collect()} == {0}
    gen = {r["iid"]: r["generation"] for r in pedigree.generations(c).collect()}
    assert (gen["a0"], gen["c0"], gen["f0"]) == (1, 2, 3)
    # first cousins who marry make a loop; two brothers with two sisters make a loop; mates who change partners in a circle make a ring
    rows = [("s1", "x", "y"), ("s2", "x", "y"), ("k1", "s1", "m1"), ("k2", "s2", "m2"), ("z", "k1", "k2"), ("u", "A", "B"), ("v", "C", "B"), ("w", "C", "D"), ("q", "A", "D"), ("lonely", None, None), ("self", "self", None)]
    s = spark.createDataFrame(rows, "iid string, pat string, mat string")
    d = Cohort(s, c.calls, c.traits, c.variants, c.sets)
    got = {r["pedigree"]: (r["n_person"], r["n_couple"], r["n_ring"], r["n_loop"]) for r in pedigree.pedigree_loops(d).collect()}
    assert got == {"k1": (9, 4, 0, 1), "A": (8, 4, 1, 1)}
    deep = {r["iid"]: r["generation"] for r in pedigree.generations(d).collect()}
    assert deep["z"] == 4 and deep["lonely"] == 1 and deep["self"] is None
    assert {(r["pat"], r["mat"], r["distance"]) for r in pedigree.consanguineous(d).collect()} == {("k1", "k2", 4)}


def test_elimination(spark, c):
    s = spark.createDataFrame([("k", "p", "m"), ("l", "p", "m"), ("p", None, None), ("m", None, None)], "iid string, pat string, mat string")
    calls = [(1, "k", 2), (1, "p", 0), (2, "k", 0), (2, "l", 2), (2, "p", 0), (3, "k", 0), (3, "l", 2), (4, "k", 1), (4, "p", 2), (4, "m", 2), (5, "k", None), (5, "p", 0)]
    d = Cohort(s, spark.createDataFrame(calls, "vidx long, iid string, g tinyint"), c.traits, c.variants, c.sets)
    assert {r["vidx"] for r in related.genotype_elimination(d).collect()} == {1, 2, 4}
    fine = Cohort(c.samples, c.calls, c.traits, c.variants, c.sets)
    assert related.genotype_elimination(fine).count() == 0  # dropped genes are consistent


def test_vif(c):
    kept = {r["vidx"] for r in related.prune_vif(c, 4, 2, 1.05).collect()}
    founders = [r["iid"] for r in c.samples.where("founder").collect()]
    g = genotypes(c)
    gone = set()
    for chrom in (1, 2):
        order = [v for v in range(10) if 1 + v % 2 == chrom]
        for s in range(0, len(order), 2):
            live = [v for v in order[s : s + 4] if v not in gone]
            while len(live) > 1:
                m = np.corrcoef([[g[v, f] for f in founders] for v in live])
                vif = np.diag(np.linalg.inv(m))
                if vif.max() <= 1.05:
                    break
                gone.add(live.pop(int(np.argmax(vif))))
    assert kept == set(range(10)) - gone and gone


def test_commingling(c):
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(0, 1, 3000), rng.normal(5, 1, 1000)]), 3)
    v, n = np.unique(x, return_counts=True)
    ll, w, mu, sd = traits.normal_mixture(v, n.astype(float), 2)
    assert np.allclose(mu, [0, 5], atol=0.15) and np.allclose(w, [0.75, 0.25], atol=0.03) and np.allclose(sd, 1, atol=0.08)
    assert ll > traits.normal_mixture(v, n.astype(float), 1)[0]
    rows = traits.commingling(c, "Y").collect()
    one = [r for r in rows if r["n_component"] == 1][0]
    y = np.array(list(values(c, "Y").values()))
    assert abs(one["mean"] - y.mean()) < 1e-9 and abs(one["sd"] - y.std()) < 1e-9


def test_penalized_models(c):
    y, g = values(c, "Y"), genotypes(c)
    ids = list(y)
    x = np.array([[g.get((v, i), np.nan) for v in range(5)] for i in ids], float)
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    x, t = x - x.mean(0), np.array([y[i] for i in ids]) - np.mean(list(y.values()))
    rows = {r["vidx"]: r for r in traits.ridge(c, "Y").where("gene = 'G0'").collect()}
    b = np.linalg.solve(x.T @ x + rows[0]["penalty"] * np.eye(5), x.T @ t)
    assert all(r["beta"] is None or abs(r["beta"] - b[v]) < 1e-8 for v, r in rows.items()) and rows[0]["beta"] is not None
    full = {r["vidx"]: r["beta"] for r in traits.partial_least_squares(c, "Y", 5).where("gene = 'G0'").collect()}
    assert np.allclose([full[v] for v in range(5)], np.linalg.lstsq(x, t, rcond=None)[0], atol=1e-6)  # all components: least squares
    w = x.T @ t
    w = w / np.linalg.norm(w)
    first = {r["vidx"]: r["beta"] for r in traits.partial_least_squares(c, "Y", 1).where("gene = 'G0'").collect()}
    assert np.allclose([first[v] for v in range(5)], w * (w @ x.T @ t) / (w @ x.T @ x @ w))


def test_k_means(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([rng.normal((0, 0), 0.3, (40, 2)), rng.normal((5, 5), 0.3, (40, 2))]))] + [(99, None, 1.0)]
    got = {r["id"]: r["cluster"] for r in traits.k_means(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], 2).collect()}
    assert len({got[i] for i in range(40)}) == 1 and len({got[i] for i in range(40, 80)}) == 1 and got[0] != got[79] and got[99] is None


def test_mdr_permutations(c):
    rows = {r["gene"]: r for r in interactions.mdr_permuted(c, "D", 19).collect()}
    best = {}
    for r in assoc.mdr(c, "D", 1000).collect():
        best[r["gene"]] = max(best.get(r["gene"], 0), r["score"])
    assert {k: round(r["score"], 9) for k, r in rows.items()} == {k: round(v, 9) for k, v in best.items()} and rows["G0"]["p_perm"] == 0.05


def test_random_filters(c):
    n = c.samples.count()
    a = {r["iid"] for r in filters.random_count(c.samples, "iid", 10).collect()}
    assert len(a) == 10 and a == {r["iid"] for r in filters.random_count(c.samples.orderBy("iid"), "iid", 10).collect()}
    gone = filters.random_missing(c.calls, 0.3).where("g is null").count() - c.calls.where("g is null").count()
    assert 0.2 * 10 * n < gone < 0.4 * 10 * n
    assert filters.random_missing_traits(c.traits, 1.0).where("val is not null").count() == 0
    with pytest.raises(ValueError):
        filters.variable_rule("AGE", {"AGE"})
    cells = c.calls.selectExpr("vidx", "iid", "g", "cast(vidx as string) DP")
    assert {r["vidx"] for r in filters.filter_cells(cells, "DP < 5").where("g is not null").select("vidx").distinct().collect()} == {5, 6, 7, 8, 9}


def test_gene_burden_in_the_mixed_model(c):
    d = Cohort(c.samples, c.calls, c.traits.replace("Y", "AGE", subset=["trait"]), c.variants, c.sets)
    got = {r["gene"]: r for r in details.gene_mixed(d).collect()}
    assert all(r["p_wald"] is None or 0 <= r["p_wald"] <= 1 for r in got.values())
    assert qc.inbreeding(c).count() == c.samples.count() and mixed.GRID[0] == 0


def test_conditional_variance_and_imputation(spark, c):
    from pedlake.operators import models

    rows = c.samples.collect()
    order, phi = models.kinship([(r["iid"], r["pat"], r["mat"]) for r in rows if r["iid"].endswith("0") and len(r["iid"]) == 2])
    at = {k: i for i, k in enumerate(order)}
    inv = np.linalg.inv(phi)
    got = {r["iid"]: r["variance"] for r in related.conditional_variance(c).collect()}
    assert all(abs(got[k] - 1 / inv[i, i]) < 1e-9 for k, i in at.items())
    calls = c.calls.selectExpr("vidx", "iid", "case when iid in ('f0', 'd3') then null else g end g")
    mean = {r["vidx"]: r["m"] for r in calls.where("g is not null").groupBy("vidx").agg({"g": "avg"}).withColumnRenamed("avg(g)", "m").collect()}
    filled = {(r["vidx"], r["iid"]): r["d"] for r in related.impute_relatives(Cohort(c.samples, calls, c.traits, c.variants, c.sets)).collect()}
    g = {(r["vidx"], r["iid"]): r["g"] for r in calls.where("g is not null").collect()}
    gaps = {(r["vidx"], r["iid"]) for r in calls.where("g is null").collect()}
    assert set(filled) == gaps
    for v in (0, 5):
        have = [k for k in order if (v, k) in g]
        i, o = at["f0"], [at[k] for k in have]
        want = mean[v] + phi[i, o] @ np.linalg.pinv(phi[np.ix_(o, o)]) @ (np.array([g[v, k] for k in have]) - mean[v])
        assert abs(filled[v, "f0"] - min(2, max(0, want))) < 1e-9


def test_kinship_of_x(spark, c):
    s = spark.createDataFrame([("f", None, None, 1), ("m", None, None, 2), ("d", "f", "m", 2), ("e", "f", "m", 2), ("s", "f", "m", 1), ("t", "f", "m", 1)], "iid string, pat string, mat string, sex int")
    got = {(r["iid1"], r["iid2"]): r["kinship"] for r in related.kinship_x(Cohort(s, c.calls, c.traits, c.variants, c.sets)).collect()}
    assert got["d", "f"] == 0.5 and got["d", "m"] == 0.25 and got["m", "s"] == 0.5 and ("f", "s") not in got
    assert got["d", "e"] == 0.375 and got["s", "t"] == 0.5 and got["d", "s"] == 0.25 and got["s", "s"] == 1.0 and got["d", "d"] == 0.5
