"""Moments over buckets, kernel mixtures, family-based scores and patterns against brute force."""

import numpy as np
import pandas as pd
import pytest

from pedlake.functions import special
from pedlake.operators import blocks, gene_tests, models
from pedlake.operators.cohort import Cohort
from tests.test_models import cohort


@pytest.fixture(scope="module")
def c(spark):
    got = cohort(spark, n_fam=20, n_var=10)[0]
    return Cohort(got.samples.cache(), got.calls.cache(), got.traits.cache(), got.variants.cache(), got.sets.cache())


def dense(c, variants, trait="Y"):
    y = {r["iid"]: r["val"] for r in c.trait(trait).collect()}
    g = {(r["vidx"], r["iid"]): r["g"] for r in c.called().collect()}
    ids = sorted(i for i in y if any((v, i) in g for v in variants))
    x = np.array([[g.get((v, i), np.nan) for v in variants] for i in ids], float)
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    t = np.array([y[i] for i in ids])
    return ids, x - x.mean(0), t - t.mean()


def test_moments_over_buckets(c, monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET", 30)
    seen = lambda gene, v, n, xx, xy, yy, mean: pd.DataFrame([(gene, n, xx.ravel().tolist(), np.ravel(xy).tolist(), np.ravel(yy).tolist())], columns=["gene", "n", "xx", "xy", "yy"])
    schema = "gene string, n int, xx array<double>, xy array<double>, yy array<double>"
    got = {r["gene"]: r for r in blocks.moments(c.called(), c.sets, c.trait("Y"), seen, schema).collect()}
    for k in (0, 1):
        ids, x, t = dense(c, range(5 * k, 5 * k + 5))
        r = got[f"G{k}"]
        assert r["n"] == len(ids) and np.allclose(r["xx"], (x.T @ x).ravel()) and np.allclose(r["xy"], x.T @ t) and np.allclose(r["yy"], [t @ t])
    two = c.trait("Y").join(c.trait("C").withColumnRenamed("val", "other"), "iid")
    r = blocks.moments(c.called(), c.sets, two, seen, schema).where("gene = 'G0'").first()
    _, x, t = dense(c, range(5))
    _, _, s = dense(c, range(5), "C")
    assert np.allclose(np.reshape(r["xy"], (5, 2)), x.T @ np.column_stack([t, s])) and np.allclose(np.reshape(r["yy"], (2, 2)), [[t @ t, t @ s], [t @ s, s @ s]])


@pytest.mark.parametrize("whole", [20, 1 << 18])
def test_moments_of_genes_whole_and_in_parts(c, monkeypatch, whole):
    monkeypatch.setattr(blocks, "WHOLE", whole)
    seen = lambda gene, v, n, xx, xy, yy, mean: [(gene, n, xx.ravel().tolist(), np.ravel(xy).tolist())]
    got = blocks.moments(c.called(), c.sets, c.trait("Y"), seen, "gene string, n int, xx array<double>, xy array<double>").collect()
    for r in got:
        k = int(r["gene"][1:])
        ids, x, t = dense(c, range(5 * k, 5 * k + 5))
        assert r["n"] == len(ids) and np.allclose(r["xx"], (x.T @ x).ravel()) and np.allclose(r["xy"], x.T @ t)
    assert len(got) == 2


def test_cells_of_samples_with_few_calls():
    rng = np.random.default_rng(8)
    si, vi = np.repeat(np.arange(3000), 2), np.column_stack([rng.permuted(np.arange(60)[None, :].repeat(3000, 0), axis=1)[:, :2]]).ravel()
    g = rng.integers(-1, 3, len(si))
    x = np.full((3000, 60), -1)
    x[si, vi] = g
    y, here = np.maximum(x, 0), (x >= 0).astype(int)
    assert all(np.array_equal(a, b) for a, b in zip(blocks._cells(si, vi, g, 3000, 60), (y.T @ y, y.T @ here, here.T @ here)))


def test_pair_tables(c, monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET", 30)
    d = {r["iid"]: r["val"] for r in c.trait("D").collect()}
    g = {(r["vidx"], r["iid"]): r["g"] for r in c.called().collect()}
    rows = blocks.pair_tables(c, "D").collect()
    assert len(rows) == 20
    for r in rows[:6]:
        for i, j in blocks.CELLS:
            for s, value in (("a", 2.0), ("u", 1.0)):
                assert r[f"{s}{i}{j}"] == sum(g.get((r["vidx1"], k)) == i and g.get((r["vidx2"], k)) == j for k in d if d[k] == value)


@pytest.mark.parametrize("whole", [20, 1 << 18])
def test_pair_tables_whole_and_in_parts(c, monkeypatch, whole):
    want = {(r["gene"], r["vidx1"], r["vidx2"]): r for r in blocks.pair_tables(c, "D").collect()}
    monkeypatch.setattr(blocks, "WHOLE", whole)
    asked = c.variants.where("vidx in (1, 7)")
    few = c.calls.where("pmod(hash(iid), 9) = vidx % 9")  # a call or two a sample
    for calls in (c.calls, few):
        d = Cohort(c.samples, calls, c.traits, c.variants, c.sets)
        rows = blocks.pair_tables(d, "D", queries=asked).collect()
        g, y = {(r["vidx"], r["iid"]): r["g"] for r in d.called().collect()}, {r["iid"]: r["val"] for r in c.trait("D").collect()}
        for r in rows:
            shared = [k for k in y if (r["vidx1"], k) in g and (r["vidx2"], k) in g]
            assert shared and r["vidx1"] in (1, 7)
            assert all(r[f"a{i}{j}"] == sum(y[k] == 2.0 and (g[r["vidx1"], k], g[r["vidx2"], k]) == (i, j) for k in shared) for i, j in blocks.CELLS)
    assert {(r["gene"], r["vidx1"], r["vidx2"]): r for r in blocks.pair_tables(c, "D").collect()} == want


def test_optimal_mixture_against_draws():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(6, 6))
    cov = a @ a.T + np.eye(6)
    root = np.linalg.cholesky(cov)
    # p-values of null scores are uniform; a strong burden is found
    ps = np.array([gene_tests.skat_o(root @ rng.normal(size=6), cov)[0] for _ in range(300)])
    assert abs(ps.mean() - 0.5) < 0.08 and abs((ps < 0.1).mean() - 0.1) < 0.06
    assert gene_tests.skat_o(cov @ np.ones(6) * 0.9, cov)[0] < 1e-3
    lam = np.array([3.0, 1.0, 0.5])
    for q in (5.0, 15.0, 40.0):
        p = special.davies_sf(q, lam)
        assert abs(special.saddlepoint_sf(q, lam) / p - 1) < 0.1 and abs(special.liu_sf(gene_tests._liu_quantile(p, lam), lam) - p) < 1e-9


def test_family_based_scores(c):
    """Against matrices of all samples, who are called throughout."""
    full = Cohort(c.samples, c.calls.na.fill(1, ["g"]), c.traits, c.variants, c.sets)
    ids, x, _ = dense(full, range(5))
    y = {r["iid"]: r["val"] for r in c.trait("Y").collect()}
    t = np.array([y[i] for i in ids])
    order, phi = models.kinship([(r["iid"], r["pat"], r["mat"]) for r in c.samples.collect()])
    at = {k: i for i, k in enumerate(order)}
    inv = np.linalg.inv(phi[np.ix_([at[i] for i in ids], [at[i] for i in ids])])
    w = inv @ t - (inv.sum(0) @ t) / inv.sum() * inv.sum(1)
    scale = w @ np.linalg.solve(inv, w)
    psi = x.T @ x / (len(ids) - 1)
    r = gene_tests.multi_trait_scores(full, ["Y"], full.sets).where("gene = 'G0'").first()
    u = x.T @ w
    assert abs(r["stat_mfqls"] - u @ np.linalg.solve(scale * psi, u)) < 1e-6 and r["df"] == 5
    r = gene_tests.pedcmc(full, "Y", rare=0.0).where("gene = 'G0'").first()
    assert abs(r["stat_pedcmc"] - u @ np.linalg.solve(scale * psi, u)) < 1e-6
    rows = {r["gene"]: r for r in gene_tests.family_kernels(full, "Y", rare=0.5).collect()}
    assert rows["G0"]["p_skato"] < rows["G1"]["p_skato"] and all(0 <= r["p_skato"] <= 1 for r in rows.values())
    vt = {r["gene"]: r for r in gene_tests.family_threshold(full, "Y", rare=0.5).collect()}
    assert vt["G0"]["p_famvt"] < 0.01 < vt["G1"]["p_famvt"]


def test_correlated_maximum():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4, 9))
    corr = np.corrcoef(a)
    z = np.abs(np.linalg.cholesky(corr) @ rng.normal(size=(4, 400_000))).max(0)
    for x in (1.0, 2.0, 3.0):
        assert abs(special.normal_max_sf(x, corr) - (z >= x).mean()) < 0.004
    assert abs(special.normal_max_sf(2.0, np.eye(1)) - 2 * special.norm_sf(2.0)) < 1e-12


def test_patterns(c):
    d = {r["iid"]: r["val"] for r in c.trait("D").collect()}
    rows = gene_tests.pattern_counts(c, "D", rare=0.5).where("gene = 'G0'").collect()
    assert sum(r["n_case"] + r["n_control"] for r in rows) <= len(d) and len({r["pattern"] for r in rows}) == len(rows)
    got = {r["gene"]: r["p_kbac"] for r in gene_tests.kbac(c, "D", 0.5, 200).collect()}
    assert set(got) == {"G0", "G1"} and got["G0"] < 0.05


def test_rank_and_exact_tests():
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, 300), rng.normal(0.5, 1, 200)
    assert special.ks_p(x, y)[1] < 0.01 < special.ks_p(x, x[::-1])[1] and special.rank_sum_p(x, y)[1] < 1e-4
    assert abs(special.fisher_exact_2x3_p([[3, 0, 0], [0, 2, 0]]) - special.fisher_exact_p(3, 0, 0, 2)) < 1e-12
    assert abs(special.integrate(lambda t: np.exp(-t * t / 2) / np.sqrt(2 * np.pi), 0, 8) - 0.5) < 1e-9
    assert abs(special.least_at(lambda t: (t - 1.234567) ** 2, -3, 9) - 1.234567) < 1e-6
