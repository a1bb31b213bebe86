"""Mixed models over pedigrees, logistic models with covariates, components and pairs of samples against matrices."""

import math

import numpy as np
import pytest

from pedlake.functions import special
from pedlake.operators import mixed, models, related, similarity
from pedlake.operators.cohort import Cohort
from tests.test_models import cohort


@pytest.fixture(scope="module")
def c(spark):
    got = cohort(spark, n_fam=25, n_var=6, seed=8)[0]
    return Cohort(got.samples.cache(), got.calls.cache(), got.traits.cache(), got.variants.cache(), got.sets.cache())


def matrices(c):
    rows = c.samples.collect()
    y = {r["iid"]: r["val"] for r in c.trait("Y").collect()}
    order, phi = models.kinship([(r["iid"], r["pat"], r["mat"]) for r in rows])
    at = {k: i for i, k in enumerate(order)}
    ids = [r["iid"] for r in rows]
    pick = [at[i] for i in ids]
    return ids, phi[np.ix_(pick, pick)], np.array([y[i] for i in ids])


def likelihood(y, x, k, h, reml):
    v = h * k + (1 - h) * np.eye(len(y))
    inv = np.linalg.inv(v)
    b = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
    r = y - x @ b
    n = len(y) - (x.shape[1] if reml else 0)
    rest = r @ inv @ r
    ll = -0.5 * (n * math.log(2 * math.pi * rest / n) + n + np.linalg.slogdet(v)[1] + (np.linalg.slogdet(x.T @ inv @ x)[1] if reml else 0))
    return ll, b, rest, inv


def test_polygenic_model(c):
    ids, k, y = matrices(c)
    x = np.ones((len(y), 1))
    got = mixed.polygenic(c, "Y").first()
    grid = np.linspace(0, 0.999, 400)
    best = max(likelihood(y, x, k, h, True)[0] for h in grid)
    ll, b, rest, _ = likelihood(y, x, k, got["h2"], True)
    assert abs(got["logl"] - ll) < 1e-6 and got["logl"] >= best - 1e-6 and abs(got["effects"]["intercept"] - b[0]) < 1e-8
    assert abs(got["sig2g"] + got["sig2"] - rest / (len(y) - 1)) < 1e-8
    assert mixed.polygenic(Cohort(c.samples, c.calls, c.traits.limit(0), c.variants, c.sets), "Y").count() == 0


def test_mixed_scan(c):
    ids, k, y = matrices(c)
    g = {(r["vidx"], r["iid"]): r["g"] for r in c.called().collect()}
    one = np.ones((len(y), 1))
    rows = {r["vidx"]: r for r in mixed.mixed_scan(c, "Y").collect()}
    assert set(rows) == set(range(6)) and min(rows, key=lambda v: rows[v]["p_wald"]) == 0
    l0 = max(likelihood(y, one, k, h, False)[0] for h in np.linspace(0, 0.999, 1500))
    for v in (0, 3):
        x = np.array([g.get((v, i), np.nan) for i in ids], float)
        x = np.column_stack([one, np.where(np.isnan(x), np.nanmean(x), x) - np.nanmean(x)])
        r = rows[v]
        assert r["h2_reml"] == max(mixed.GRID, key=lambda h: likelihood(y, x, k, h, True)[0])
        _, b, rest, inv = likelihood(y, x, k, r["h2_reml"], True)
        assert abs(r["beta"] - b[1]) < 1e-8
        _, _, full, _ = likelihood(y, one, k, r["h2_reml"], True)
        assert abs(r["stat_wald"] - (full - rest) * (len(y) - 2) / rest) < 1e-6
        l1 = max(likelihood(y, x, k, h, False)[0] for h in mixed.GRID)
        assert abs(r["stat_lrt"] - 2 * (l1 - l0)) < 0.01


def test_variant_blup(c):
    ids, k, y = matrices(c)
    inv = np.linalg.inv(k + 0.7 * np.eye(len(y)))
    w = inv @ y - (inv.sum(0) @ y) / inv.sum() * inv.sum(1)
    at = {i: n for n, i in enumerate(ids)}
    rows = [(r["iid"], r["g"]) for r in c.called().where("vidx = 2").collect()]
    g, u = np.array([x for _, x in rows], float), np.array([w[at[i]] for i, _ in rows])
    p = g.mean() / 2
    got = mixed.variant_blup(c, "Y", 0.7).where("vidx = 2").first()
    assert abs(got["blup"] - u @ (g - 2 * p) / math.sqrt(2 * p * (1 - p))) < 1e-9


def test_logistic_with_covariates(c):
    y = {r["iid"]: float(r["val"] == 2) for r in c.trait("D").collect()}
    cov = {r["iid"]: r["val"] for r in c.trait("C").collect()}
    got = {}
    for r in mixed.logistic_covariates(c, "D", ["C"], interaction=True).collect():
        got.setdefault(r["vidx"], {})[r["term"]] = r
    for v in (1, 3):
        rows = [(r["iid"], r["g"]) for r in c.called().where(f"vidx = {v}").collect()]
        t = np.array([y[i] for i, _ in rows])
        x = np.array([(1.0, cov[i], g, g * cov[i]) for i, g in rows])
        b = np.array([got[v][k]["beta"] for k in ("intercept", "C", "g", "g:C")])
        p = 1 / (1 + np.exp(-x @ b))
        assert np.abs(x.T @ (t - p)).max() < 1e-4  # the score equations hold
        se = np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)))
        assert np.allclose([got[v][k]["stat"] for k in ("intercept", "C", "g", "g:C")], b / se, rtol=1e-4)
    same = mixed.logistic_covariates(Cohort(c.samples, c.calls.where("vidx = 1"), c.traits, c.variants, c.sets), "D", []).collect()
    one = models.logistic(Cohort(c.samples, c.calls.where("vidx = 1"), c.traits, c.variants, c.sets), "D").first()
    assert abs({r["term"]: r["beta"] for r in same}["g"] - one["beta"]) < 1e-6


def test_logistic_without_a_fit(spark, c):
    calls = c.calls.where("vidx = 1").limit(2).unionByName(c.trait("D").selectExpr("7L vidx", "iid", "cast(val - 1 as tinyint) g"))
    got = {(r["vidx"], r["reason"], r["beta"]) for r in mixed.logistic_covariates(Cohort(c.samples, calls, c.traits, c.variants, c.sets), "D", ["C"]).collect()}
    assert got == {(1, "samples", None), (7, "separation", None)}


def test_null_model(c):
    y = {r["iid"]: r["val"] for r in c.trait("Y").collect()}
    cov = {r["iid"]: r["val"] for r in c.trait("C").collect()}
    x = np.array([(1.0, cov[i]) for i in y])
    b, *_ = np.linalg.lstsq(x, np.array(list(y.values())), rcond=None)
    assert np.allclose([r["beta"] for r in mixed.null_model(c, "Y", ["C"]).collect()], b)


def test_components(c):
    got = {r["iid"]: (r["pc1"], r["pc2"]) for r in similarity.principal_scores(c, 2, rounds=25).collect()}
    founders = {r["iid"] for r in c.samples.where("founder").collect()}
    g = {(r["vidx"], r["iid"]): r["g"] for r in c.called().collect()}
    ids = sorted({i for _, i in g})
    x = np.zeros((len(ids), 6))
    for v in range(6):
        f = [g[v, i] for i in ids if i in founders and (v, i) in g]
        p = np.mean(f) / 2
        x[:, v] = [(g[v, i] - 2 * p) / math.sqrt(2 * p * (1 - p)) if (v, i) in g else 0.0 for i in ids]
    _, s, vt = np.linalg.svd(x[[i in founders for i in ids]], full_matrices=False)
    for k in range(2):
        want, have = x @ vt[k], np.array([got[i][k] for i in ids])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-3 * np.abs(want).max()


def test_pairs_in_buckets(c, monkeypatch):
    asked = c.samples.where("iid in ('a0', 'c3')").select("iid")
    one = {(r["iid1"], r["iid2"]): r for r in similarity.similarity(similarity.pair_sums(c, asked)).collect()}
    monkeypatch.setattr(similarity, "BUCKET", 40)
    monkeypatch.setattr(similarity, "VARIANTS", 3)
    two = {(r["iid1"], r["iid2"]): r for r in similarity.similarity(similarity.pair_sums(c, asked)).collect()}
    assert set(one) == set(two) and len(one) == 2 * (c.samples.count() - 1)
    for k in one:
        for x in ("n", "ibs", "hamming", "pearson", "grm", "bn"):
            assert one[k][x] == two[k][x] or abs(one[k][x] - two[k][x]) < 1e-9
    kin = related.kinship_pairs(c)
    check = similarity.relationship_check(c, asked, kin, alpha=1.1, least=4).collect()
    assert {(r["iid1"], r["expected"]) for r in check if r["iid2"] == "a3"} >= {("c3", 0.5)} and all(0 <= r["p"] <= 1 for r in check)
    by = {r["by"]: r for r in similarity.hybrid(c, asked, kin).collect()}
    assert set(by) == {"pedigree", "genotypes"}
    assert float(special.f_sf(0, 1, 5)) == 1.0


def test_pairs_leave_their_task_whole(c, monkeypatch):
    asked = c.samples.where("iid in ('a0', 'c3', 'b1')").select("iid")
    full = similarity.pair_sums(c, asked)
    plan = full._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0]
    want = {tuple(r) for r in similarity.nearest_samples(full, 4).collect()}
    for name, value in (("BUCKET", 25), ("CHUNK", 2), ("AT_ONCE", 30), ("DENSE", 0)):  # no variant through matrices
        monkeypatch.setattr(similarity, name, value)
    assert {tuple(r) for r in similarity.nearest_samples(similarity.pair_sums(c, asked, names=["n", "d0", "d1"], best=4), 4).collect()} == want
    few = {(r["iid1"], r["iid2"]): r["zz"] for r in similarity.pair_sums(c, asked, names=["zz"]).collect()}
    assert set(few) == {(r["iid1"], r["iid2"]) for r in full.collect()} and all(abs(r["zz"] - few[r["iid1"], r["iid2"]]) < 1e-9 for r in full.collect())
