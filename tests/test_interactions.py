import numpy as np

from pedlake.functions import special
from pedlake.operators import family_rare, gene_tests, interactions
from tests.test_models import cohort


def test_haplotype_frequencies_by_em():
    rng = np.random.default_rng(3)
    n, p = 60_000, np.array([0.45, 0.05, 0.1, 0.4])  # ab aB Ab AB
    h = rng.choice(4, (n, 2), p=p)
    g1, g2 = (h >= 2).sum(1), (h % 2).sum(1)
    t = np.zeros((3, 3))
    np.add.at(t, (g1, g2), 1)
    r, r2, d = interactions.haplotype_ld(np.stack([t.ravel(), np.diag([5, 0, 5]).ravel(), np.array([[9, 0, 0], [0, 0, 0], [0, 0, 0]]).ravel()]))
    pa, pb, q = 0.5, 0.45, 0.4 - 0.5 * 0.45
    assert abs(r[0] - q / np.sqrt(pa * (1 - pa) * pb * (1 - pb))) < 0.01 and abs(d[0] - q / min(pa * (1 - pb), pb * (1 - pa))) < 0.01
    assert abs(r2[1] - 1) < 1e-6 and abs(d[1] - 1) < 1e-6 and not np.isfinite(r[2])


def test_no_interaction_gives_a_chi_square():
    rng = np.random.default_rng(8)
    stats = []
    for _ in range(300):
        g1, g2 = rng.binomial(2, 0.4, 800), rng.binomial(2, 0.3, 800)
        case = rng.random(800) < 1 / (1 + np.exp(-(0.5 * g1 - 0.4 * g2)))
        a, u = np.zeros((3, 3)), np.zeros((3, 3))
        np.add.at(a, (g1[case], g2[case]), 1)
        np.add.at(u, (g1[~case], g2[~case]), 1)
        stats.append(interactions.interaction_statistics(a.reshape(1, 9), u.reshape(1, 9))[1][0])
    assert abs(np.mean(stats) - 4) < 0.6 and abs((special.chi2_sf(np.array(stats), 4) < 0.05).mean() - 0.05) < 0.04
    a = np.array([[50, 5, 5], [5, 50, 5], [5, 5, 50]])
    assert interactions.interaction_statistics(a.reshape(1, 9), np.flipud(a).reshape(1, 9))[1][0] > 50


def test_family_tests(spark):
    c, cells, y = cohort(spark, n_fam=40, n_var=10)
    rows = family_rare.family_scores(c, "D", weight=False).where("gene = 'G0'").collect()
    ped = {r["iid"]: (r["pat"], r["mat"]) for r in c.samples.collect()}
    assert rows and all(abs(r["u"] - (cells[r["vidx"], r["iid"]] - sum(cells[r["vidx"], p] for p in ped[r["iid"]]) / 2)) < 1e-12 for r in rows)
    out = {r["gene"]: r for r in family_rare.family_burden(c, "D").collect()}
    w = family_rare.family_scores(c, "D").where("gene = 'G0'").toPandas()
    child = w.groupby("iid")["u"].sum()
    assert abs(out["G0"]["stat_burden"] - child.sum() ** 2 / (child**2).sum()) < 1e-9 and 0 < out["G0"]["p_skat"] <= 1
    vt = {r["gene"]: r for r in family_rare.threshold_tests(c, "Y", 100, rare=0.5).collect()}
    assert vt["G0"]["p_vt"] < 0.05 and vt["G0"]["p_kernel"] < 1e-4 and vt["G1"]["p_kernel"] > 1e-4
    q = {r["gene"]: r for r in gene_tests.joint_scores(c, "Y").collect()}
    assert q["G0"]["p_q2"] < 1e-6 and set(q) == {"G0", "G1"}
