import math

import numpy as np
import pytest

from pedlake.operators import assoc, filters, gene_tests, genes, models, qc, related, simulate
from pedlake.operators.cohort import Cohort
from pedlake.streaming import counts

PED = [("a", None, None), ("b", None, None), ("c", "a", "b"), ("d", "a", "b"), ("e", None, None), ("f", "c", "e"), ("g", "d", None)]


def cohort(spark, n_fam=30, n_var=20, seed=3):
    """Families of PED with dropped genes, a trait with one real effect and a binary one."""
    ped = [(f"{i}{k}", p and f"{p}{k}", m and f"{m}{k}") for k in range(n_fam) for i, p, m in PED]
    g = simulate.gene_drop(spark, ped, n_var, (0.1, 0.4), seed)
    cells = {(r["vidx"], r["iid"]): r["g"] for r in g.collect()}
    rng = np.random.default_rng(seed)
    rows = [(i, f"F{i[1:]}", p, m, 1 + n % 2, f"P{n % 3}", 1.0 + n % 2, p is None and m is None) for n, (i, p, m) in enumerate(ped)]
    y = {i: 2.0 * cells[0, i] + rng.normal() for i, _, _ in ped}
    traits = [(i, "Y", "continuous", v) for i, v in y.items()] + [(i, "C", "continuous", float(n % 5)) for n, i in enumerate(y)] + [(i, "D", "binary", 2.0 if v > 1.5 else 1.0) for i, v in y.items()]
    c = Cohort(
        spark.createDataFrame(rows, "iid string, fid string, pat string, mat string, sex tinyint, pop string, weight double, founder boolean"),
        spark.createDataFrame([(v, i, None if (v * 7 + len(i)) % 11 == 0 and i.startswith("g") else x) for (v, i), x in cells.items()], "vidx long, iid string, g tinyint"),
        spark.createDataFrame(traits, "iid string, trait string, kind string, val double"),
        spark.createDataFrame([(v, 1 + v % 2, f"v{v}", 1000 * v + 1, "A", "G", 50.0, "PASS", None, {"AF": "0.2"}) for v in range(n_var)], "vidx long, chrom int, id string, pos int, major string, minor string, qual double, filt string, anno string, info map<string,string>"),
        spark.createDataFrame([(f"G{v // 5}", v) for v in range(n_var)], "gene string, vidx long"),
    )
    return c, cells, y


@pytest.fixture(scope="module")
def data(spark):
    c, cells, y = cohort(spark)
    return Cohort(c.samples.cache(), c.calls.cache(), c.traits.cache(), c.variants.cache(), c.sets.cache()), cells, y


def design(c, cells, y, v):
    rows = [(r["iid"], r["g"]) for r in c.calls.where(f"vidx = {v} and g is not null").collect()]
    return np.array([g for _, g in rows], float), np.array([y[i] for i, _ in rows]), [i for i, _ in rows]


def test_regression(data):
    c, cells, y = data
    g, t, ids = design(c, cells, y, 3)
    x = np.column_stack([np.ones(len(g)), g])
    b, *_ = np.linalg.lstsq(x, t, rcond=None)
    got = assoc.linear_test(c, "Y").where("vidx = 3").first()
    s2 = ((t - x @ b) ** 2).sum() / (len(g) - 2)
    assert abs(got["beta"] - b[1]) < 1e-9 and abs(got["se"] - math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])) < 1e-9
    assert assoc.linear_test(c, "Y").orderBy("p_regr").first()["vidx"] == 0
    cov = {r["iid"]: r["val"] for r in c.trait("C").collect()}
    x = np.column_stack([x[:, 0], [cov[i] for i in ids], g, g * np.array([cov[i] for i in ids])])
    b, *_ = np.linalg.lstsq(x, t, rcond=None)
    rows = {r["term"]: r["beta"] for r in models.linear_covariates(c, "Y", ["C"], interaction=True).where("vidx = 3").collect()}
    assert np.allclose([rows[k] for k in ("intercept", "C", "g", "g:C")], b)


def test_logistic_solves_the_score_equations(data):
    c, cells, y = data
    r = models.logistic(c, "D").orderBy("p_regr").first()
    assert r["vidx"] == 0 and r["beta"] > 1
    g, t, ids = design(c, cells, y, 0)
    d = (t > 1.5).astype(float)
    b0 = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(b0 + r["beta"] * g)))
        b0 += (d - p).sum() / (p * (1 - p)).sum()
    assert abs(((d - p) * g).sum()) < 1e-4


def test_adjustment(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random(700), rng.random(30) / 1e4, [0.5, 0.5, 1.0]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(9999, None)], "vidx long, p double")
    got = {r["vidx"]: r for r in assoc.adjust(df).collect()}
    order, m = np.lexsort((np.arange(len(p)), p)), len(p)
    q, i = p[order], np.arange(1, m + 1)
    want = {"holm": np.minimum(1, np.maximum.accumulate((m - i + 1) * q)), "sidak_sd": np.maximum.accumulate(1 - (1 - q) ** (m - i + 1)), "bh": np.minimum(1, np.minimum.accumulate((m * q / i)[::-1])[::-1]), "bonferroni": np.minimum(1, m * q)}
    want["by"] = np.minimum(1, np.minimum.accumulate((m * q / i * (1 / i).sum())[::-1])[::-1])
    assert len(got) == m and [got[k]["rank"] for k in order] == i.tolist()
    for name, w in want.items():
        assert np.allclose([got[k][name] for k in order], w), name
    assert assoc.adjust(df.limit(0)).count() == 0


def test_kinship():
    order, phi = models.kinship(PED)
    k = lambda a, b: phi[order.index(a), order.index(b)]
    assert (k("a", "a"), k("a", "b"), k("c", "a"), k("c", "d"), k("f", "d"), k("f", "g")) == (1, 0, 0.5, 0.5, 0.25, 0.125)
    order, phi = models.kinship([("s", None, None), ("t", "s", None), ("u", "s", "t")])
    assert phi[order.index("u"), order.index("u")] == 1.25
    with pytest.raises(ValueError):
        models.kinship([("a", "b", None), ("b", "a", None)])


def test_kinship_weights(spark, data):
    c, cells, y = data
    rows = {r["iid"]: r for r in related.kinship_weights(c, c.trait("Y")).collect()}
    ids = [i + "0" for i, *_ in PED]
    order, phi = models.kinship([(i + "0", p and p + "0", m and m + "0") for i, p, m in PED])
    sub = phi[np.ix_([order.index(i) for i in ids], [order.index(i) for i in ids])]
    assert np.allclose(np.linalg.solve(sub, [y[i] for i in ids]), [rows[i]["a"] for i in ids])
    assert np.allclose(np.linalg.solve(sub, np.ones(len(ids))), [rows[i]["one"] for i in ids])
    pairs = {(r["iid1"], r["iid2"]): r["kinship2"] for r in related.kinship_pairs(c).collect()}
    assert pairs["c0", "d0"] == 0.5 and ("a0", "b0") not in pairs and len(pairs) == 30 * (np.tril(phi) != 0).sum()


def test_kinship_scores_reduce_to_plain_ones(spark, data):
    c, *_ = data
    lone = Cohort(c.samples.selectExpr("iid", "fid", "cast(null as string) pat", "cast(null as string) mat", "sex", "pop", "weight", "true founder"), c.calls, c.traits, c.variants, c.sets)
    a = {r["vidx"]: r["stat"] for r in related.qls_kinship(lone, "Y").where("vidx in (0, 1, 2)").collect()}
    b = {r["vidx"]: r["stat"] for r in assoc.qls(lone, "Y").where("vidx in (0, 1, 2)").collect()}
    assert all(abs(a[k] - b[k]) < 0.1 * abs(b[k]) + 0.05 for k in b)
    p = {r["vidx"]: r["p_blue"] for r in related.blue_freq(lone).collect()}
    f = {r["vidx"]: r["mac_raw"] / (2 * r["nind"]) for r in qc.allele_freq(lone).collect()}
    assert all(abs(p[k] - f[k]) < 1e-9 for k in f)
    assert related.mqls(c, "D").orderBy("p_mqls").first()["vidx"] == 0


def test_relationship_and_mixed_model(data):
    c, cells, y = data
    ids = sorted(y)[:60]
    k = models.relationship(c, ids)
    assert np.allclose(k, k.T) and abs(np.diag(k).mean() - 1) < 0.3
    order, phi = models.kinship([(i + "0", p and p + "0", m and m + "0") for i, p, m in PED])
    rng = np.random.default_rng(1)
    big = np.kron(np.eye(120), phi)
    u = np.linalg.cholesky(big + 1e-9 * np.eye(len(big))) @ rng.normal(size=len(big))
    h = models.heritability(u * math.sqrt(0.7) + rng.normal(size=len(big)) * math.sqrt(0.3), big)
    assert 0.5 < h["h2"] < 0.9
    out = models.mixed_scan(c, y, np.eye(60) * 1.0, ids).collect()
    assert min(out, key=lambda r: r["p_wald"])["vidx"] == 0
    val, pc = models.principal_components(k, 3)
    assert pc.shape == (60, 3) and (np.diff(val) <= 1e-9).all() and np.allclose(pc.sum(0), 0, atol=1e-6)


def test_gene_tests(data):
    c, *_ = data
    rows = {r["gene"]: r for r in gene_tests.skat(c, "Y", rare=0.5).collect()}
    assert min(rows, key=lambda k: rows[k]["p_skat"]) == "G0" and all(0 <= r["p_skat"] <= 1 for r in rows.values())
    w = {r["gene"]: r for r in related.weighted_sum(c, "D", 200, rare=0.5).collect()}
    assert set(w) == {f"G{i}" for i in range(4)} and min(w, key=lambda k: w[k]["p_wsum"]) == "G0"
    path = related.lasso(c, "Y").where("gene = 'G0'").collect()
    assert max(path, key=lambda r: abs(r["beta"]))["vidx"] == 0


def test_prune_against_a_loop(spark, data):
    c, cells, _ = data
    twin = c.calls.where("vidx = 4").selectExpr("100L vidx", "iid", "g").unionByName(c.calls.where("vidx = 4").selectExpr("102L vidx", "iid", "cast(2 - g as tinyint) g"))
    more = c.variants.where("vidx = 4").selectExpr("100L vidx", "chrom", "'x' id", "pos + 1 pos", "major", "minor", "qual", "filt", "anno", "info").unionByName(c.variants.where("vidx = 4").selectExpr("102L vidx", "chrom", "'y' id", "pos + 2 pos", "major", "minor", "qual", "filt", "anno", "info"))
    d = Cohort(c.samples, c.calls.unionByName(twin), c.traits, c.variants.unionByName(more), c.sets)
    kept = {r["vidx"] for r in related.prune(d, window=3, step=1, r2=0.9).collect()}
    assert kept == set(range(20))


def test_thinning_and_ranks(spark, data):
    c, _, y = data
    rng = np.random.default_rng(2)
    pos = [(i, 1 + i % 2, int(x)) for i, x in enumerate(rng.integers(0, 3000, 200))]
    got = {r["vidx"] for r in filters.thin(spark.createDataFrame(pos, "vidx long, chrom int, pos int"), 40).collect()}
    want, last = set(), {}
    for v, ch, p in sorted(pos, key=lambda r: (r[1], r[2], r[0])):
        if ch not in last or p - last[ch] > 40:
            want.add(v)
            last[ch] = p
    assert got == want
    z = {r["iid"]: (r["rank"], r["z"]) for r in related.inverse_normal(c, "Y").collect()}
    order = sorted(y, key=lambda i: (y[i], i))
    assert [z[i][0] for i in order] == list(range(1, len(y) + 1)) and abs(sum(v for _, v in z.values())) < 1e-6


def test_phase_known_linkage(spark):
    ped = [("gf", None, None), ("gm", None, None), ("p", "gf", "gm"), ("q", None, None)] + [(f"k{i}", "p", "q") for i in range(6)]
    g = {"gf": (2, 2), "gm": (0, 0), "p": (1, 1), "q": (0, 0), **{f"k{i}": (i % 2, i % 2 if i else 1) for i in range(6)}}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    c = Cohort(
        make([(i, "F", a, b, 1, None, 1.0, a is None) for i, a, b in ped], "iid string, fid string, pat string, mat string, sex tinyint, pop string, weight double, founder boolean"),
        make([(v, i, x[v]) for i, x in g.items() for v in (0, 1)], "vidx long, iid string, g tinyint"), make([], "iid string, trait string, kind string, val double"),
        make([(0, 1, 10), (1, 1, 20)], "vidx long, chrom int, pos int"), make([], "gene string, vidx long"),
    )
    r = {x["theta"]: x for x in related.linkage(c).collect()}
    assert (r[0.1]["n_rec"], r[0.1]["n_non"]) == (1, 5) and r[0.0]["lod"] is None
    assert abs(r[0.1]["lod"] - simulate.lod(1, 5, 0.1)) < 1e-12


def test_mendel_table(spark):
    bad = {(0, 0): {1, 2}, (0, 1): {2}, (0, 2): {0, 2}, (1, 1): set(), (1, 2): {0}, (2, 2): {0, 1}, (0, None): {2}, (2, None): {0}, (1, None): set()}
    cases = [(a, b, k) for a, b in [*bad, *((y, x) for x, y in bad)] for k in (0, 1, 2)]
    ped, cells = [], []
    for n, (a, b, k) in enumerate(cases):
        ped += [(f"p{n}", None, None), (f"m{n}", None, None), (f"k{n}", f"p{n}", f"m{n}")]
        cells += [(0, f"p{n}", a), (0, f"m{n}", b), (0, f"k{n}", k)]
    c = Cohort(spark.createDataFrame([(i, "F", p, m, 1, None, 1.0, p is None) for i, p, m in ped], "iid string, fid string, pat string, mat string, sex tinyint, pop string, weight double, founder boolean"), spark.createDataFrame(cells, "vidx long, iid string, g tinyint"), None, None, None)
    got = {r["iid"]: r["error"] for r in qc.mendel_cells(c).collect()}
    assert got == {f"k{n}": k in bad.get((a, b), bad.get((b, a))) for n, (a, b, k) in enumerate(cases)}


def test_simulation_and_power(spark):
    a = simulate.gene_drop(spark, PED, 30, seed=5)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, simulate.gene_drop(spark, PED, 30, seed=5).repartition(3).collect())) and len(rows) == 210
    p = [r["power"] for r in simulate.power_range(spark, [50, 200, 800], 0.3, 0.3, 0.5).orderBy("n").collect()]
    assert p == sorted(p) and p[-1] > 0.95 and abs(simulate.power(100, 0.0, 0.3, 0.5) - 0.05) < 1e-6
    assert simulate.effective_samples(np.eye(5)) == 5 and abs(simulate.effective_samples(np.ones((4, 4))) - 1) < 1e-9
    perm = simulate.permutations(spark.createDataFrame([("a",), ("b",), ("a",)], "iid string"), "iid", 3)
    assert perm.count() == 6


def test_streams(spark, tmp_path):
    path = str(tmp_path / "calls")
    spark.createDataFrame([(0, 1), (0, 2), (1, None), (1, 0)], "vidx long, g tinyint").write.parquet(path)
    like = spark.read.parquet(path)
    q = counts.allele_counts(counts.stream_of(spark, path, like)).writeStream.outputMode("complete").format("memory").queryName("alleles").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.sql("select vidx, a, n from alleles").collect())) == [(0, 3, 2), (1, 0, 1)]
    finally:
        q.stop()
    ev = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 1L user_id, 'x' event_type, 2.0D value union all select timestamp'2024-01-01 00:50:00', 1L, 'x', 3.0D union all select timestamp'2024-01-01 01:50:00', 1L, 'y', null")
    assert sorted((r["event_type"], r["n"], r["total"]) for r in counts.event_windows(ev).collect()) == [("x", 2, 5.0), ("y", 1, None)]
    assert sorted(r["n"] for r in counts.sessions(ev, "45 minutes").collect()) == [1, 2]


def test_filters(spark, data):
    c, *_ = data
    v = filters.filtered_variants(c, chromosomes=[1], expr="AF > 0.1", name_regex="v[02468]")
    got = {r["vidx"]: r["reasons"] for r in v.collect()}
    assert got[0] == ["expression"] and got[1] == ["chromosome", "expression", "name"]
    assert filters.keep(filters.reasons(c.variants, filters.variant_rules(chromosomes=[1]))).count() == 10
    names = spark.createDataFrame([(1,), (1,), (99,)], "vidx long")
    assert filters.select(c.variants, "vidx", names).count() == 1 and filters.select(c.variants, "vidx", names, drop=True).count() == 19
    masked = filters.mask(c.calls, spark.createDataFrame([("a0",)], "iid string"))
    assert masked.where("iid = 'a0' and g is not null").count() == 0 and masked.count() == c.calls.count()
    assert filters.update(c.variants, spark.createDataFrame([(1, "new")], "vidx long, id string"), "vidx", "id").where("id = 'new'").count() == 1
    assert filters.recode_alleles(c.variants, "flip").first()["major"] == "T"
    n = filters.keep(filters.reasons(c.samples, filters.sample_rules(sexes=[1], founders=True))).count()
    assert n == c.samples.where("sex = 1 and founder").count()
    r = spark.createDataFrame([(1, 0, 2001), (1, 1000, 3000), (2, 5000, 4000)], "chrom int, start int, end int")
    assert sorted(x["vidx"] for x in filters.in_regions(c.variants, r).collect()) == [0, 2]


@pytest.mark.parametrize("loops", [False, True])
def test_large_pedigrees_have_all_their_kinship(spark, monkeypatch, loops):
    rng = np.random.default_rng(4)
    rows = [(f"p{i}", None, None) for i in range(4)] + [("s", "p0", "p0"), ("o", "ghost", "p1")]
    for i in range(16):
        a, b = rng.choice(len(rows), 2, replace=False)
        rows.append((f"c{i}", rows[a][0], rows[b][0] if rng.random() < 0.8 else None))
    rows += [("x", "y", "p2"), ("y", "x", None)] if loops else []
    rows += [("z1", "z2", None), ("z2", None, None), ("lone", None, None)]
    values = spark.createDataFrame([(i, float(rng.normal())) for i, *_ in rows if rng.random() < 0.6], "iid string, val double")
    c = Cohort(spark.createDataFrame(rows, "iid string, pat string, mat string"), None, None, None, None)
    pairs = lambda: sorted(map(tuple, related.kinship_pairs(c).collect()))
    weights = lambda: sorted(map(tuple, related.kinship_weights(c, values).collect()))
    want, want_w = pairs(), weights()
    monkeypatch.setattr(related, "MOST_MEMBERS", 5)
    got, got_w = pairs(), weights()
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    assert [r[0] for r in got_w] == [r[0] for r in want_w] and np.allclose([r[1:] for r in got_w], [r[1:] for r in want_w])


def test_prune_steps(spark, data):
    """Windows that start every ``step`` variants, against a loop over all windows."""
    c, cells, _ = data
    founders = [r["iid"] for r in c.samples.where("founder").collect()]
    calls = {(r["vidx"], r["iid"]): r["g"] for r in c.calls.where("g is not null").collect()}
    for window, step, r2 in ((4, 2, 0.02), (5, 5, 0.01), (6, 1, 0.03)):
        gone = set()
        for chrom in (1, 2):
            order = [v for v in range(20) if 1 + v % 2 == chrom]
            judged = set()
            for s in range(0, len(order), step):
                inside = order[s : s + window]
                for i, a in enumerate(inside):
                    for b in inside[i + 1 :]:
                        both = [(calls[a, f], calls[b, f]) for f in founders if (a, f) in calls and (b, f) in calls]
                        x, y = np.array(both, float).T
                        if (a, b) not in judged and a not in gone and b not in gone and x.std() > 0 and y.std() > 0 and np.corrcoef(x, y)[0, 1] ** 2 > r2:
                            gone.add(b)
                        judged.add((a, b))
        assert {r["vidx"] for r in related.prune(c, window, step, r2).collect()} == set(range(20)) - gone and gone


def test_mqls_of_relatives(spark, data):
    """Against the matrix formula on all called samples."""
    c, cells, y = data
    full = Cohort(c.samples, c.calls.where("vidx in (0, 3)").na.fill(1, ["g"]), c.traits, c.variants, c.sets)
    ids = [r["iid"] for r in c.samples.collect()]
    order, phi = models.kinship([(r["iid"], r["pat"], r["mat"]) for r in c.samples.collect()])
    at = {k: i for i, k in enumerate(order)}
    phi = phi[np.ix_([at[i] for i in ids], [at[i] for i in ids])]
    a = np.array([1.0 if y[i] > 1.5 else -1 / 9 for i in ids])
    h = np.linalg.solve(phi, np.ones(len(ids)))
    for v in (0, 3):
        called = {r["iid"]: r["g"] for r in full.calls.where(f"vidx = {v}").collect()}
        g = np.array([called[i] for i in ids], float)
        p = h @ g / h.sum()
        t = (a @ g - p * a.sum()) / math.sqrt((a @ phi @ a - a.sum() ** 2 / h.sum()) * p * (1 - p / 2))
        assert abs(related.mqls(full, "D").where(f"vidx = {v}").first()["stat"] - t) < 1e-9


def test_fits_that_do_not_exist_keep_a_row(spark, data):
    c, _, _ = data
    few = Cohort(c.samples, c.calls.where("vidx = 1").selectExpr("900L vidx", "iid", "cast(0 as tinyint) g").unionByName(c.calls.where("vidx = 1").limit(2)), c.traits, c.variants, c.sets)
    got = {r["vidx"]: (r["reason"], r["beta"]) for r in models.logistic(few, "D").collect()}
    assert got[900] == ("groups", None) and set(got) == {1, 900}
    rows = {(r["vidx"], r["term"]): (r["reason"], r["beta"], r["stat"]) for r in models.linear_covariates(few, "Y", ["C"]).collect()}
    assert rows[900, "g"] == ("collinear", None, None) and rows[1, "g"] == ("samples", None, None)


def test_relationship_counts_zeros(spark, data):
    """A heterozygote at frequency one half is zero, yet called."""
    c, _, _ = data
    ids = ["a0", "b0", "e0", "a1"]
    calls = spark.createDataFrame([(0, i, g) for i, g in zip(ids, (0, 1, 1, 2))] + [(1, i, g) for i, g in zip(ids, (0, 2, 0, 2))], "vidx long, iid string, g tinyint")
    k = models.relationship(Cohort(c.samples, calls, c.traits, c.variants, c.sets), ids)
    x = np.array([[(g - 1) / math.sqrt(0.5) for g in row] for row in ((0, 1, 1, 2), (0, 2, 0, 2))])
    assert np.allclose(k, x.T @ x / 2)
