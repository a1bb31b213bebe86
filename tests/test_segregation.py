"""Likelihoods of types against enumeration, and a planted major gene."""

import itertools
import math

import numpy as np
import pytest

from pedlake.operators import segregation as S
from pedlake.operators.cohort import Cohort
from tests.test_models import cohort


def test_types_are_summed_over():
    members = [("a", None, None), ("b", None, None), ("c", "a", "b"), ("d", "a", None)]
    rng = np.random.default_rng(1)
    density, q, tau = rng.random((3, 4, 3)), np.array([0.2, 0.5, 0.7]), np.array([[0, 0.5, 1], [0.1, 0.4, 0.9], [0.3, 0.3, 0.3]])
    got = S.type_likelihoods(members, density, q, tau)
    for k in range(3):
        total = 0.0
        for f in itertools.product(range(2), repeat=8):
            p = 1.0
            for i, (_, pat, mat) in enumerate(members):
                p *= density[k, i, f[2 * i] + f[2 * i + 1]]
                for v, parent in ((2 * i, pat), (2 * i + 1, mat)):
                    j = None if parent is None else [m[0] for m in members].index(parent)
                    up = q[k] if j is None else tau[k, f[2 * j] + f[2 * j + 1]]
                    p *= up if f[v] else 1 - up
            total += p
        assert abs(got[k] - math.log(total)) < 1e-9


def test_pedigrees_of_one_form_come_out_alike():
    one = {"x": ("p", "m"), "m": (None, None), "y": ("p", "m"), "p": (None, None), "z": ("x", None)}
    two = {"A": (None, None), "B": (None, None), "K2": ("B", "A"), "K1": ("B", "A"), "N": ("K2", None)}
    shape = lambda d: [tuple(-1 if p is None else S._ordered(d).index(p) for p in d[k]) for k in S._ordered(d)]
    assert shape(one) == shape(two) == [(-1, -1), (-1, -1), (0, 1), (0, 1), (2, -1)]
    assert S.elimination(tuple(shape(one))) is S.elimination(tuple(shape(two)))


def test_one_mean_is_the_normal_likelihood(spark):
    c, _, y = cohort(spark, n_fam=6, n_var=2)
    r = S.segregation(c, "Y", ("one_mean",)).first()
    v = np.array(list(y.values()))
    best = -0.5 * len(v) * (math.log(2 * math.pi * v.var()) + 1)
    assert best - 0.05 < r["logl"] <= best + 1e-9 and r["n_parameter"] == 2
    assert abs(r["parameters"]["m0"] - v.mean()) < 0.1
    assert S.segregation(Cohort(c.samples, c.calls, c.traits.limit(0), c.variants, c.sets), "Y").count() == 0


@pytest.mark.parametrize("effect", [3.0])
def test_a_major_gene_is_found(spark, effect):
    c, cells, _ = cohort(spark, n_fam=40, n_var=1, seed=9)
    rng = np.random.default_rng(2)
    rows = [(i, "T", "continuous", effect * g + 0.7 * rng.normal()) for (v, i), g in cells.items()]
    d = Cohort(c.samples, c.calls, spark.createDataFrame(rows, "iid string, trait string, kind string, val double"), c.variants, c.sets)
    got = {r["model"]: r for r in S.segregation(d, "T", ("one_mean", "no_transmission", "mendelian")).collect()}
    assert got["mendelian"]["logl"] > got["no_transmission"]["logl"] + 5 and got["mendelian"]["aic"] < got["one_mean"]["aic"]
    assert got["no_transmission"]["logl"] >= got["one_mean"]["logl"] - 0.5
