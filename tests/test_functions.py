import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedlake.functions import special as S
from pedlake.functions.predicates import expression, in_range, in_ranges, info
from pedlake.functions.stats import chi2_p, fisher_exact, hwe_exact, norm_quantile, t_p, z_p


def test_tails_at_known_values():
    assert abs(float(S.chi2_sf(3.841458820694124, 1)) - 0.05) < 1e-12
    assert abs(float(S.chi2_sf(50.0, 2)) - math.exp(-25)) < 1e-20
    assert np.allclose(S.chi2_sf([0.0, 2.0], [3, 2]), [1.0, math.exp(-1)])
    assert abs(float(S.t_sf2(2.228138852, 10)) - 0.05) < 1e-8
    assert abs(float(S.f_sf(4.964602744, 1, 10)) - 0.05) < 1e-8
    assert np.allclose(S.norm_quantile([0.975, 0.5]), [1.959963984540054, 0.0])
    assert abs(1 - S.ncx2_cdf(3.841458820694124, 1, 7.8489) - 0.8) < 1e-3
    assert abs(S.ncx2_cdf(3.0, 2, 0.0) - (1 - math.exp(-1.5))) < 1e-12


def test_exact_tests():
    assert abs(S.fisher_exact_p(3, 1, 1, 3) - 34 / 70) < 1e-12
    assert S.hwe_exact_p(5, 0, 0) == 1.0 and math.isnan(S.hwe_exact_p(0, 0, 0))
    n = 12
    for rare in range(n + 1):
        rows = [((2 * n - rare - h) // 2, h, (rare - h) // 2) for h in range(rare % 2, rare + 1, 2)]
        w = [math.factorial(n) * 2**h / (math.factorial(a) * math.factorial(h) * math.factorial(b)) for a, h, b in rows]
        for (a, h, b), x in zip(rows, w):
            assert abs(S.hwe_exact_p(a, h, b) - sum(y for y in w if y <= x * (1 + 1e-9)) / sum(w)) < 1e-9
            assert abs(S.hwe_exact_p(a, h, b) - S.hwe_exact_p(b, h, a)) < 1e-12


def test_mixture_of_chi_squares():
    w = np.ones(3)
    for q in (0.5, 3.0, 9.0):
        assert abs(S.davies_sf(q, w) - float(S.chi2_sf(q, 3))) < 2e-4 and abs(S.liu_sf(q, w) - float(S.chi2_sf(q, 3))) < 1e-9
    rng = np.random.default_rng(1)
    w = np.array([3.0, 1.0, 0.5])
    draws = (rng.standard_normal((200_000, 3)) ** 2) @ w
    assert abs(S.davies_sf(8.0, w) - (draws > 8).mean()) < 0.005


def test_columns(spark):
    df = spark.createDataFrame([(3, 1, 1, 3, 3.841458820694124, 0.975), (None, 1, 1, 1, None, 0.5)], "a int, b int, c int, d int, x double, p double")
    r = df.select(fisher_exact("a", "b", "c", "d").alias("f"), hwe_exact("a", "b", "c").alias("h"), chi2_p("x", 1).alias("x"), z_p("x").alias("z"), t_p("x", F.lit(10.0)).alias("t"), norm_quantile("p").alias("q")).collect()
    assert abs(r[0]["f"] - 34 / 70) < 1e-9 and abs(r[0]["x"] - 0.05) < 1e-9 and abs(r[0]["q"] - 1.959964) < 1e-5
    assert r[1]["f"] is None and r[1]["h"] is None and r[1]["x"] is None and r[1]["z"] is None and r[1]["t"] is None


def values(spark, column):
    df = spark.createDataFrame([(x, {"AF": str(x), "T": "a"}) for x in (0.5, 1.0, 2.0, 3.0, None)], "x double, info map<string,string>")
    return [r["v"] for r in df.select(column.alias("v")).collect()]


@pytest.mark.parametrize(
    "text,want",
    [("[1,2]", (0, 1, 1, 0)), ("(1,2]", (0, 0, 1, 0)), ("[1,2)", (0, 1, 0, 0)), ("(1,)", (0, 0, 1, 1)), ("[,1]", (1, 1, 0, 0)), (">1", (0, 0, 1, 1)), ("=<1", (1, 1, 0, 0)), ("1~2", (0, 1, 1, 0)), ("2", (0, 0, 1, 0)), ("<1K", (1, 1, 1, 1))],
)
def test_ranges(spark, text, want):
    assert values(spark, in_range(F.col("x"), text)) == [*map(bool, want), None]


def test_range_lists(spark):
    assert values(spark, in_ranges(F.col("x"), ["1", ">2"])) == [False, True, False, True, None]
    assert values(spark, in_ranges(F.col("x"), [">0.5", "<3"], every=True)) == [False, True, True, False, None]


@pytest.mark.parametrize("text,want", [("1 + 2 * x ^ 2 == 9", (0, 0, 1, 0)), ("x < 1 or x > 2 and true", (1, 0, 0, 1)), ("[x + 1] * 2 >= 6", (0, 0, 1, 1)), ("x / 0 == 1 or x == 1", (None, 1, None, None)), ("-x < -2", (0, 0, 0, 1)), ("x != 2 & x <= 3", (1, 1, 0, 1)), ("2 ^ 3 ^ 1 = 8", (1, 1, 1, 1))])
def test_expressions(spark, text, want):
    got = values(spark, expression(text))
    assert got[:4] == [None if w is None else bool(w) for w in want]


def test_expression_variables_and_errors(spark):
    assert values(spark, expression("AF > 1 and NA == NA", info)) == [False, False, None, None, None]
    for bad in ("1 +", "(x", "x !", "x x"):
        with pytest.raises(ValueError):
            expression(bad)


def test_large_shapes():
    from pedlake.functions import special

    assert abs(float(special.chi2_sf(1e6, 1e6)) - 0.49981193) < 1e-7 and abs(float(special.chi2_sf(1e8, 1e8)) - 0.49998119) < 1e-7
    a = np.full(7, 15_000.0)
    x = a * np.array([0.97, 0.99, 0.9999, 1.0, 1.0001, 1.01, 1.03])
    assert np.allclose(special._large_gamma_q(a, x), special.gamma_q(a, x), rtol=1e-6)


def test_normal_far_out():
    from pedlake.functions import special

    z = np.array([-8.0, -1.0, 0.0, 0.5, 3.0, 12.0, 30.0])
    assert np.allclose(special.norm_sf(z), [0.5 * math.erfc(x / math.sqrt(2)) for x in z], rtol=1e-11)
    p = np.array([1e-200, 1e-12, 0.02, 0.3, 0.5, 0.77, 1 - 1e-9])
    assert np.allclose(special.norm_sf(-special.norm_quantile(p)), p, rtol=1e-9)
