"""A published pedigree of 58 persons with one loop, and the counts that are known of it."""

import pytest

from pedlake.operators import pedigree
from pedlake.operators.cohort import Cohort

# Person, father, mother (0 unknown), sex.
PEDIGREE = """
69 0 0 1;70 0 0 2;67 0 0 1;68 69 70 2;71 69 70 1;72 0 0 2;75 69 70 1;76 0 0 2;79 69 70 1;80 0 0 2;60 0 0 1;61 67 68 2;86 0 0 1;87 0 0 2;73 71 72 1;74 0 0 2;77 75 76 1;78 0 0 2;81 79 80 1;82 0 0 2;
2171-JLH-33 60 61 1;2171-JLH-32 60 61 2;85 0 0 1;n1 60 61 2;83 60 61 1;84 86 87 2;2171-JLH-29 60 61 2;2171-JLH-28 86 87 1;62 0 0 1;63 60 61 2;n2 0 0 2;64 60 61 1;65 0 0 2;2171-JLH-23 73 74 2;n3 77 78 1;2171-JLH-22 77 78 2;n4 0 0 1;
2171-JLH-21 81 82 1;n5 81 82 2;n6 81 82 2;2171-JLH-31 85 2171-JLH-32 2;2171-JLH-34 0 0 1;n7 85 2171-JLH-32 2;n8 85 2171-JLH-32 1;2171-JLH-30 83 84 1;n9 83 84 1;2171-JLH-36 2171-JLH-28 2171-JLH-29 1;2171-JLH-27 2171-JLH-28 2171-JLH-29 2;
2171-JLH-26 2171-JLH-28 2171-JLH-29 2;n10 62 63 1;2171-JLH-25 62 63 1;n11 64 n2 2;n12 64 65 2;2171-JLH-24 64 65 1;n13 0 0 1;n14 n4 2171-JLH-22 2;2171-JLH-35 2171-JLH-34 2171-JLH-31 1;n15 n13 n14 1
"""
# A second pedigree without loops, with age and a binary trait (-9 or NA unknown).
TRAITS = """
2171-JLH-1 0 0 1 19 0;2171-JLH-2 0 0 2 28 0;2171-JLH-3 0 0 1 45 0;2171-JLH-4 2171-JLH-1 2171-JLH-2 2 30 1;2171-JLH-5 0 0 1 16 0;2171-JLH-6 2171-JLH-3 2171-JLH-4 2 55 1;2171-JLH-7 0 0 1 49 0;
2171-JLH-8 0 0 2 33 0;2171-JLH-9 2171-JLH-1 2171-JLH-2 1 67 1;2171-JLH-10 0 0 1 23 -9;2171-JLH-11 0 0 2 29 -9;2171-JLH-12 2171-JLH-10 2171-JLH-11 1 45 1;2171-JLH-13 0 0 2 88 0;2171-JLH-14 0 0 2 57 0;
2171-JLH-15 0 0 1 33 0;2171-JLH-16 2171-JLH-5 2171-JLH-6 1 23 1;2171-JLH-17 2171-JLH-5 2171-JLH-6 2 99 1;2171-JLH-18 2171-JLH-5 2171-JLH-6 1 12 1;2171-JLH-19 2171-JLH-5 2171-JLH-6 2 27 1;
2171-JLH-20 2171-JLH-15 2171-JLH-32 2 33 0;2171-JLH-21 2171-JLH-12 2171-JLH-13 1 67 1;2171-JLH-22 2171-JLH-12 2171-JLH-13 2 34 0;2171-JLH-23 2171-JLH-15 2171-JLH-32 1 67 1;
2171-JLH-24 2171-JLH-18 2171-JLH-8 1 89 1;2171-JLH-25 2171-JLH-7 2171-JLH-17 1 45 1;2171-JLH-26 2171-JLH-28 2171-JLH-29 2 56 0;2171-JLH-27 2171-JLH-28 2171-JLH-29 2 67 1;
2171-JLH-28 2171-JLH-10 2171-JLH-11 1 78 0;2171-JLH-29 2171-JLH-5 2171-JLH-6 2 54 1;2171-JLH-30 2171-JLH-16 2171-JLH-14 1 32 1;2171-JLH-31 2171-JLH-15 2171-JLH-32 2 34 1;
2171-JLH-32 2171-JLH-5 2171-JLH-6 2 23 1;2171-JLH-33 2171-JLH-5 2171-JLH-6 1 43 0;2171-JLH-34 0 0 1 32 0;2171-JLH-35 2171-JLH-34 2171-JLH-31 1 34 1;2171-JLH-36 2171-JLH-28 2171-JLH-29 1 55 1;
2171-JLH-38 2171-JLH-7 2171-JLH-17 2 34 0
"""
PAIRS = {"parent_offspring": 78, "sib": 41, "sister_sister": 9, "brother_brother": 8, "brother_sister": 24, "grandparent": 76, "avuncular": 98, "half_sib": 2, "cousin": 79}


@pytest.fixture(scope="module")
def c(spark):
    rows = [(i, "1", None if a == "0" else a, None if b == "0" else b, int(s), a == "0" and b == "0") for i, a, b, s in (x.split() for x in PEDIGREE.replace("\n", "").split(";"))]
    assert len(rows) == 58
    s = spark.createDataFrame(rows, "iid string, fid string, pat string, mat string, sex int, founder boolean")
    return Cohort(s, *(spark.createDataFrame([], x) for x in ("vidx long, iid string, g tinyint", "iid string, trait string, kind string, val double", "vidx long, chrom int, pos int", "gene string, vidx long")))


def test_pairs(c):
    assert {r["relation"]: r["n_pair"] for r in pedigree.pair_counts(c).collect()} == PAIRS
    assert {r["relation"]: r["count"] for r in pedigree.relative_pairs(c).groupBy("relation").count().collect()} == PAIRS


def test_persons_and_sibships(c):
    f = pedigree.families(c).first()
    assert (f["n_member"], f["n_male"], f["n_female"], f["n_founder"], f["n_nonfounder"]) == (58, 30, 28, 19, 39)
    s = pedigree.sibship_summary(c).first()
    assert (s["n_sibship"], round(s["mean_size"], 2), round(s["sd_size"], 2), s["min_size"], s["max_size"]) == (19, 2.05, 1.47, 1, 7)
    assert 33 <= f["inheritance_bits"] <= 64


def test_mates_and_loops(c):
    assert [(r["iid"], r["n_mate"]) for r in pedigree.multi_mates(c).collect()] == [("64", 2)]
    assert pedigree.consanguineous(c).count() == 0
    r = pedigree.pedigree_loops(c).collect()
    assert [(x["n_person"], x["n_ring"], x["n_loop"]) for x in r] == [(58, 0, 1)]


def test_correlations_of_relatives(spark):
    rows = [x.split() for x in TRAITS.replace("\n", "").split(";")]
    none = lambda x: None if x == "0" else x
    s = spark.createDataFrame([(i, "1", none(a), none(b), int(x), a == b == "0") for i, a, b, x, _, _ in rows], "iid string, fid string, pat string, mat string, sex int, founder boolean")
    values = [(i, n, "continuous", float(v)) for i, _, _, _, age, et in rows for n, v in (("AGE", age), ("ET", et)) if v not in ("-9", "NA", ".")]
    d = Cohort(s, *(spark.createDataFrame(*x) for x in (([], "vidx long, iid string, g tinyint"), (values, "iid string, trait string, kind string, val double"), ([], "vidx long, chrom int, pos int"), ([], "gene string, vidx long"))))
    one = {r["relation"]: (r["n_pair"], round(r["r"], 4)) for r in pedigree.relation_correlations(d, "ET").collect()}
    two = {r["relation"]: (r["n_pair"], round(r["r"], 4)) for r in pedigree.relation_correlations(d, "ET", "AGE").collect()}
    assert one["parent_offspring"] == (46, -0.0460) and two["self"] == (35, 0.1473) and two["parent_offspring"] == (46, -0.0063)
