"""Places in an order, natural sorting, repeated names, copies of families, haplotypes."""

import random

from pedlake.functions.keys import natural_key, numbered_names
from pedlake.operators import simulate
from pedlake.operators.order import numbered
from pedlake.sources import tables_text


def test_places_within_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 2, 2, 2, 3, None]), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, chrom int, pos int").repartition(7)
    got = {r["id"]: r["i"] for r in numbered(df, "chrom", "pos", "id").collect()}
    for c in (1, 2, 3, None):
        order = sorted((p, i) for i, k, p in rows if k == c)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    assert numbered(df.limit(0), "chrom", "pos").columns == ["id", "chrom", "pos", "i"] and numbered(df.limit(0), "chrom", "pos").count() == 0


def test_natural_order_and_names(spark):
    df = spark.createDataFrame([("v10", 1), ("v2", 2), ("V2", 3), ("v010", 4), ("a1b12", 5), ("a1b3", 6), (None, 7)], "name string, k int")
    order = [r["name"] for r in df.where("name is not null").orderBy(natural_key("name"), "k").collect()]
    assert order == ["a1b3", "a1b12", "v2", "V2", "v10", "v010"]
    twice = spark.createDataFrame([("x", 2), ("x", 1), ("y", 1), ("x", 3)], "name string, k int")
    assert sorted((r["name"], r["k"]) for r in numbered_names(twice, "name", "k").collect()) == [("x", 1), ("x_2", 2), ("x_3", 3), ("y", 1)]


def test_copies_of_a_trio(spark):
    ped = simulate.replicate(simulate.TRIO, 50)
    rows = {(r["vidx"], r["iid"]): r["g"] for r in simulate.gene_drop(spark, ped, 3).collect()}
    assert len(rows) == 450
    for k in range(50):
        for v in range(3):
            f, m, c = (rows[v, f"{k}.{x}"] for x in ("father", "mother", "child"))
            assert (f == 2) + (m == 2) <= c <= (f > 0) + (m > 0)


def test_haplotypes(spark, tmp_path):
    (tmp_path / "h").write_text("0 1 1 2 2\n1 1 2 2 1\n")
    (tmp_path / "p").write_text("SNP CHROM POS\n1 1 100.0\n2 1 250.5\n3 1 300\n")
    v, h = tables_text.read_haplotypes(spark, str(tmp_path / "h"), str(tmp_path / "p"))
    assert [tuple(r) for r in v.orderBy("vidx").collect()] == [(0, 1, 100), (1, 1, 250), (2, 1, 300)]
    assert {(r["haplotype"], r["vidx"]): r["allele"] for r in h.collect()} == {("0", 0): 1, ("0", 1): 0, ("0", 2): 0, ("1", 0): 0, ("1", 1): 0, ("1", 2): 1}
