import gzip

import numpy as np
import pytest

from pedlake.sources import formats as X


def write(path, lines, zipped=False):
    data = "\n".join(lines) + "\n"
    path.write_bytes(gzip.compress(data.encode()) if zipped else data.encode())
    return str(path)


def test_binary_round_trip(spark, tmp_path):
    g = np.random.default_rng(1).integers(-1, 3, (50, 13)).astype(np.int8)
    assert (X.decode(X.encode(g), 13) == g).all()
    assert X.decode(bytes([0b11100100]), 4).tolist() == [[2, -1, 1, 0]]
    p = tmp_path / "a.bed"
    p.write_bytes(X.MAGIC + X.encode(g))
    got = {r["vidx"]: r["g"] for r in X.read_bed(spark, str(p), 13, block=7).collect()}
    assert got == {i: [None if x < 0 else int(x) for x in row] for i, row in enumerate(g)}
    p.write_bytes(b"no")
    with pytest.raises(ValueError):
        X.read_bed(spark, str(p), 13)


def test_fam_bim(spark, tmp_path):
    fam = write(tmp_path / "a.fam", ["F a 0 0 1 2", "F\tb  a  m 2\t-9", "F c 0 0 0"])
    rows = {r["iid"]: r for r in X.read_fam(spark, fam).collect()}
    assert rows["a"]["founder"] and rows["a"]["pheno"] == 2 and rows["b"]["pat"] == "a" and rows["b"]["pheno"] is None and rows["c"]["sex"] is None
    full = {r["iid"]: r for r in X.with_missing_founders(X.read_fam(spark, fam)).collect()}
    assert set(full) == {"a", "b", "c", "m"} and full["m"]["sex"] == 2 and full["m"]["founder"]
    bim = write(tmp_path / "a.bim", ["chr1 v1 0 100 A G", "X v2 1.5 200 T C", "?? v3 0 7 A C"])
    v = X.read_bim(spark, bim).orderBy("vidx").collect()
    assert [(r["vidx"], r["chrom"], r["pos"], r["minor"]) for r in v] == [(0, 1, 100, "A"), (1, 23, 200, "T"), (2, None, 7, "A")]
    assert [r["line"].split("\t")[1] for r in X.bim_lines(X.read_bim(spark, bim)).collect()] == ["v1", "v2", "v3"]


def test_vcf(spark, tmp_path):
    lines = ["##fileformat=VCFv4.1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3"]
    site = lambda pos, name, alt, fmt, *c: f"chr1\t{pos}\t{name}\tA\t{alt}\t9.5\tPASS\tAF=0.1;DB\t{fmt}\t" + "\t".join(c)
    lines += [site(1, "v1", "G", "GT:DS", "0/1:0.9", "1|1:2", "./."), site(2, ".", "G", "DS:GT", "0.1:0/0", ".:1/.", "1:0|1"), site(3, "v3", "G,T", "GT", "1/2", "2/2", "./."), site(4, "v4", "G,T", "GT", "0/2", "1/1", "0/0"), site(5, "v5", "G,T,C", "GT", "0/0", "0/0", "0/0")]
    path = write(tmp_path / "a.vcf.gz", lines, True)
    v, g = X.read_vcf(spark, path)
    assert sorted(r["id"] for r in v.collect()) == ["chr1:2", "v1", "v3"] and v.where("id = 'v1'").first()["info"] == {"AF": "0.1", "DB": "1"}
    got = {(r["id"], r["iid"]): r["g"] for r in g.collect()}
    assert got == {("v1", "s1"): 1, ("v1", "s2"): 2, ("v1", "s3"): None, ("chr1:2", "s1"): 0, ("chr1:2", "s2"): None, ("chr1:2", "s3"): 1, ("v3", "s1"): 1, ("v3", "s2"): 2, ("v3", "s3"): None}
    d = {(r["id"], r["iid"]): r["d"] for r in X.read_vcf(spark, path, "DS")[1].collect()}
    assert d["v1", "s1"] == 0.9 and d["chr1:2", "s2"] is None
    cells = spark.createDataFrame([(0, "s1", 1), (0, "s2", 2), (1, "s1", None)], "vidx long, iid string, g tinyint")
    var = spark.createDataFrame([(0, 1, "v1", 5, "A", "G", 1.0, None), (1, 1, "v2", 4, "A", "G", None, "PASS")], "vidx long, chrom int, id string, pos int, major string, minor string, qual double, filt string")
    out = [r["line"].split("\t") for r in X.vcf_lines(cells, var, ["s1", "s2", "s3"]).collect()]
    assert [x[2] for x in out] == ["v2", "v1"] and out[1][9:] == ["0/1", "1/1", "./."]


def test_text_genotypes(spark, tmp_path):
    ped = write(tmp_path / "a.ped", ["F a 0 0 1 1 A A G G", "F b 0 0 2 2 A C G G", "F c a b 1 2 0 0 G G"])
    s, g = X.read_ped(spark, ped)
    assert s.count() == 3
    assert {(r["iid"], r["vidx"]): r["g"] for r in g.collect()} == {("a", 0): 0, ("b", 0): 1, ("c", 0): None, ("a", 1): 0, ("b", 1): 0, ("c", 1): 0}
    tped = write(tmp_path / "a.tped", ["1 v1 0 5 A A A C 0 0", "1 v2 0 6 G G G G G G"])
    assert {(r["sample_no"], r["vidx"]): r["g"] for r in X.read_tped(spark, tped).collect()} == {(0, 0): 0, (1, 0): 1, (2, 0): None, (0, 1): 0, (1, 1): 0, (2, 1): 0}
    var = spark.createDataFrame([(0, "v1", "A", "C")], "vidx long, id string, major string, minor string")
    who = spark.createDataFrame([("F", "a", None, None, 1, None), ("F", "b", None, None, 2, 1.0)], "fid string, iid string, pat string, mat string, sex tinyint, pheno double")
    cells = spark.createDataFrame([(0, "a", 2), (0, "b", None)], "vidx long, iid string, g tinyint")
    lgen = sorted(r["line"] for r in X.lgen_lines(cells, var, who).collect())
    assert lgen == ["F\ta\tv1\tC\tC", "F\tb\tv1\t0\t0"]
    path = write(tmp_path / "a.lgen", lgen)
    back = {r["iid"]: r["g"] for r in X.read_lgen(spark, path, var.select("id", "minor")).collect()}
    assert back == {"a": 2, "b": None}
    assert sorted(r["line"] for r in X.ped_lines(cells, var, who).collect()) == ["F\ta\t0\t0\t1\t-9\tC C", "F\tb\t0\t0\t2\t1.0\t0 0"]


def test_dosage_and_traits(spark, tmp_path):
    dose = write(tmp_path / "a.dose", ["v1 A G 0.5 NA", "v2 A G 2 1"])
    assert {(r["id"], r["iid"]): r["d"] for r in X.read_dosage(spark, dose, ["a", "b"]).collect()} == {("v1", "a"): 0.5, ("v1", "b"): None, ("v2", "a"): 2.0, ("v2", "b"): 1.0}
    gen = write(tmp_path / "a.gen", ["v1 A G 0 1 0 0 0.5 0.5"])
    assert [r["d"] for r in X.read_dosage(spark, gen, ["a", "b"], triplets=True).orderBy("iid").collect()] == [1.0, 1.5]
    ph = write(tmp_path / "a.pheno", ["FID IID AGE ET", "F a 31.5 1", "F b -9 2"])
    got = {(r["iid"], r["trait"]): (r["val"], r["kind"]) for r in X.read_traits(spark, ph).collect()}
    assert got == {("a", "AGE"): (31.5, "continuous"), ("a", "ET"): (1.0, "binary"), ("b", "AGE"): (None, "continuous"), ("b", "ET"): (2.0, "binary")}
