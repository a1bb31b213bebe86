"""Readers of text tables and writers: round trips and small files."""

import json
import xml.etree.ElementTree as ET

import pytest

from pedlake.sources import formats, registry, tables_text, writers
from tests.test_models import cohort


@pytest.fixture(scope="module")
def c(spark):
    return cohort(spark, n_fam=3, n_var=9)[0]


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def lines(df):
    return [r["line"] for r in df.collect()]


@pytest.mark.parametrize("sample_major", [False, True])
def test_bed_round_trip(spark, c, tmp_path, sample_major):
    path = str(tmp_path / "x")
    c_samples = c.samples
    writers.write_bed(c.calls, c.variants, c_samples, path, sample_major)
    fam, bim = formats.read_fam(spark, path + ".fam"), formats.read_bim(spark, path + ".bim")
    who = [line.split("\t")[1] for line in open(path + ".fam").read().splitlines()]
    what = [line.split("\t")[1] for line in open(path + ".bim").read().splitlines()]
    assert fam.count() == len(who) == 21 and bim.count() == len(what) == 9
    want = {(r["vidx"], r["iid"]): r["g"] for r in c.calls.collect()}
    rows = {r[0]: r["g"] for r in writers.read_bed(spark, path + ".bed", len(who), len(what), block=2).collect()}
    for i, v in enumerate(what):
        for j, s in enumerate(who):
            assert (rows[j][i] if sample_major else rows[i][j]) == want[int(v[1:]), s]
    with pytest.raises(ValueError):
        writers.read_bed(spark, path + ".fam", 3)


def test_vcf_round_trip(spark, c, tmp_path):
    path = str(tmp_path / "v.vcf")
    formats.write_lines(writers.vcf_file(c.calls, c.variants, c.samples).coalesce(1), path)
    variants, calls = formats.read_vcf(spark, path)
    ids = {r["vidx"]: r["id"] for r in variants.collect()}
    assert {r["info"]["AF"] for r in variants.collect()} == {"0.2"}
    got = {(ids[r["vidx"]], r["iid"]): r["g"] for r in calls.collect()}
    assert got == {(f"v{r['vidx']}", r["iid"]): r["g"] for r in c.calls.collect()}


def test_vcf_repeats(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"
    path = put(tmp_path, "d.vcf", head + "1\t5\trs1\tA\tG\t.\tPASS\tAF=1;AF=2;X\tGT\t0|1\t1/1\n2\t7\trs1\tC\tT\t.\tPASS\t.\tGT\t0/0\t.|.\n")
    variants, calls = formats.read_vcf(spark, path)
    v = {r["vidx"]: r for r in variants.collect()}
    assert v[0]["info"] == {"AF": "2", "X": "1"} and v[0]["id"] == v[1]["id"] == "rs1"
    assert {(r["vidx"], r["iid"]): r["g"] for r in calls.collect()} == {(0, "A"): 1, (0, "B"): 2, (1, "A"): 0, (1, "B"): None}
    phased = {(r["vidx"], r["iid"]): r["g"] for r in formats.read_vcf(spark, path, phase="phased")[1].collect()}
    assert phased[0, "A"] == 1 and phased[0, "B"] is None and phased[1, "A"] is None


def test_text_genotypes(spark, c, tmp_path):
    want = {(r["vidx"], r["iid"]): r["g"] for r in c.calls.collect()}
    gen = lines(writers.gen_lines(c.calls, c.variants, c.samples))
    assert len(gen) == 9 and all(len(x.split()) == 5 + 3 * 21 for x in gen)
    order = [r["iid"] for r in c.samples.orderBy("fid", "iid").collect()]
    for x in gen:
        f = x.split()
        for j, s in enumerate(order):
            three, g = f[5 + 3 * j : 8 + 3 * j], want[int(f[1][1:]), s]
            assert three == (["0", "0", "0"] if g is None else ["1" if k == g else "0" for k in range(3)])
    raw = lines(writers.raw_lines(c.calls, c.variants, c.samples, "dominant"))
    assert raw[0].split()[5:] == [f"v{i}" for i in range(9)]
    f = raw[1].split()
    assert [None if x == "NA" else int(x) for x in f[5:]] == [None if want[v, f[1]] is None else int(want[v, f[1]] > 0) for v in range(9)]
    assert len(lines(writers.tped_lines(c.calls, c.variants, c.samples))[0].split()) == 4 + 42
    assert lines(writers.beagle_lines(c.calls, c.variants, c.samples))[0].startswith("I id a0 a0")
    merlin = writers.merlin_files(c.calls, c.variants, c.samples.withColumn("pheno", c.samples.weight))
    assert merlin["dat"].count() == 9 and merlin["ped"].count() == 21
    assert len(lines(writers.sample_lines(c.samples))) == 23


def test_results_in_all_forms(spark):
    df = spark.createDataFrame([(1, "a<b", None), (2, 'x,"y"', 0.5)], "id long, name string, p double")
    assert lines(writers.result_lines(df, "tab")) == ["id\tname\tp", "1\ta<b\tNA", '2\tx,"y"\t0.5']
    assert lines(writers.result_lines(df, "csv"))[2] == '2,"x,""y""",0.5'
    assert json.loads(lines(writers.result_lines(df, "json"))[0]) == {"id": 1, "name": "a<b", "p": None}
    assert ET.fromstring("".join(lines(writers.result_lines(df, "xml"))))[0].find("name").text == "a<b"


def test_relationship_files(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "a", 1.0, 5), ("a", "b", 0.5, 4), ("b", "b", 1.0, 6)], "iid1 string, iid2 string, value double, n int")
    assert lines(writers.relationship_lines(pairs, "gcta")) == ["1\t1\t5\t1.0", "2\t1\t4\t0.5", "2\t2\t6\t1.0"]
    assert lines(writers.relationship_lines(pairs, "epacts"))[:2] == ["#IND1\tIND2\tKINSHIP", "a\ta\t0.5"]
    assert lines(writers.relationship_lines(pairs, "matrix")) == ["a 0:1.0 1:0.5", "b 0:0.5 1:1.0"]
    path = put(tmp_path, "r.txt", "\n".join(lines(writers.relationship_lines(pairs))))
    assert tables_text.read_relationships(spark, path).count() == 3
    square = put(tmp_path, "m.txt", "a b\n1 0.5\n0.5 1\n")
    got = {(r["iid1"], r["iid2"]): r["value"] for r in tables_text.read_relationships(spark, square, "matrix").collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 1.0}


def test_gene_sets_in_five_layouts(spark, c, tmp_path):
    want = {("G", "v1"), ("G", "v3"), ("H", "v2")}
    for layout, text in {"pair": "v1 G\nv3 G\nv2 H\n", "gene_first": "G v1\nG\tv3\nH v2\nH v2\n", "row": "G v1 v3\nH v2\n", "block": "G\nv1\nv3\nEND\nH\nv2\nend\n"}.items():
        assert {tuple(r) for r in tables_text.read_gene_set(spark, put(tmp_path, layout, text), layout).collect()} == want, layout
    got = tables_text.read_gene_set(spark, put(tmp_path, "range", "G 2 1000 3500\nH 1 2000 2001\n"), "range", c.variants)
    assert {tuple(r) for r in got.collect()} == want
    path = tables_text.read_pathways(spark, put(tmp_path, "p", "P G0 G1\nQ G1\n"))
    assert tables_text.pathway_sets(path, c.sets).where("gene = 'P'").count() == 9


def test_names_of_covariates(spark):
    names = ["AGE", "BMI", "P1", "P2", "SITE"]
    assert [n for n, _, _ in tables_text.expand_names("P*,AGE-P1,BMI^2,factor(SITE)", names)] == ["P1", "P2", "AGE", "BMI", "BMI^2", "SITE"]
    with pytest.raises(ValueError):
        tables_text.expand_names("X", names)
    t = spark.createDataFrame([("a", "SITE", "continuous", 1.0), ("b", "SITE", "continuous", 2.0), ("c", "SITE", "continuous", 3.0), ("a", "BMI", "continuous", 4.0)], "iid string, trait string, kind string, val double")
    got = {(r["iid"], r["trait"]): r["val"] for r in tables_text.select_traits(t, "factor(SITE),BMI^2").collect()}
    assert got == {("a", "SITE=2"): 0.0, ("b", "SITE=2"): 1.0, ("c", "SITE=2"): 0.0, ("a", "SITE=3"): 0.0, ("b", "SITE=3"): 0.0, ("c", "SITE=3"): 1.0, ("a", "BMI^2"): 16.0}


def test_small_tables(spark, c, tmp_path):
    assert {tuple(r) for r in tables_text.read_by_variant(spark, put(tmp_path, "w", "VARIANT W\nv1 0.5\nv2 x\n")).collect()} == {("v1", 0.5)}
    assert {tuple(r) for r in tables_text.read_by_sample(spark, put(tmp_path, "s", "F a 1.5\n")).collect()} == {("F", "a", 1.5)}
    assert tables_text.read_types(spark, put(tmp_path, "t", "p i 0.1 0.2 0.7\n")).first()["p_bb"] == 0.7
    assert [tuple(r) for r in tables_text.read_genetic_map(spark, put(tmp_path, "m", "CHR MARKER POS\n1 v1 3.5\nX v2 7\n")).collect()] == [(1, "v1", 3.5), (23, "v2", 7.0)]
    assert sorted(tuple(r) for r in tables_text.read_permutations(spark, put(tmp_path, "perm", "1 0\n0 1\n")).collect()) == [(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, 1)]
    assert tables_text.read_parameters(spark, put(tmp_path, "par", "# run\nsegreg {\n trait = AGE\n mean {\n  option = two\n }\n}\nseed = 3\n")) == {"segreg.trait": "AGE", "segreg.mean.option": "two", "seed": "3"}
    assert {(r["id"], r["iid"]): r["value"] for r in tables_text.read_expression(spark, put(tmp_path, "e", "GENE s1 s2\ng1 1 2\ng2 NA 4\n")).collect()} == {("g1", "s1"): 1.0, ("g1", "s2"): 2.0, ("g2", "s1"): None, ("g2", "s2"): 4.0}
    v, d = tables_text.read_mach(spark, put(tmp_path, "dose", "F->a DOSE 0.5 2\nF->b DOSE 1 0.1\n"), put(tmp_path, "info", "SNP Al1 Al2 Freq1\nv1 A G 0.2\nv2 C T 0.3\n"))
    assert [tuple(r) for r in v.orderBy("vidx").collect()] == [(0, "v1", "A", "G", 0.2), (1, "v2", "C", "T", 0.3)] and {(r["vidx"], r["iid"]): r["d"] for r in d.collect()}[1, "b"] == 0.1
    m = tables_text.read_meta(spark, put(tmp_path, "meta", "VARIANT BETA SE P\nv1 0.5 0.1 0.01\n"))
    got = tables_text.meta_fixed(m.unionByName(m.selectExpr("id", "n", "0.3D beta", "se", "p"))).first()
    assert abs(got["beta"] - 0.4) < 1e-12 and abs(got["q"] - 2.0) < 1e-9 and got["df"] == 1


def test_sequences(spark, c, tmp_path):
    path = put(tmp_path, "r.fa", ">chr1 x\n" + "ACGT\n" * 700 + ">2\n" + "gg\n" * 900)
    seq = tables_text.read_sequences(spark, path).collect()
    assert [(r["name"], r["start"], r["bases"]) for r in seq[:2]] == [("chr1", 1, "ACGT"), ("chr1", 5, "ACGT")] and (seq[-1]["name"], seq[-1]["start"]) == ("2", 1799)
    got = {r["vidx"]: (r["base"], r["matches"]) for r in tables_text.reference_bases(c.variants, tables_text.read_sequences(spark, path)).collect()}
    assert got[2] == ("A", "major") and got[1] == ("G", "minor") and 4 not in got


def test_registry_and_scripts(spark):
    assert registry.select({"vcf": "a.vcf", "fam": "x"}) == ("vcf", "a.vcf") and registry.select({"dosage": "a.vcf.gz"}) == ("vcf", "a.vcf.gz")
    for options in ({}, {"vcf": "a", "bed": "b"}):
        with pytest.raises(ValueError):
            registry.select(options)
    assert registry.script_lines('# c\n--vcf "a b.vcf" --freq \\\n --maf 0.1 0.2\n\n--fst\n') == [{"vcf": "a b.vcf", "freq": True, "maf": "0.1 0.2"}, {"fst": True}]
    with pytest.raises(KeyError):
        registry.read(spark, "nothing", "x")
    assert {"bed", "vcf", "gen", "table"} <= set(registry.WRITERS)
    registry.analysis("twice")(lambda c, k=1: {"x": k * 2})
    assert registry.run("twice", None, k=4) == {"x": 8}


def test_plots(spark):
    df = spark.createDataFrame([(1 + i % 3, 1000 * i, (i + 1) / 101) for i in range(100)], "chrom int, pos int, p double")
    for svg in (writers.histogram_svg(df, "p"), writers.qq_svg(df), writers.manhattan_svg(df), writers.pedigree_svg([("a", None, None, 1), ("b", None, None, 2), ("c", "a", "b", 1)]), writers.histogram_svg(df.limit(0), "p")):
        assert ET.fromstring(svg).tag.endswith("svg")


def test_bgen(spark, c, tmp_path):
    """The file is read back by the fields of its format."""
    import zlib

    path = str(tmp_path / "x.bgen")
    writers.write_bgen(c.calls, c.variants, c.samples, path)
    data = open(path, "rb").read()
    number = lambda a, k: int.from_bytes(data[a : a + k], "little")
    at, m, n = 4 + number(0, 4), number(8, 4), number(12, 4)
    assert (m, n, data[16:20]) == (9, 21, b"bgen")
    who, p = [], 4 + 20 + 8
    for _ in range(n):
        k = number(p, 2)
        who.append(data[p + 2 : p + 2 + k].decode())
        p += 2 + k
    assert p == at
    want = {(r["vidx"], r["iid"]): r["g"] for r in c.calls.collect()}
    for _ in range(m):
        texts = []
        for size in (2, 2, 2):
            k = number(at, size)
            texts.append(data[at + size : at + size + k].decode())
            at += size + k
        at += 6
        for _ in range(2):
            at += 4 + number(at, 4)
        size, whole = number(at, 4), number(at + 4, 4)
        block = zlib.decompress(data[at + 8 : at + 4 + size])
        assert len(block) == whole == 10 + 3 * n
        at += 4 + size
        for j, s in enumerate(who):
            a, b = block[10 + n + 2 * j], block[11 + n + 2 * j]
            g = None if block[8 + j] & 0x80 else 0 if a == 255 else 1 if b == 255 else 2
            assert g == want[int(texts[0][1:]), s]
    assert at == len(data)
