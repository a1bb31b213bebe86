from datetime import datetime as D

from pedlake.operators import references as R

S = "sample_id long, fid string, iid string, pat string, mat string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, ref_id string"
P = "pheno_id long, fid string, iid string, trait string, loaded_at timestamp_ntz, at string"
G = "geno_id long, vidx long, fid string, iid string, g tinyint, loaded_at timestamp_ntz"
JAN, FEB, MAR, APR = (D(2024, m, 1) for m in (1, 2, 3, 4))


def tables(spark, s, p, g):
    return spark.createDataFrame(s, S), spark.createDataFrame(p, P), spark.createDataFrame(g, G)


def found(spark, s=(), p=(), g=()):
    return sorted((r["ref_table"], r["ref_id"]) for r in R.dangling_rows(*tables(spark, list(s), list(p), list(g))).select("ref_table", "ref_id").distinct().collect())


def test_in_force_from_start_until_end(spark):
    s = [(1, "F", "I", None, None, FEB, APR, "x")]
    p = [(k, " f\t", "i ", "T", t, "clash") for k, t in enumerate((JAN, FEB, MAR, APR))]
    assert found(spark, s, p) == [("phenotype", 0), ("phenotype", 3)]


def test_reload_and_duplicates(spark):
    s = [(1, "F", "I", None, None, JAN, FEB, "x")] * 2 + [(2, "f", "i", None, None, MAR, None, "x")]
    g = [(1, 0, "F", "I", 1, JAN), (2, 0, "F", "I", 1, FEB), (2, 0, "F", "I", 1, FEB), (3, 0, "F", "I", None, MAR)]
    assert found(spark, s, g=g) == [("genotype", 2)]


def test_nulls_and_empty(spark):
    s = [(1, None, "I", None, None, JAN, None, "x"), (2, "F", "J", None, None, None, None, "x"), (3, "F", "K", None, None, MAR, JAN, "x")]
    p = [(1, None, "I", "T", JAN, ""), (2, "F", None, "T", JAN, ""), (3, "F", "J", "T", JAN, ""), (4, "F", "K", "T", APR, ""), (5, "F", "Q", "T", None, "")]
    assert found(spark, s, p) == [("phenotype", 3), ("phenotype", 4), ("phenotype", 5)]
    assert found(spark) == []


def test_parents_of_any_family(spark):
    s = [(1, "A", "dad", "0", None, JAN, None, "x"), (2, "B", "kid", "DAD ", "mum", FEB, MAR, "x"), (3, "C", "old", " dad", "0", JAN, None, "x"), (4, "C", "mum", None, None, MAR, None, "x")]
    assert found(spark, s) == [("samples", 2)]
    s[3] = (4, "C", "mum", None, None, FEB, None, "x")
    assert found(spark, s) == []


def test_carry_over_months(spark):
    s = [(1, "F", "I", None, None, JAN, D(2024, 2, 10), "x"), (2, "F", "I", None, None, D(2024, 2, 5), MAR, "x"), (3, "F", "I", None, None, D(2024, 6, 1), None, "x")]
    times = [D(2024, 1, 15), D(2024, 2, 12), D(2024, 3, 1), D(2024, 4, 9), D(2024, 6, 1), D(2025, 1, 1)]
    assert found(spark, s, [(k, "F", "I", "T", t, "") for k, t in enumerate(times)]) == [("phenotype", 2), ("phenotype", 3)]


def test_state_of_deltas(spark):
    keys = ["fid", "iid"]
    make = lambda rows: spark.createDataFrame(rows, "fid string, iid string, refs long, exists long")
    state = R.fold(keys, make([("F", "I", 2, 0), ("F", "J", 1, 1)]))
    assert [(r["iid"], r["refs"]) for r in R.orphans(state).collect()] == [("I", 2)]
    later = R.fold(keys, state, make([("F", "I", 0, 1), ("F", "J", 0, -1)]))
    assert [(r["iid"], r["refs"]) for r in R.orphans(later).collect()] == [("J", 1)]


def test_report(spark):
    s, p, g = tables(spark, [(1, "F", "I", None, None, JAN, None, "x")], [(1, "F", "Q", "T", FEB, ""), (1, "F", "Q", "T", FEB, ""), (2, "F", "I", "T", None, "")], [])
    got = {(r["ref_table"], r["month"]): (r["n_read"], r["n_dangling"]) for r in R.dangling_report(s, p, g).collect()}
    assert got == {("samples", "2024-01"): (1, 0), ("phenotype", "2024-02"): (2, 1), ("phenotype", None): (1, 1)}


def test_current_state_is_folded_with_later_rows(spark):
    """The state of an earlier load and the deltas of later rows give what all rows give."""
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    schema = "sample_id long, fid string, iid string, pat string, mat string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
    samples = [(1, "f", "a", None, None, day(1), None), (2, "f", "b", "A", "zz", day(2), None), (3, "g", "c", "0", "a", day(3), day(9))]
    pheno = [(1, "f", "a ", day(4)), (2, "f", "q", day(5)), (2, "f", "q", day(5)), (3, "g", "C", day(5)), (4, None, "c", day(5))]
    geno = [(1, "F", "Q", day(20))]
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} long, fid string, iid string, loaded_at timestamp_ntz")
    s, p, g = spark.createDataFrame(samples, schema), table(pheno, "pheno_id"), table(geno, "geno_id")
    whole = {tuple(r) for r in R.current_orphans(R.current_state(s, p, g)).collect()}
    assert whole == {("phenotype", "2024-01", "F", "Q", 1), ("genotype", "2024-01", "F", "Q", 1), ("phenotype", "2024-01", "G", "C", 1), ("samples", "2024-01", None, "ZZ", 1)}
    first = R.current_state(s.limit(0).unionByName(s.where("sample_id < 3")), p.where("pheno_id < 3"), g.limit(0))
    both = R.current_state(s.where("sample_id = 3"), p.where("pheno_id >= 3"), g, first)
    assert {tuple(r) for r in R.current_orphans(both).collect()} == whole
