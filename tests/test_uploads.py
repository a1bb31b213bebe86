import random
import re
from datetime import datetime as D

from pedlake.operators import drift
from pedlake.sources import delimited

L = "line_id long, file_name string, line_no int, raw_line string, fields string"
V = "line_id long, file_id long, center string, received_at timestamp_ntz, raw_line string, rank int"


def plain(line):
    """Fields of a line by a plain loop, None for a quoting error."""
    out, i, s = [], 0, line.strip()
    while i < len(s):
        if s[i] in " \t":
            i += 1
        elif s[i] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=[ \t]|\Z)').match(s, i)
            if not m:
                return None
            out.append(m[1].replace('""', '"'))
            i = m.end()
        else:
            m = re.compile(r"[^ \t]+").match(s, i)
            if '"' in m[0]:
                return None
            out.append(m[0])
            i = m.end()
    return out


def test_tokenizer_against_plain_loop():
    rng = random.Random(5)
    lines = ["".join(rng.choice('ab "\t\r é') for _ in range(rng.randrange(40))) for _ in range(4000)] + ["", " ", '"', '""', '"a" b', 'a"b', '"a"b', '"a""b" c', 'x "y', "z" * 10_000 + ' "q q"' * 500]
    for width in (1, 3, 64):
        fields, offsets = delimited.tokenize(lines, width)
        assert fields == [plain(x) for x in lines]
        assert all((f is None) == (o >= 0) for f, o in zip(fields, offsets))
    assert delimited.tokenize(['a b"c', 'a  "bc'])[1].tolist() == [3, 3]


def test_reasons(spark):
    good = [(i, "f", i, f"F{i} I{i} 0 0 1 2", "") for i in range(6)]
    odd = [(10, "f", 10, 'F I" 0 0 1', ""), (11, "f", 11, "F I 0 0 1", ""), (12, "f", 12, "NA I 0 0 1 2", ""), (13, "f", 13, 'F " na " 0 0 1 2', ""), (14, "f", 14, 'F "Ü" 0 0 1 2', ""), (15, "f", 15, None, ""), (16, "f", 16, "  ", ""), (17, "f", 17, 'F "a ""b" 0 0 1 2', ""), (18, "f", 18, ' "F x"\tI-1.\t0 P "1" -9 \r', ""), (18, "f", 18, ' "F x"\tI-1.\t0 P "1" -9 \r', "")]
    odd += [(20, "g", 1, "F I 0 0 1", ""), (21, "g", 2, "F I 0 0 1 2", ""), (22, "g", 3, "F . 0 0 1", ""), (23, "g", 4, "F J 0 0 1", ""), (30, None, 1, "F I 0 0 1 x", "")]
    read = delimited.read_fam_lines(spark.createDataFrame(good + odd, L))
    got = {r["line_id"]: r["reason"] for r in read.collect()}
    assert got == {**{i: None for i in range(6)}, 10: "quoting", 11: "columns", 12: "values", 13: "values", 14: "values", 15: "columns", 16: "columns", 17: "values", 18: None, 20: None, 21: "columns", 22: "values", 23: None, 30: None}
    rows = {r["line_id"]: r for r in delimited.fam_samples(read).collect()}
    assert len(rows) == 10
    r = rows[18]
    assert (r["fid"], r["iid"], r["pat"], r["mat"], r["sex"], r["trait"]) == ("F X", "I-1.", None, "P", 1, None)
    assert delimited.read_fam_lines(spark.createDataFrame([], L)).count() == 0


def vcf(file_id, center, day, fmt, cells, first):
    head = [(first, file_id, center, D(2024, 1 + day // 28, 1 + day % 28), "##x", 0)]
    return head + [(first + 1 + i, file_id, center, head[0][3], "\t".join(["1", "5", "v", "A", "C", ".", ".", ".", f, *c]), 0) for i, (f, c) in enumerate(zip(fmt, cells))]


def test_changes(spark):
    rows = vcf(1, "A", 0, ["GT:DS", "DS:GT"], [["0/0:1", "./.:."], ["2:0/1", "."]], 10)
    rows += vcf(2, "A", 40, ["GT:DS"], [["0/0:1.5", "0/1"]], 20)  # DS becomes float, over a month
    rows += vcf(3, "A", 41, ["GT:DOS"], [["0/0:2.5", "0/1:2"]], 30)  # renamed
    rows += vcf(4, "A", 42, ["GT:GQ"], [["0/0:7", "0/1:8"]], 40)  # float against integer: removed and added
    rows += vcf(5, "B", 42, ["GT"], [["0/0"]], 50) + vcf(6, "B", 43, [], [], 60) + vcf(7, "B", 44, ["X:Y"], [["a:b"]], 70)
    df = spark.createDataFrame(rows + rows[:2], V)
    got = sorted(tuple(r) for r in drift.changes(df).select("file_id", "field_name", "change_kind").collect())
    assert got == [(2, "DS", "type_changed"), (3, "DS", "renamed"), (4, "DOS", "removed"), (4, "GQ", "added"), (6, "GT", "removed"), (7, "X", "added"), (7, "Y", "added")]
    assert drift.changes(df.limit(0)).count() == 0


def test_calls_have_one_schema(spark):
    rows = vcf(1, "A", 0, ["GT:DS"], [["0/0:1", "./.:2"]], 10) + vcf(2, "A", 1, ["DOS:GT"], [["3:0/1", "."]], 20) + vcf(3, "B", 1, ["GT:DS:center"], [["0/0:0.5:q"]], 30)
    out = drift.calls(spark.createDataFrame(rows + rows[1:2], V))
    assert dict(out.dtypes)["DS"] == "double" and "field_center" in out.columns and "DOS" not in out.columns
    got = sorted((r["file_id"], r["sample_no"], r["GT"], r["DS"]) for r in out.collect())
    assert got == [(1, 0, "0/0", 1.0), (1, 1, None, 2.0), (2, 0, "0/1", 3.0), (2, 1, None, None), (3, 0, "0/0", 0.5)]


def test_values_that_do_not_fit(spark):
    """Whole numbers over 64 bits make a field a string, a position that is no number is null."""
    import datetime

    from pedlake.operators import drift

    t = datetime.datetime(2024, 1, 1)
    lines = [(1, 1, "c", "f", t, 1, "1\t.\tx\tA\tG\t.\t.\t.\tGT:DP\t0/1:12345678901234567890\t0/0:5")]
    df = spark.createDataFrame(lines, "line_id long, file_id long, center string, file_name string, received_at timestamp_ntz, line_no int, raw_line string")
    got = drift.calls(df).orderBy("sample_no").collect()
    assert [r["DP"] for r in got] == ["12345678901234567890", "5"] and got[0]["pos"] is None
