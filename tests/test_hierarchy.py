import random

import pytest

from pedlake.operators.components import components
from pedlake.operators.hierarchy import hierarchy

P = "famid string, pid string, fatid string, motid string, path string"


def run(spark, rows, **kw):
    h = hierarchy(spark.createDataFrame(rows, P), **kw)
    nodes = {(r["famid"], r["pid"]): r for r in h.nodes().collect()}
    pairs = sorted(tuple(r) for r in h.pairs().collect())
    assert len(pairs) == len(set(pairs)) and len(nodes) == h.nodes().count()
    return nodes, pairs


def brute(rows):
    norm = lambda x: None if x is None else x.strip(" \t").upper()
    par = lambda x: None if norm(x) in (None, "0") else norm(x)
    ups = {}
    for f, p, a, m, _ in rows:
        if f is None or p is None:
            continue
        ups.setdefault((norm(f), norm(p)), set()).update((norm(f), x) for x in (par(a), par(m)) if x)
    above = {}
    for k in ups:
        seen, todo = set(), list(ups[k])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ups.get(x, ())
        above[k] = seen
    return {k for k in above if k in above[k]}, sorted((f, a, p) for (f, p), s in above.items() for _, a in s)


@pytest.mark.parametrize("local_rows", [5000, 1])
def test_paths_and_cycles(spark, local_rows):
    rows = [
        (" f", "kid", "dad", "mum", "x"), ("F", "DAD ", "gran", "0", "x"), ("F", "mum", None, None, "x"), ("F", "mum", None, None, "x"),
        ("F", "a", "b", None, "x"), ("F", "b", None, "a", "x"), ("F", "c", "a", None, "x"), ("F", "self", "self", None, "x"), ("F", "under", "self", "mum", "x"),
        ("G", "kid", None, None, "x"), (None, "n", "m", None, "x"), ("G", None, "kid", None, "x"),
    ]
    nodes, pairs = run(spark, rows, local_rows=local_rows)
    kid = nodes["F", "KID"]
    assert (kid["path"], kid["depth"], kid["root"], kid["height"]) == (["KID", "DAD", "GRAN"], 2, "GRAN", 0)
    assert nodes["F", "GRAN"]["has_row"] is False and nodes["F", "GRAN"]["n_descendants"] == 2 and nodes["F", "GRAN"]["height"] == 2
    assert {k for k, r in nodes.items() if r["in_cycle"]} == {("F", "A"), ("F", "B"), ("F", "SELF")}
    assert nodes["F", "C"]["path"] == ["C", "A", "B"] and not nodes["F", "C"]["in_cycle"] and nodes["F", "SELF"]["path"] is None and nodes["F", "UNDER"]["root"] is None and nodes["F", "B"]["path"] == ["B"]
    assert ("F", "A", "A") in pairs and ("F", "MUM", "UNDER") in pairs and nodes["G", "KID"]["depth"] == 0
    assert brute(rows) == ({k for k, r in nodes.items() if r["in_cycle"]}, pairs)


def test_random_graphs_both_ways(spark):
    rng = random.Random(7)
    rows = []
    for f in range(4):
        n = 12
        for p in range(n):
            up = lambda: rng.choice([None, "0", *(str(rng.randrange(max(0, p - 4), p + 1 if rng.random() < 0.9 else n)) for _ in range(2))])  # noqa: B023, E731
            rows.append((f"fam{f}", str(p), up(), up(), "x"))
    cyc, pairs = brute(rows)
    for local_rows in (5000, 3):
        nodes, got = run(spark, rows, local_rows=local_rows)
        assert {k for k, r in nodes.items() if r["in_cycle"]} == cyc and got == pairs


def test_empty(spark):
    nodes, pairs = run(spark, [])
    assert not nodes and not pairs


def test_components(spark):
    rng = random.Random(3)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(40)] + [(f"c{i}", f"c{i + 1}") for i in range(50)] + [("hub", f"h{i}") for i in range(50)] + [("x", None), ("y", "y")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            root[find(a)] = find(b)
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == set(root)
    assert {frozenset(v for v in got if got[v] == c) for c in set(got.values())} == {frozenset(v for v in root if find(v) == c) for c in {find(v) for v in root}}
    assert all(got[c] == c for c in set(got.values()))
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
