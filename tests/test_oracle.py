"""Every query with SQL against DuckDB on the smallest tables; every other one runs and keeps its schema."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as E

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
CORE = {k for m in E._modules() if ".llm" not in m.__name__ for k in m.QUERIES}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = E.queries()[name](spark, str(FOLDER))
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in E.oracle_sql():
        cur = duck.execute(E.oracle_sql()[name])
        have = [d[0] for d in cur.description]
        assert sorted(have) == cols
        assert got == sorted((tuple(norm(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
