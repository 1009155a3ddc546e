"""Every proof query with a SQL twin must equal it on the smallest tables."""

import math
import os

import pytest

from roleweave.catalog import load_all

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("ROLEWEAVE_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
PROOFS = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(n for n, p in PROOFS.items() if p.sql))
def test_matches_sql(spark, con, name):
    proof = PROOFS[name]
    df = proof.run(spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(proof.sql)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert got, "empty result"
    assert got == want
