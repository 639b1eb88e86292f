import duckdb
import pytest

from tessera.plans import catalog  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, found):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(round(v, 5) if isinstance(v := r[k], float) else v for k in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(ORACLES[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            assert x == y or (isinstance(y, (int, float)) and abs(x - y) < 1e-4), (a, b)
