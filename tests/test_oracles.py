"""Every query with SQL gives the rows of that SQL in DuckDB; the others run and keep their columns."""

import math

import duckdb
import pytest

from reconlake import queries
from reconlake.proxies import TABLES

SF = "/root/testdata/sf0.001"
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows, cols):
    def one(v):
        if v is None or isinstance(v, bool):
            return v
        try:
            f = float(v)
        except (TypeError, ValueError):
            return str(v)
        return None if math.isnan(f) else round(f, 5) + 0.0

    return sorted((tuple(one(r[c]) for c in cols) for r in rows), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - SLOW))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = normal([r.asDict() for r in df.collect()], cols)
    if name in queries.SQL:
        c = con.execute(queries.SQL[name])
        names = [x[0] for x in c.description]
        assert sorted(names) == cols
        assert got == normal([dict(zip(names, r)) for r in c.fetchall()], cols)
