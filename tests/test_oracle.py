"""Every query with an oracle equals its DuckDB SQL on the smallest driver tables."""

import math

import duckdb
import pytest

from conftest import SF_SMALL
from searchrank import catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(records, cols):
    out = [tuple(_norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = catalog.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = [r.asDict() for r in sdf.collect()]
    cur = con.execute(catalog.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    want = [dict(zip(dcols, r)) for r in cur.fetchall()]
    assert sorted(dcols) == cols
    assert len(got) == len(want)
    assert _rows(got, cols) == _rows(want, cols)
