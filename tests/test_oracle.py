"""Every registered query runs; those with SQL twins equal DuckDB's answer on the same tables."""

import math
import os

import pytest

import swirlframe.queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 * max(1, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect()]
    if name not in Q.SQL:
        assert rows
        return
    rel = duck.sql(Q.SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    assert not any(type(v).__name__ == "Decimal" for r in want for v in r)
    key = lambda r: tuple((v is not None, (v if not isinstance(v, bool) else int(v)) if v is not None else 0) for v in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want, strict=True) if not all(same(x, y) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:3]
