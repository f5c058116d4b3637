"""Every query without Python-only semantics equals its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from siftwork import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    expected = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    rows = [tuple(plain(v) for v in r) for r in got.select(*[got[c] for c in columns]).collect()]
    assert sorted(map(str, rows)) == sorted(str(tuple(plain(v) for v in r)) for r in expected)
