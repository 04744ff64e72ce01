"""Each registered query of the catalogue against its SQL, at the smallest scale."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from veilwork import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, str(DATA))
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(row[columns.index(c)]) for c in sorted(columns)) for row in result.fetchall())
    got = Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want
