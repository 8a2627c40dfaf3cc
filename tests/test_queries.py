"""Every query that SQL can express gives what DuckDB gives, at sf0.001."""

import math
from pathlib import Path

import duckdb
import pytest

from callwatch.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return round(float(v), 9) if hasattr(v, "as_tuple") else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    result = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    places = [columns.index(c) for c in names]
    expected = [tuple(r[i] for i in places) for r in result.fetchall()]
    assert ordered(map(tuple, df.select(*names).collect())) == ordered(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
