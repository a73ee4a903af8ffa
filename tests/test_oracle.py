"""Every registered query against its SQL on the smallest dataset."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    def value(x):
        return float(x) if isinstance(x, Decimal) else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    relation = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    want = plain(relation.select(*[f'"{c}"' for c in columns]).fetchall())
    got = plain(tuple(r) for r in df.select(*columns).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=2e-6) if any(isinstance(x, float) for x in b) and all(x is not None and not isinstance(x, (str, bool)) for x in b) else a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(entry.queries())
