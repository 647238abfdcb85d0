"""Every query with SQL equals DuckDB on the smallest tables; the others run."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("p") or not n[1].isdigit() or n in ("p3_found", "p4_found")))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = Counter(tuple(norm(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert Counter(tuple(norm(r[c]) for c in order) for r in rows) == expected
