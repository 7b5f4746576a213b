"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from grainwise.queries import load
from grainwise.queries.base import TABLE_NAMES, Tables

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return (0, "")
    return (1, repr(value + 0.0)) if isinstance(value, float) else (1, str(value))


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, duck, name):
    query = REGISTRY[name]
    frame = query.run(Tables(spark, FOLDER))
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if query.sql is None:
        assert got
        return
    result = duck.execute(query.sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())


def test_registry_names():
    assert not any("pipeline" in n or n.startswith("op") and n[2:].isdigit() for n in REGISTRY)
    assert [n for n, q in REGISTRY.items() if q.sql is None] == ["dataset_version", "retail_snapshot"]
