"""Every query against its SQL, run by another engine on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from opsignal.catalog import QUERIES
from opsignal.oracle import statements

TABLES = "events conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sql():
    return statements()


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = _sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(sql[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = _sorted(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())
    assert mine == theirs
    assert mine, "a comparison of nothing proves nothing"
