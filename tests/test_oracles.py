"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest

from fojas import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    import duckdb

    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*cols).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = [tuple(map(plain, r)) for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
