"""Every core query with SQL against DuckDB at the smallest scale."""

from __future__ import annotations

import datetime as dt
import importlib
import math
from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
MODULES = [importlib.import_module(f"quadrat.plans.{m}") for m in ("core_problems", "cleaning", "relations", "summaries", "panels", "models", "rapid", "intake", "extras", "pipeline")]
CASES = [(n, f, m.SQL[n]) for m in MODULES for n, f in m.QUERIES.items() if n in getattr(m, "SQL", {})]


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, dt.date | dt.datetime) else v


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_matches_sql(spark, duck, name, query, sql) -> None:
    got, want = query(spark, str(DATA)), duck.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    a = sorted([tuple(plain(r[c]) for c in sorted(cols)) for r in got.collect()], key=repr)
    b = sorted([tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in want.fetchall()], key=repr)
    assert a == b
