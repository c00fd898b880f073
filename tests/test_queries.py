"""Every core query against its SQL on DuckDB, and the entry point."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from docmill.plans.queries import ORACLES, QUERIES, entry


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda x: round(float(x), 4) if isinstance(x, float) else x).astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    mine, sql = same(QUERIES[name](spark, small).toPandas()), same(duck.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(mine, sql)


def test_every_core_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark, small):
    rows = entry(spark, small)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_core_does_not_need_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['docmill.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
