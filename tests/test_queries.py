"""The registered queries against their SQL: rows, names, order and kinds of types."""

from pathlib import Path

import duckdb
import pytest

import check
from tabwright.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SLOW = {"compare_all_models", "leaderboard_all_models"}  # check.py runs them
ALL = sorted(set(QUERIES) - SLOW)


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 140


@pytest.mark.parametrize("name", ALL)
def test_query_equals_sql(spark, name):
    if not Path(FOLDER).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    if name not in SQL:
        assert df.count() > 0
        return
    cur = con.execute(SQL[name])
    assert not check.kinds_differ(df, [(c[0], c[1]) for c in cur.description])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(names, cur.fetchall())
