"""Each query gives the rows of its SQL."""

import math

import duckdb
import pytest

from framewake.plans.oracles import SQL
from framewake.plans.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in SQL:
        want = duck.sql(SQL[name])
        assert set(want.columns) == set(df.columns)
        assert sorted(tuple(map(norm, r)) for r in want.fetchall()) == sorted(tuple(norm(r[c]) for c in want.columns) for r in rows)


def test_all_have_sql_but_the_layout():
    assert set(QUERIES) - set(SQL) == {"q_label_layout"}


def test_entry_merges(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).where("sightings > 1").count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push_down(spark):
    plan = QUERIES["q_detections"](spark, DATA)._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "IsNotNull(ts)" in scan and "props" not in scan and "BroadcastHashJoin" in plan
