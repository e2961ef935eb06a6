"""Every query against its SQL on DuckDB, and plans that should stay as they are."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from almanac.plans.oracles import ORACLE_SQL
from almanac.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    shown = lambda v: repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_registered():
    names = set(__spark_entry__.queries())
    assert names >= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= names
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "rank"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["sort_recommend_topk"](spark, DATA))
    counts = plan(QUERIES["facet_status"](spark, DATA))
    assert "lineitem" not in counts and "o_totalprice" not in counts.split("== Physical Plan ==")[1]
    assert "PushedFilters: [IsNotNull" in plan(QUERIES["calendar_month_counts"](spark, DATA))
