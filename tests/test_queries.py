"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tokentally import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def as_text(rows):
    return sorted(tuple(("",) if v is None else (str(v),) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(spark, duck, name, data):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})")
    assert sorted(want.columns) == columns
    assert as_text(df.select(*columns).collect()) == as_text(want.fetchall())


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query(spark, duck, name):
    same(spark, duck, name, DATA)


BLOCK_QUERIES = ["activity_blocks", "user_blocks", "block_gaps", "burn_rate", "limit_projection", "active_block", "blocks_json", "statusline", "stream_blocks"]


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Five copies of the events, cut to minutes: most times are shared."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("tied"), duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"COPY (SELECT event_id * 5 + k AS event_id, date_trunc('minute', ts) AS ts, user_id, event_type, value, props FROM '{DATA}/events.parquet', (SELECT unnest(range(5)) AS k)) TO '{folder}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", BLOCK_QUERIES)
def test_blocks_of_tied_times(spark, tied, name):
    same(spark, tied[0], name, tied[1])


def test_names():
    assert set(own.oracle_sql()) == set(own.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_push_down(spark):
    """Only the needed columns are read, and filters on stored columns reach the scan."""
    from tokentally.sources.tables import lineitem_usage

    plan = lineitem_usage(spark, DATA).where("model = 'R'").select("model", "input_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
