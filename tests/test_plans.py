"""Every registered plan that has SQL against DuckDB on the smallest tables."""

import datetime

import duckdb
import pytest

from tracelode import plans
from tracelode.plans.base import REGISTRY

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


#: Plans that run streams several times over; the state logic and short streams are tested in test_fused_streams.py and test_streaming.py.
LONG = ("live_stream_equivalence", "three_sources_in_one_state", "attention_in_a_stream")


@pytest.mark.parametrize("name", [n for n, p in REGISTRY.items() if p.sql is not None and n not in LONG])
def test_plan_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = duck.sql(plans.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    where = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in where) for r in relation.fetchall()), key=repr)
    assert got == want


def test_plans_do_not_depend_on_how_rows_lie(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.orderBy("value").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("active_seconds_daily_wide", "agent_run_longest", "phases_islands", "asof_parent", "live_snapshot_batch"):
        rows = lambda folder: sorted(map(repr, plans.queries()[name](spark, folder).collect()))
        assert rows(FOLDER) == rows(str(tmp_path)), name
