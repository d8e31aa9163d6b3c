"""Every registered query with SQL gives the SQL's rows, on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from arbolist.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (Decimal, int, float)) and not isinstance(v, bool):
        return round(float(v), 9)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    cur = con.execute(catalogue.ORACLES[name])
    names, rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows), key=key)
    assert ours == theirs


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["contains_key_column", "contained_key"])
def test_needles_need_no_join(spark, con, tmp_path, name):
    """Each event's needle is made from its own row: ids that repeat or are null count as SQL counts them, and no table of needles is built or broadcast."""
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN event_id % 50 END AS event_id) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    sql = catalogue.ORACLES[name].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet')")
    assert [tuple(r) for r in got.collect()] == con.execute(sql).fetchall()
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
